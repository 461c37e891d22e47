"""Tables of exact values for the column functions."""

import pytest
from pyspark.sql import functions as F

from gleaner.functions import jsonpath as J
from gleaner.functions import quality as Q
from gleaner.functions import rewrite as R
from gleaner.functions import text as T
from gleaner.functions import url as U


def run(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x"))).collect()]


def test_canonical_urls(spark):
    cases = {
        "HTTP://EXAMPLE.COM/Path": "http://example.com/path", "http://example.com/?z=1&a=2": "http://example.com/?a=2&z=1", "not a url": "not a url", "": "",
        "http://example.com//path//to//file": "http://example.com/path/to/file", "http://example.com/page/": "http://example.com/page", "http://example.com/": "http://example.com/",
        "https://e.com:443/a?utm_source=x&b=1": "https://e.com/a?b=1", "http://e.com/a#F": "http://e.com/a#F", "http://e.com?b=2&a=1&b=1": "http://e.com/?a=1&b=2&b=1", None: None,
    }
    assert run(spark, U.canonicalize_url, list(cases)) == list(cases.values())
    assert run(spark, U.dedup_key, ["http://example.com/page#section1", "https://www.e.com/x"]) == ["http://example.com/page", "https://www.e.com/x"]


def test_url_kinds(spark):
    assert run(spark, U.registered_domain, ["http://sub.example.co.uk/page", "http://10.0.0.1/x", "http://com/", "http://co.uk/", "mailto:a@b.c", None]) == ["example.co.uk", None, None, None, None, None]
    assert run(spark, U.is_pdf_url, ["https://e.com/doc.PDF", "https://arxiv.org/pdf/2301.00001", "https://e.com/x.txt", "not a url"]) == [True, True, False, False]
    authority = run(spark, lambda c: U.domain_authority(c), ["arxiv.org", "www.arxiv.org", "github.com", "unknown.io", "", "cs.mit.edu", "notarxiv.org", "www.gov.ac.uk"])
    assert authority == [0.9, 0.9, 0.8, 0.5, 0.5, 0.8, 0.5, 0.8]
    assert run(spark, U.source_type, ["https://github.com/a", "https://arxiv.org/abs/1", "https://e.com/a.pdf?x", "https://www.cnn.com/x", "https://e.com/a.png", "https://e.com/"]) == ["github", "paper", "pdf", "news", "image", "web"]
    assert run(spark, U.is_junk_url, ["https://accounts.google.com/x", "https://e.com/author", "https://e.com/auth", "https://e.com/LOGIN"]) == [True, False, True, True]
    assert run(spark, U.is_translate_wrapper, ["https://translate.google.com/x", "https://a.translate.goog/", "https://google.com/url?q=x", "https://google.com/maps", "x"]) == [True, True, True, False, False]
    assert run(spark, U.detect_language, ["https://e/x.rs", "https://e/x.tsx?y", "https://e/x.zig"]) == ["rust", "typescript", "zig"]


def test_texts(spark):
    assert run(spark, T.collapse, ["  a \n\t b　c ", ""]) == ["a b c", ""]
    assert run(spark, T.decode_entities, ["&amp;lt; &#39;&#x27; &nope; & &eacute;", "a & b; c", None]) == ["&lt; '' &nope; & é", "a & b; c", None]
    assert run(spark, T.strip_tags, ["<b>x</b> <3 <unclosed\n> y"]) == ["x <3 <unclosed\n> y"]
    assert run(spark, T.clean_title, ["TitleExample.com", "JavaScript", "A https://x.y", "Rust (lang)Docs.rs", "iPhone"]) == ["Title", "JavaScript", "A", "Rust (lang)Docs.rs", "iPhone"]
    assert run(spark, T.clean_snippet, ["abc...Read more", "abc Read more", "Read more about"]) == ["abc", "abc", "Read more about"]
    assert [round(x, 6) for x in run(spark, T.entropy, ["", "aaaaaaaaaa", "aaaaabbbbb", "abcd" * 5, "  ab  "])] == [0, 0, 1, 2, 1]
    assert run(spark, lambda c: T.preview(c, 5), ["文文", "éé", "ascii text", "🙂🙂", "ab文"]) == ["文", "éé", "ascii", "🙂", "ab文"]
    assert run(spark, T.pdf_date, ["D:20240102030405Z", "D:2024", "D:20240102030405+05'30'", "D:20241399", "x"]) == ["2024-01-02T03:04:05+00:00", "2024-01-01T00:00:00+00:00", "2024-01-02T03:04:05+05:30", None, None]
    assert run(spark, T.traceparent_id, ["00-" + "a" * 32 + "-b-01", "00-xyz-b"]) == ["a" * 32, None]
    assert run(spark, lambda c: T.strip_leading_title(c, F.lit("My Title")), ["MY TITLE  the rest", "other"]) == ["the rest", "other"]


def test_dot_paths(spark):
    doc = '{"a":{"b":[{"c":1},{"c":2}]},"s":"x"}'
    for path, want in {".s": '"x"', ".a.b[].c": "[1,2]", ".a.b[]": '[{"c":1},{"c":2}]', ".none": "[]", ".s[]": '"x"', ".a.b": '[{"c":1},{"c":2}]'}.items():
        assert run(spark, lambda c, p=path: J.apply_path(c, p), [doc]) == [want]


@pytest.mark.parametrize(
    ("query", "engine", "want"),
    [
        ("react cache:react.dev define:rust hooks", "google", "react hooks"), ("rust near:3 cargo inanchor:docs", "bing", "rust cargo"), ("site:a.com filetype:pdf", "bing", "site:a.com filetype:pdf"),
        ("(docker OR podman) compose after:2025 AROUND(2)", "bing", "docker OR podman compose"), ("Rust rust async", "google", "Rust async"), ('"a  b" x*', "brave", '"a  b" x'), ("  ", "bing", "  "),
    ],
)
def test_rewrites(spark, query, engine, want):
    assert run(spark, lambda c: R.rewrite(c, engine), [query]) == [want]


def test_quality(spark):
    prose = "The river runs past the old town, and every spring the people come down to watch the water rise. Nobody minds the cold. They stay until dark."
    nav = "About us Contact us Pricing Blog Careers FAQ Help center Log in Sign in Get started Privacy policy Terms of service"
    texts = ["", "Hi", prose, "🙂" * 7500, "a" * 15001, nav, "Featured articles of the week. " + prose]
    df = Q.validate(spark.createDataFrame(list(enumerate(texts)), "i int, x string"), "x")
    rows = df.select(F.col("reasons").alias("r"), F.col("score").alias("s"), F.octet_length("x").alias("n")).orderBy("i").collect()
    assert rows[0].r == ["empty_content"] and rows[0].s == 0
    assert "too_short" in rows[1].r and rows[1].s < 0.5
    assert rows[2].r == [] and rows[2].s == 1.0
    assert rows[3].n == 30000 and "no_punctuation" in rows[3].r
    assert "no_punctuation" in rows[4].r and rows[4].s > 0
    assert "navigation_chrome" in rows[5].r and "boilerplate" in rows[6].r
    flags = run(spark, Q.flags, ["Checking your browser " + prose, "Subscribe to read. " + prose, prose, "", "solve the captcha. " + prose])
    assert flags == [["BotWall"], ["Paywall"], [], ["EmptyShell"], ["Captcha"]]
    body = Q.judge_body(df.withColumn("flags", Q.flags(F.col("x"))), "x", "flags").orderBy("i").collect()
    assert body[2].q_is_ok and not body[5].q_is_ok and body[0].q_reasons == ["empty_content"]


def test_deep_pages_and_broken_json():
    from gleaner.functions import html as X
    from gleaner.sinks import frames as FR

    deep = "<html><title>T</title><body>" + "<div>" * 5000 + "<p>" + "Some words in the middle of it. " * 5 + "</p>" + "</div>" * 5000 + "</body></html>"
    assert X.page(deep)["full_text"].startswith("Some words") and X.follow(deep)["content"].startswith("Some words")
    assert FR.as_text('{"a":') == '{"a":' and FR.as_text("[" * 100000) == "[" * 100000 and FR.as_text('{"a":[1]}') == "a: [1 items]"


def test_entropy_of_odd_texts(spark):
    texts = [None, "   ", "x", "éé", "éa", "🙂🙂ab", "a" * 200000 + "b" * 200000]
    assert [round(x, 6) for x in run(spark, T.entropy, texts)] == [0, 0, 0, 0, 1, 1.5, 1]
