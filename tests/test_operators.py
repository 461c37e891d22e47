"""Hits, state, pages, trees, jobs and streams on small inputs."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from gleaner.functions import html as X
from gleaner.functions import pdf as P
from gleaner.operators import ax, hits, jobs, pages, state
from gleaner.sinks import frames
from gleaner.sources import serp

HIT = "ord long, query string, title string, url string, snippet string, engine string, score double, domain_authority double"


def make(spark, rows):
    return spark.createDataFrame([(i, q, t, u, s, "bing", 0.0, a) for i, (q, t, u, s, a) in enumerate(rows, 1)], HIT)


def test_dedup_keeps_the_first(spark):
    rows = [("q", "A", "https://e.com/p?utm_source=t&a=1", "s", 0.5), ("q", "B", "https://e.com/p?fbclid=z&a=1", "s", 0.5), ("q", " a ", "https://f.com/", "s", 0.5), ("q", "C", "https://Example.COM/Page/", "s", 0.5), ("r", "D", "https://example.com/page#x", "s", 0.5)]
    assert [r.ord for r in hits.dedup_two_keys(make(spark, rows)).orderBy("ord").collect()] == [1, 4]
    assert [r.ord for r in hits.dedup_by_key(make(spark, rows)).orderBy("ord").collect()] == [1, 3, 4]


def test_ranks(spark):
    rows = [("a", "1", "https://a.com/1", "x", 0.3), ("a", "2", "https://b.com/2", "xxxx", 0.9), ("b", "3", "https://c.com/3", "xx", 0.6)]
    order = lambda s: [r.ord for r in hits.rank(make(spark, rows), s).collect()]
    assert order("serp") == [1, 3, 2] and order("authority") == [2, 3, 1] and order("snippet") == [2, 3, 1] and order("composite") == [2, 3, 1]
    with pytest.raises(ValueError, match="unknown"):
        hits.rank(make(spark, rows), "other")


def test_selection(spark):
    rows = [(q, f"{q}{i}", f"https://s{i}.{q}.com/{i}", "s", 0.5) for q in "abc" for i in range(3)]
    ranked = make(spark, rows).withColumn("place", F.col("ord"))
    picked = hits.select_candidates(ranked, 4).orderBy("turn").collect()
    assert len(picked) == 4 and {r.query for r in picked} == {"a", "b", "c"}
    one_site = make(spark, [("q", str(i), f"https://x.com/{i}", "s", 0.5) for i in range(6)]).withColumn("place", F.col("ord"))
    assert hits.select_candidates(one_site, 3).count() == 2
    assert hits.select_candidates(one_site, 6).count() == 6 and hits.select_candidates(one_site, 0).count() == 0


def turns(rows, most, cap=2):
    """(turn, place) of the greedy selection over all rows (place, query, site), by brute force."""
    by_query, sites, taken, picked = {}, {}, [], True
    for place, query, site in sorted(rows):
        by_query.setdefault(query, []).append((place, site))
    while picked and len(taken) < most:
        picked = False
        for mine in by_query.values():
            at = next((x for x in mine if sites.get(x[1], 0) < cap), None)
            if at is not None and len(taken) < most:
                mine.remove(at)
                sites[at[1]] = sites.get(at[1], 0) + 1
                taken.append(at[0])
                picked = True
    return list(enumerate(taken, 1))


def selects(spark, rows, most):
    """Whether the operator takes the rows (place, query, site) of the brute force."""
    ranked = spark.createDataFrame([(p, q, f"t{p}", f"https://{s}.com/{p}") for p, q, s in rows], "place long, query string, title string, url string")
    picked = hits.select_candidates(ranked, most).orderBy("turn").collect()
    return [(r.turn, r.place) for r in picked] == turns(rows, most)


def test_selection_takes_a_query_of_many_sites_by_rank(spark):
    assert turns(rows := [(1, "q", "a"), (2, "q", "a"), *((i, "q", f"s{i}") for i in range(3, 90))], 8)[:2] == [(1, 1), (2, 2)]
    assert selects(spark, rows, 8)
    assert selects(spark, [(i, "q", "abc"[i % 3] if i < 60 else f"s{i}") for i in range(150)], 9)


def test_selection_passes_queries_of_full_sites(spark):
    hot = [(i, f"h{i}", "a") for i in range(1, 101)]
    assert len(turns(rows := [*hot, *((i, f"q{i}", f"s{i}") for i in range(101, 120))], 8)) == 8
    assert selects(spark, rows, 8)
    draw = random.Random(3)
    rows = [(i, f"q{draw.randrange(300)}", f"s{min(draw.randrange(40), draw.randrange(40)) // 4}") for i in range(700)]
    assert selects(spark, rows, 5) and selects(spark, rows, 19)


def test_selection_of_more_than_limit_can_hold(spark):
    most = 50_000
    ranked = spark.range(1, most + 2).select(F.col("id").alias("place"), F.lit("q").alias("query"), F.lit("t").alias("title"), F.concat(F.lit("https://s.com/"), "id").alias("url"))
    assert [r.place for r in hits.select_candidates(ranked, most).orderBy("turn").collect()] == [1, 2]


def test_map_and_warnings(spark):
    mapped = hits.map_hits(make(spark, [("q", "  A  b ", "https://arxiv.org/abs/1", " s ", 0.0), ("q", "Café", "https://e.com/", "s", 0.0), ("q", "C", "https://e.com/c", "s", 0.0)])).orderBy("position").collect()
    assert [(r.title, r.position, r.score, r.source_type) for r in mapped] == [("A b", 1, 1.0, "paper"), ("C", 2, 0.5, "web")]
    done = spark.createDataFrame([("a", "https://x.com/1", "Ok"), ("b", "https://x.com/2", "PdfUnextracted")], "query string, url_canonical string, body_status string")
    assert {(r.kind, r["query"]) for r in hits.warnings(done).collect()} == {("collapsed_to_one_site", None), ("no_body_for_query", "b"), ("all_snippet_only", None)}


def test_reputation_and_blocking(spark):
    log = [("d", 1, "write", ["BotWall"]), ("d", 2, "write", ["BotWall"]), ("d", 3, "decay", []), ("e", 1, "write", ["Captcha"]), ("e", 2, "write", ["Captcha"]), ("f", 1, "write", ["BotWall"]), ("f", 2, "write", ["Captcha"])]
    rows = spark.createDataFrame(log, "domain string, seq long, kind string, flags array<string>").withColumn("ts", F.timestamp_seconds(F.col("seq") * 60))
    got = {(r.domain, r.seq): (r.hits, r.blocked) for r in state.reputation(rows).collect()}
    assert got == {("d", 1): (1, False), ("d", 2): (2, True), ("d", 3): (0, False), ("e", 1): (1, False), ("e", 2): (2, False), ("f", 1): (1, False), ("f", 2): (2, True)}


def test_router():
    ok, empty = ("Ok", 3), ("Ok", 0)
    assert state.Router().search(0, lambda e: ok) == ("google", "Served")
    assert state.Router().search(0, lambda e: empty if e != "bing" else ok) == ("bing", "Served")
    assert state.Router("free").search(0, lambda e: empty) == (None, "Empty")
    assert state.Router("free").search(0, lambda e: ("Network", 0)) == (None, "AllEnginesFailed")
    r = state.Router(quota=1)
    assert r.search(0, lambda e: ok if e == "brave_api" else ("Captcha", 0)) == ("brave_api", "Served") and r.spend == 1
    assert r.search(1, lambda e: ok, pinned="google") == (None, "Unavailable") and r.search(1, lambda e: ok, pinned="tavily") == (None, "QuotaExceeded")


PAGE = """<html lang="en"><head><title> T &amp; U </title><meta name="author" content="Ann"><script type="application/ld+json">{"datePublished":"2024-01-02","publisher":{"name":"Pub"}}</script></head>
<body><nav>menu</nav><h1>First head</h1><p>One <b>two<p>three<script>var x="</p>";</script><h2>Second head</h2><div>four</div><h1>Third head</h1><p>five</body></html>"""


def test_pages(spark):
    p = X.page(PAGE)
    assert (p["title"], p["author"], p["published"], p["language"]) == ("T & U", "Ann", "2024-01-02", "en")
    assert p["full_text"] == "First head One two three Second head four Third head five"
    parts = X.sections([(h["depth"], h["text"]) for h in p["headings"]], p["full_text"])
    assert [(s["heading"], s["depth"], s["parent"]) for s in parts] == [("First head", 1, -1), ("Second head", 2, 0), ("Third head", 1, 0)]
    assert X.sections([(1, "Main title"), (2, "Sub one"), (3, "Deep one"), (2, "Sub two")], "Main title Sub one Deep one Sub two")[2]["parent"] == 1
    assert X.follow("<body><h1>T</h1><main><p>a</p><p>b c</p></main></body>")["content"] == "ab c" and "too short" in X.follow("<p>x")["error"]
    assert [s["heading"] for s in X.plain_sections("Intro\nThe text of it is here and long enough.\n\nNext part\n\nMore text that says something at last.")] == ["Intro", "Next part"]
    rows = pages.extract_pages(spark.createDataFrame([(1, "https://e.com/", PAGE), (2, "https://e.com/2", "<p>x"), (3, "https://e.com/3", None)], "page_id long, url string, html string")).orderBy("page_id").collect()
    assert rows[0].error is None and rows[0].title == "T & U" and rows[1].error == "Empty"
    assert X.jsonld(['{"@graph":[{"author":"A"},{"author":"B"}]}', "{bad", ""]) == ("A", None)


def test_trees(spark):
    n = lambda i, role, name="", kids=(), dom=None, ignored=False, props="{}": (1, int(i), i, role, name, ignored, list(kids), dom, props)
    nodes = [n("1", "RootWebArea", "Doc", ["2", "5", "8"], 1), n("2", "button", "Go", ["3"], 7, props='{"focused":true}'), n("3", "StaticText", "Go"), n("5", "generic", "", ["6"]), n("6", "heading", "Head", [], 9, props='{"level":2}'), n("8", "paragraph", "", ["9"], ignored=True), n("9", "StaticText", "text")]
    df = spark.createDataFrame(nodes, "page_id long, place long, node_id string, role string, name string, ignored boolean, child_ids array<string>, backend_dom_id long, properties string")
    tree = ax.compress_trees(df).first()
    assert tree.tree.split("\n") == ['[1] RootWebArea "Doc"', '  [2] button "Go" <focused>', '  [3] heading "Head" (h2)', '  StaticText "text"', "", "# refs -> backendDOMNodeId", "[1]=1 [2]=7 [3]=9"]
    cut = ax.compress_trees(df, 2).first()
    assert cut.truncated and cut.total_nodes == 4 and "... truncated 2 nodes (max 2) ..." in cut.tree
    assert not ax.compress_trees(df, 0).first().truncated


def test_jobs(spark):
    cases = {
        ("simple", '{"query":"x"}'): None, ("simple", "{}"): "query is missing", ("simple", '{"query":"x","count":0}'): "count out of range", ("parallel", '{"queries":["a"," "]}'): None,
        ("parallel", '{"queries":[]}'): "queries are missing", ("harvest", '{"query":"x","queries":["a"]}'): "query is not accepted", ("extract", '{"url":"ftp://x"}'): "url must be http or https",
        ("extract", '{"url":"https://x","max_chars":0}'): "max_chars must be positive", ("pdf-file", "{}"): "path is missing", ("simple", '{"query":"x","engine":"yahoo"}'): "unknown engine",
        ("simple", '{"query":"x","freshness":"2024-01-01"}'): None, ("simple", '{"query":"x","freshness":"soon"}'): "bad freshness", ("simple", '{"query":"x","strategy":"harvest"}'): "strategy is not valid for the op",
    }
    df = spark.createDataFrame([(i, op, a) for i, (op, a) in enumerate(cases)], "i int, op string, t string").withColumn("a", F.from_json("t", jobs.ARGS))
    assert [r[0] for r in df.orderBy("i").select(jobs.problem(F.col("op"), F.col("a"))).collect()] == list(cases.values())
    arrivals = spark.createDataFrame([(1, "t", None, "auto"), (2, "t", None, "auto"), (3, "u", "bad", "auto"), (4, "v", None, "bing"), (5, "w", None, "bing")], "job long, trace_id string, problem string, engine string")
    assert [r.status for r in jobs.admit(arrivals, capacity=2).orderBy("job").collect()] == [202, 409, 400, 202, 429]
    assert [r.status for r in jobs.admit(arrivals, spend=5, limit=5).orderBy("job").collect()] == [429, 429, 400, 202, 202]
    assert {r.status for r in jobs.admit(arrivals, accepting=False).collect()} == {400, 503}


def test_sources_and_sinks(spark):
    body = json.dumps({"web": {"results": [{"title": " A ", "url": " https://a ", "description": None, "score": 0.5}, {"title": "", "url": "u"}, {"title": "C", "url": "https://c"}]}})
    rows = serp.brave_api(spark.createDataFrame([(1, body), (2, "{}"), (3, "broken")], "answer long, body string"), 5).orderBy("position").collect()
    assert [(r.position, r.title, r.url, r.score) for r in rows] == [(1, "A", "https://a", 0.5), (3, "C", "https://c", 0.0)]
    rss = "<rss><channel><item><title>a &amp; b</title><link> https://x </link><description>&lt;b&gt;d&lt;/b&gt;</description></item><item><title>no link</title></item></channel></rss>"
    got = serp.bing_rss(spark.createDataFrame([(1, rss)], "answer long, body string"), 5).collect()
    assert [(r.title, r.url, r.snippet) for r in got] == [("a & b", "https://x", "d")]
    assert frames.as_text('{"a":[1,2],"b":{"c":1},"s":"x"}') == "a: [2 items]\nb: {c}\ns: x" and frames.as_text('["é"]') == "[1] é"
    assert len(frames.as_text(json.dumps(["é" * 200])).encode()) <= 210
    text = frames.metrics_text(spark.createDataFrame([(202, "accepted"), (409, "duplicate_trace_id")], "status int, code string"), 3).first()[0]
    assert "gleaner_jobs_submitted 1\n" in text and "gleaner_queue_depth 3\n" in text


def test_pdf():
    import zlib

    shown = zlib.compress(b"BT (Zipped) Tj ET")
    data = b"%PDF-1.4\n1 0 obj << /Type /Page >> endobj\n3 0 obj << /Author (A \\(b\\)) /Title <FEFF00E9> >> endobj\n4 0 obj << /Filter /FlateDecode /Length 9 >> stream\n" + shown + b"\nendstream endobj\ntrailer << /Info 3 0 R >>"
    r = P.record(data)
    assert (r["author"], r["title"], r["text"], r["pages"], r["error"]) == ("A (b)", "é", "Zipped", 1, None)
    assert P.record(b"not a pdf")["error"] == "Unsupported"
    assert P.xmp(b"5 0 obj << /Type /Metadata >> stream\n<x:xmpmeta><dc:title><rdf:li>T</rdf:li></dc:title></x:xmpmeta>\nendstream")["title"] == "T"


def wait_for(spark, table, rows, seconds=90):
    """State timers keep a stream's triggers going, so it is never idle: wait for its rows instead."""
    end = time.time() + seconds
    while spark.table(table).count() < rows and time.time() < end:
        time.sleep(0.5)


def test_streams_equal_batches(spark, tmp_path):
    from gleaner.streaming import state as live

    log = [(f"d{i % 3}", i, "decay" if i % 7 == 0 else "write", ["BotWall"] if i % 2 else ["Captcha"]) for i in range(40)]
    rows = spark.createDataFrame(log, "domain string, seq long, kind string, flags array<string>").withColumn("ts", F.timestamp_seconds(F.col("seq") * 60))
    for part in range(2):
        rows.where(F.col("seq").between(20 * part, 20 * part + 19)).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    query = live.reputation(stream).writeStream.outputMode("append").format("memory").queryName("rep").option("checkpointLocation", str(tmp_path / "c1")).start()
    wait_for(spark, "rep", 40)
    query.stop()
    got = {(r.domain, r.seq): (r.hits, r.blocked) for r in spark.sql("SELECT * FROM rep").collect()}
    assert got == {(r.domain, r.seq): (r.hits, r.blocked) for r in state.reputation(rows).collect()}
    events = spark.createDataFrame([(1, 0, "job-started", "{}"), (1, 1, "result", "{}"), (1, 2, "done", "{}"), (1, 3, "result", "{}")], "job long, seq long, name string, data string")
    events.coalesce(1).write.parquet(str(tmp_path / "events"))
    told = live.frames(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))).writeStream.outputMode("append").format("memory").queryName("told").option("checkpointLocation", str(tmp_path / "c2")).start()
    wait_for(spark, "told", 3)
    told.stop()
    assert [r.seq for r in spark.sql("SELECT * FROM told ORDER BY seq").collect()] == [0, 1, 2]
