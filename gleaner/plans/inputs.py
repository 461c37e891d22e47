"""Inputs of the registered queries, in SQL that Spark and DuckDB both read.

``pages`` stand for captured results: each page is a hit of the query named by
its language segment.  Addresses are varied by page number so that every rule
has something to do, and literal rows add the cases that the tables lack.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def quote(x) -> str:
    if x is None:
        return "CAST(NULL AS STRING)"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def values(rows: list[tuple], names: str) -> str:
    """SELECT of literal rows, for DuckDB."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quote, r)) + ')' for r in rows)}) AS literal({names})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LITERAL_URLS = [
    (9000001, "HTTP://EXAMPLE.COM/Path"), (9000002, "http://example.com/?z=1&a=2"), (9000003, "http://example.com/page#section1"), (9000004, "not a url"),
    (9000005, ""), (9000006, "http://example.com//path//to//file"), (9000007, "http://example.com/page/"), (9000008, "http://example.com/"),
    (9000009, "http://sub.example.co.uk/page"), (9000010, "https://example.com/doc.pdf"), (9000011, "https://arxiv.org/pdf/2301.00001"), (9000012, "https://www.arxiv.org/abs/2301.00001"),
    (9000013, "https://translate.google.com/translate?u=x"), (9000014, "https://en-m.translate.goog/x"), (9000015, "https://www.google.com/url?q=http://a.b"), (9000016, "https://accounts.google.com/x"),
    (9000017, "https://example.com/login"), (9000018, "https://ads.doubleclick.net/x"), (9000019, "https://example.com/author"), (9000020, "https://example.com/oauth/auth?x=1"),
    (9000021, "https://www.nytimes.com/2024/01/a.html"), (9000022, "https://i.imgur.com/a"), (9000023, "https://example.com/a.PNG"), (9000024, "https://github.com/a/b/blob/main/x.rs"),
    (9000025, "https://example.com:443/a?b=1&utm_medium=x&a=2&b=0"), (9000026, "https://u:p@example.com:8080/A%20b?q=a+b&r=c%2Fd"), (9000027, "mailto:a@b.c"), (9000028, "http://10.0.0.1/x"),
    (9000029, "https://example.com/?"), (9000030, "https://example.com/#"), (9000031, "https://en.wikipedia.org/wiki/X#:~:text=a"), (9000032, "https://www.merriam-webster.com/dictionary/x"),
    (9000033, "https://cs.stanford.edu/p"), (9000034, "https://www.bbc.co.uk/news"), (9000035, "about:blank"), (9000036, "ftp://example.com/x"),
    (9000037, "https://arxiv.org/abs/2301.00001"), (9000038, "https://github.com/a/b"), (9000039, "https://gist.github.com/a/1"), (9000040, "https://example.com/pdf/1"),
]

URLS_SQL = """
SELECT page_id AS id, url FROM pages
UNION ALL SELECT page_id + 1000000, concat(replace(url, '#top', ''), CASE WHEN url LIKE '%?%' THEN '&' ELSE '?' END, 'utm_source=tw&B=2&a=1') FROM pages WHERE page_id % 3 = 0 AND url NOT LIKE '%#%'
UNION ALL SELECT page_id + 2000000, concat(upper(url), '/') FROM pages WHERE page_id % 5 = 0
UNION ALL SELECT page_id + 3000000, replace(replace(replace(url, 'example.com', 'github.com'), 'example.org', 'arxiv.org'), 'example.net', 'reuters.com') FROM pages WHERE page_id % 4 = 0
UNION ALL SELECT page_id + 4000000, concat(replace(url, '#top', ''), '.pdf') FROM pages WHERE page_id % 9 = 0 AND url NOT LIKE '%?%' AND url NOT LIKE '%#%'"""

HITS_SQL = """
SELECT page_id AS ord, regexp_extract(url, '://[^/]+/([a-z]+)', 1) AS query,
  regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title,
  CASE page_id % 6 WHEN 1 THEN replace(url, 'example.com', 'github.com') WHEN 2 THEN replace(url, 'example.org', 'arxiv.org') WHEN 3 THEN replace(url, 'example.net', 'nytimes.com') ELSE url END AS url,
  regexp_extract(html, '(?s)<p>(.*?)</p>', 1) AS snippet,
  CASE page_id % 5 WHEN 0 THEN 'bing' WHEN 1 THEN 'brave' WHEN 2 THEN 'google' WHEN 3 THEN 'brave_api' ELSE 'tavily' END AS engine,
  CASE WHEN page_id % 8 = 0 THEN 0.75 ELSE 0.0 END AS score
FROM pages
UNION ALL
SELECT page_id + 1000000, 'again', regexp_extract(html, '(?s)<title>(.*?)</title>', 1), concat(replace(url, '#top', ''), CASE WHEN url LIKE '%?%' THEN '&' ELSE '?' END, 'fbclid=z'),
  regexp_extract(html, '(?s)<p>(.*?)</p>', 1), 'bing', 0.0
FROM pages WHERE page_id % 4 = 0"""

LITERAL_HITS = [
    (9000001, "en", "Same", "https://site-a.com/x?utm_source=t&a=1", "first copy of a page", "bing", 0.0),
    (9000002, "en", "Other", "https://site-a.com/x?fbclid=z&a=1", "second copy of a page", "bing", 0.0),
    (9000003, "en", " same ", "https://site-b.com/y", "same title, other page", "brave", 0.0),
    (9000004, "fr", "Rust definition", "https://site-c.com/z", "a word", "brave", 0.0),
    (9000005, "fr", "Meaning", "https://site-d.com/z", "The definition of rust", "google", 0.0),
    (9000006, "fr", "Text", "https://site-e.com/z#:~:text=a", "highlight", "google", 0.0),
    (9000007, "de", "Wrapped", "https://www.google.com/url?q=http://a.b", "wrapper", "google", 0.0),
    (9000008, "de", "Blank", "https://site-f.com/", "  ", "tavily", 0.0),
    (9000009, "de", " ", "https://site-g.com/", "no title", "tavily", 0.0),
    (9000010, "es", "Sign in to continue", "https://site-h.com/a", "please do", "tavily", 0.0),
    (9000011, "es", "Please", "https://accounts.google.com/signin", "account", "tavily", 0.0),
    (9000012, "es", "Paper", "https://arxiv.org/abs/1234.5", "An abstract", "brave_api", 0.5),
]


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    literal = spark.createDataFrame(LITERAL_URLS, "id long, url string")
    return spark.sql(URLS_SQL.replace("FROM pages", "FROM {pages}"), pages=table(spark, sf_dir, "pages")).unionAll(literal)


URLS = f"urls AS ({URLS_SQL} UNION ALL {values(LITERAL_URLS, 'id, url')})"


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    literal = spark.createDataFrame(LITERAL_HITS, "ord long, query string, title string, url string, snippet string, engine string, score double")
    found = spark.sql(HITS_SQL.replace("FROM pages", "FROM {pages}"), pages=table(spark, sf_dir, "pages"))
    return found.withColumn("score", found["score"].cast("double")).unionAll(literal)


HITS = f"hits AS ({HITS_SQL} UNION ALL {values(LITERAL_HITS, 'ord, query, title, url, snippet, engine, score')})"

LITERAL_TEXTS = [
    (9000001, ""), (9000002, "Hi"), (9000003, "Please complete the captcha to go on with your visit."), (9000004, "Checking your browser before you enter example.com. Just a moment..."),
    (9000005, "Subscribe to read the full story about the garden and the people who have kept it alive for all those years, day after day."), (9000006, "Please enable JavaScript and try using another browser to see this page, which has a good deal of text in it otherwise, as one may see."),
    (9000007, "This site can't be reached. ERR_CONNECTION refused by the host that was asked."), (9000008, "404 Not Found"), (9000009, "Read More »"),
    (9000010, "About us Contact us Pricing Blog Careers FAQ Help center Log in Sign in Get started Privacy policy Terms of service"),
    (9000011, "Code Issues Pull requests Actions Projects Wiki Security Insights Settings"), (9000012, "Featured articles of the week, chosen by the editors from among all the pieces that were sent in. They are well worth reading."),
    (9000013, "Press enter or click to view image in full size\n\nThe   river runs  past the town, and nobody\n\n\nknows where it comes from. It is wide."),
    (9000014, "Share this article or listen to podcast episodes about trains, boats and planes with all your friends at home. It is free!"), (9000015, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"),
    (9000016, "Learn more about it. Read more about that. Learn more about the rest of it, and read more of what there is to read on the subject."),
    (9000017, "éééé éééé éééé éééé éééé éééé éééé éééé éééé éééé éééé éééé éééé éééé éééé éééé éééé."), (9000018, "  spaced out  "),
]


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text").unionAll(spark.createDataFrame(LITERAL_TEXTS, "doc_id long, text string"))


TEXTS = f"texts AS (SELECT doc_id, text FROM documents UNION ALL {values(LITERAL_TEXTS, 'doc_id, text')})"
