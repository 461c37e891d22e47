"""Registered queries over captured pages and files: metadata, result pages, PDF records, dispatch, settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.describe import describe
from gleaner.functions import html as X
from gleaner.functions import pdf as P
from gleaner.functions import quality as Q
from gleaner.functions import url as U
from gleaner.functions.arrow import row_udf
from gleaner.operators import extraction as E
from gleaner.operators import pages as PG
from gleaner.plans import inputs as I
from gleaner.plans import oracle as O
from gleaner.plans.catalog import register
from gleaner.sinks import frames as FR
from gleaner.sources import files as FS
from gleaner.sources import messages as M
from gleaner.sources import result_pages as RP
from gleaner.sources import serp as SP

# --- metadata of pages -------------------------------------------------------------
# Each page's head gets the tags and the JSON-LD that its number asks for.

HEADED_SQL = """
SELECT page_id, html, replace(html, '<meta charset="utf-8">', concat('<meta charset="utf-8">',
  CASE WHEN page_id % 2 = 0 THEN concat('<meta property="og:title" content="Page &amp; ', page_id, '">') ELSE '' END,
  CASE WHEN page_id % 3 = 0 THEN concat('<meta name="author" content="Ann ', page_id, '"><meta name="author" content="Other">') ELSE '' END,
  CASE WHEN page_id % 5 = 0 THEN '<meta property="og:site_name" content="Site">' ELSE '' END,
  CASE page_id % 4 WHEN 0 THEN '<meta name="date" content="2024-02-03">' WHEN 1 THEN '<meta property="article:published_time" content="2024-01-02"><meta name="date" content="1999-01-01">' ELSE '' END,
  '<script type="application/ld+json">',
  CASE page_id % 7 WHEN 0 THEN '{"author":"Bo","datePublished":"2023-05-06"}' WHEN 1 THEN '{"author":{"name":"Cy"},"publisher":{"name":"Pub"}}' WHEN 2 THEN '{"publisher":{"name":"Pub"}}'
    WHEN 3 THEN '{"@graph":[{"x":1},{"author":"Di"},{"author":"Ed","datePublished":"2022-01-01"}]}' WHEN 4 THEN '{broken' WHEN 5 THEN '[1]' ELSE 'null' END,
  '</script>')) AS page
FROM pages"""
HEADED = f"headed AS ({HEADED_SQL})"
LD_AUTHOR = "CASE page_id % 7 WHEN 0 THEN 'Bo' WHEN 1 THEN 'Cy' WHEN 2 THEN 'Pub' WHEN 3 THEN 'Di' END"
LD_DATE = "CASE page_id % 7 WHEN 0 THEN '2023-05-06' WHEN 3 THEN '2022-01-01' END"


def headed(spark: SparkSession, sf: str) -> DataFrame:
    text = HEADED_SQL.replace("{", "{{").replace("}", "}}").replace("FROM pages", "FROM {pages}")
    return spark.sql(text, pages=I.table(spark, sf, "pages"))


register("htm3_metadata", rf"""
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'Page & ' || page_id ELSE {O.trim("replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&amp;', '&')")} END AS title,
  CASE WHEN page_id % 5 = 0 THEN 'Site' ELSE '' END AS site_name, regexp_extract(html, '<html[^>]*\blang=.?([a-z]+)', 1) AS language,
  CASE WHEN page_id % 3 = 0 THEN 'Ann ' || page_id ELSE {LD_AUTHOR} END AS author,
  CASE page_id % 4 WHEN 0 THEN '2024-02-03' WHEN 1 THEN '2024-01-02' ELSE {LD_DATE} END AS published
FROM pages""")(lambda s, d: headed(s, d).select("page_id", X.page_udf()(F.col("page")).alias("p")).select("page_id", "p.title", "p.site_name", "p.language", "p.author", "p.published"))

register("txt17_jsonld", f"SELECT page_id, {LD_AUTHOR} AS author, {LD_DATE} AS published FROM pages")(
    lambda s, d: headed(s, d).select("page_id", X.jsonld_udf()(F.regexp_extract_all("page", F.lit(r'(?s)<script type="application/ld\+json">(.*?)</script>'), F.lit(1))).alias("p")).select("page_id", "p.author", "p.published")
)

# --- result pages -------------------------------------------------------------------
# Ten hits in a row stand on one page, as the engine marks them up, among links of its own.

ESCAPED = "replace(replace({}, '&', '&amp;'), '<', '&lt;')"
OWN_LINKS = {"brave": '<div data-type="web"><a href="/settings">Settings</a><div class="title search-snippet-title">Own</div><div class="generic-snippet"><div class="content">own</div></div></div>', "google": '<div data-hveid="0"><a href="https://maps.google.com/x">Elsewhere</a><a href="/search?q=more">More</a><a href="https://google.com/maps?x">Maps</a></div>'}


def result_pages(spark: SparkSession, sf: str, engine: str) -> DataFrame:
    hits = I.hits(spark, sf).withColumn("answer", F.expr("ord div 10"))
    title, url, snippet = (F.expr(ESCAPED.format(c)) for c in ("title", "url", "snippet"))
    if engine == "brave":
        block = F.concat(F.lit('<div class="snippet" data-type="web"><a href="'), url, F.lit('"><div class="title search-snippet-title">'), title, F.lit('</div></a><div class="generic-snippet"><p>x</p><div class="content">'), snippet, F.lit("</div></div></div>"))
    else:
        block = F.concat(F.lit('<div data-hveid="x"><a href="'), url, F.lit('"><h3>'), title, F.lit('</h3></a><span style="-webkit-line-clamp:2">'), snippet, F.lit("</span></div>"))
    listed = hits.select("answer", "ord", block.alias("block")).groupBy("answer").agg(F.array_sort(F.collect_list(F.struct("ord", "block"))).alias("x"))
    return listed.select("answer", F.concat(F.lit("<!DOCTYPE html><body>" + OWN_LINKS[engine]), F.array_join(F.col("x.block"), "\n"), F.lit("</body>")).alias("body"))


JS_SPACE = r"[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
squeezed = lambda x: f"trim(regexp_replace({x}, '{JS_SPACE}+', ' ', 'g'))"
bared = lambda x: f"regexp_replace({x}, '^{JS_SPACE}+|{JS_SPACE}+$', '', 'g')"
RESULT_ROWS = """WITH {hits}, b AS (SELECT ord, ord // 10 AS answer, {title} AS title, url, {snippet} AS snippet
    FROM hits), n AS (SELECT *, row_number() OVER (PARTITION BY answer ORDER BY ord) AS position FROM b
    WHERE length(title) >= 2 AND snippet <> '' AND NOT {left_out})
    SELECT answer, CAST(position AS INTEGER) AS position, title, url, snippet FROM n WHERE position <= 6"""
register("src12_brave_page", RESULT_ROWS.format(hits=I.HITS, title=squeezed("title"), snippet=squeezed("snippet"), left_out="false"))(
    lambda s, d: RP.read(result_pages(s, d, "brave"), "brave", 3)
)
OWN_GOOGLE = f"({O.host('url')} = 'www.google.com')"
register("src13_google_page", RESULT_ROWS.format(hits=I.HITS, title=bared("title"), snippet=squeezed("snippet"), left_out=f"coalesce({OWN_GOOGLE}, false)"))(
    lambda s, d: RP.read(result_pages(s, d, "google"), "google", 3)
)
register("flt10_captcha_titles", f"""WITH {I.HITS}
    SELECT ord, contains(title, 'Verify you are human') OR contains(title, 'Just a moment') AS brave, contains(t, 'Accessibility') OR contains(t, 'Learn more') AS google
    FROM (SELECT ord, title, concat(title, CASE WHEN ord % 4 = 0 THEN ' - Learn more' ELSE '' END) AS t
    FROM hits)""")(
    lambda s, d: I.hits(s, d).select("ord", U.is_captcha_title("brave", F.col("title")).alias("brave"), U.is_captcha_title("google", F.concat("title", F.when(F.col("ord") % 4 == 0, " - Learn more").otherwise(""))).alias("google"))
)

# --- PDF bytes -----------------------------------------------------------------------
# Each page becomes a small file: its title, author, date and first words, in the file's own ways of writing them.

WORDS = "regexp_extract(html, '([A-Za-z]+ [a-z]+)[ .]', 1)"
PDF_SQL = f"""
SELECT page_id, url, concat('%PDF-1.4\n1 0 obj << /Type /Catalog', CASE WHEN page_id % 3 = 0 THEN ' /Outlines 9 0 R' ELSE '' END, ' >> endobj\n',
  repeat('2 0 obj << /Type /Page >> endobj\n', CAST(page_id % 4 AS INT)),
  '3 0 obj << ', CASE page_id % 5 WHEN 0 THEN concat('/Author (A \\\\(', page_id, '\\\\))') WHEN 1 THEN concat('/Author <', hex(concat('B', page_id)), '>') ELSE '' END, ' /CreationDate (D:20240102030405Z) >> endobj\n',
  '4 0 obj << /Type /Metadata >> stream\n<x:xmpmeta><dc:creator><rdf:li>X', page_id, '</rdf:li></dc:creator><dc:title><rdf:li>Title ', page_id, '</rdf:li></dc:title></x:xmpmeta>\nendstream endobj\n',
  '5 0 obj << /Length 1 >> stream\n', CASE WHEN page_id % 6 = 0 THEN '' ELSE concat('BT (', {WORDS}, ') Tj ( end) Tj ET') END, '\nendstream endobj\ntrailer << /Info 3 0 R >>') AS body
FROM pages"""
PDF_FIELDS = f"""CASE page_id % 5 WHEN 0 THEN 'A (' || page_id || ')' WHEN 1 THEN 'B' || page_id ELSE 'X' || page_id END AS author, 'Title ' || page_id AS title, 'D:20240102030405Z' AS creation_date,
  CASE WHEN page_id % 6 = 0 THEN '' ELSE {WORDS} || ' end' END AS text, CAST(page_id % 4 AS INTEGER) AS pages, page_id % 3 = 0 AS has_toc, CASE WHEN page_id % 6 = 0 THEN 'Empty' END AS error"""


def pdf_bodies(spark: SparkSession, sf: str) -> DataFrame:
    # SQL text of Spark: a backslash in a literal is written twice
    rows = spark.sql(PDF_SQL.replace("\n1 0", "\\n1 0").replace("FROM pages", "FROM {pages}"), pages=I.table(spark, sf, "pages"))
    return rows.withColumn("content", F.col("body").cast("binary"))


register("src4_pdf_records", f"SELECT page_id, {PDF_FIELDS} FROM pages")(
    lambda s, d: pdf_bodies(s, d).select("page_id", P.record_udf()(F.col("content")).alias("r")).select("page_id", "r.author", "r.title", "r.creation_date", "r.text", "r.pages", "r.has_toc", "r.error")
)
register("pdf1_is_pdf", "SELECT page_id, page_id % 2 = 0 AS is_pdf FROM pages")(
    lambda s, d: pdf_bodies(s, d).select("page_id", P.is_pdf(F.when(F.col("page_id") % 2 == 0, F.col("content")).otherwise(F.encode(F.lit(" %PDF-"), "UTF-8"))).alias("is_pdf"))
)

register("pdf2_text", "SELECT page_id, coalesce(text, '') AS text FROM (SELECT page_id, " + PDF_FIELDS + " FROM pages)")(lambda s, d: pdf_bodies(s, d).select("page_id", row_udf("string", P.text)("content").alias("text")))
register("pdf3_info", "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'A (' || page_id || ')' WHEN 1 THEN 'B' || page_id END AS author, CAST(NULL AS VARCHAR) AS title, 'D:20240102030405Z' AS creation_date FROM pages")(
    lambda s, d: pdf_bodies(s, d).select("page_id", row_udf("author string, title string, creation_date string", P.info)("content").alias("i")).select("page_id", "i.*")
)
register("pdf4_xmp", "SELECT page_id, 'X' || page_id AS creator, 'Title ' || page_id AS title FROM pages")(lambda s, d: pdf_bodies(s, d).select("page_id", row_udf("creator string, title string", P.xmp)("content").alias("x")).select("page_id", "x.*"))
register("agg9_page_count", "SELECT page_id, CAST(page_id % 4 AS INTEGER) AS pages FROM pages")(lambda s, d: pdf_bodies(s, d).select("page_id", row_udf("int", P.page_count)("content").alias("pages")))
register("jn4_backfill", f"""WITH f AS (SELECT page_id, {PDF_FIELDS} FROM pages)
  SELECT page_id, coalesce(CASE WHEN page_id % 2 = 0 THEN author END, 'Ann ' || page_id) AS author, title FROM f""")(
    lambda s, d: SP.backfill(
        pdf_bodies(s, d).select("page_id", P.record_udf()("content").alias("r")).select("page_id", F.when(F.col("page_id") % 2 == 0, F.col("r.author")).alias("author"), "r.title"),
        I.table(s, d, "pages").select("page_id", F.concat(F.lit("Ann "), "page_id").alias("author")), "page_id", ["author"],
    )
)

# --- sections --------------------------------------------------------------------------
# A page a nation: its name over a heading for each supplier, every other of these with a part.

PIECES = """pieces AS (
  SELECT n_nationkey AS page_id, -2 AS a, 0 AS b, 'Nation ' || n_name AS text, 1 AS depth FROM nation
  UNION ALL SELECT n_nationkey, -1, 0, 'Key', NULL FROM nation UNION ALL SELECT n_nationkey, -1, 1, CAST(n_nationkey AS VARCHAR), NULL FROM nation
  UNION ALL SELECT s_nationkey, s_suppkey, 0, 'Supplier ' || s_suppkey || ' of ' || s_nationkey, 2 FROM supplier UNION ALL SELECT s_nationkey, s_suppkey, 1, s_name, NULL FROM supplier
  UNION ALL SELECT s_nationkey, s_suppkey, 2, 'Part ' || s_suppkey, 3 FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_nationkey, s_suppkey, 3, 'more', NULL FROM supplier WHERE s_suppkey % 2 = 0),
placed AS (SELECT *, coalesce(sum(strlen(text) + 1) OVER (PARTITION BY page_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spot, sum(strlen(text) + 1) OVER (PARTITION BY page_id) - 1 AS whole FROM pieces)"""


def crafted(spark: SparkSession, sf: str) -> DataFrame:
    nation, supplier = I.table(spark, sf, "nation"), I.table(spark, sf, "supplier")
    block = F.concat(F.lit("<h2> Supplier "), "s_suppkey", F.lit(" of "), "s_nationkey", F.lit("</h2><div>"), "s_name", F.lit("<script>var x = 1;</script></div>"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("<h3>Part "), "s_suppkey", F.lit("</h3><p>more"))).otherwise(""))
    blocks = supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", block.alias("html")))).alias("x"))
    whole = F.concat(F.lit("<html><body><nav>menu</nav><h1>Nation "), "n_name", F.lit("</h1><p>Key <b>"), "n_nationkey", F.lit("</b></p>"), F.coalesce(F.array_join(F.col("x.html"), "\n"), F.lit("")), F.lit("</body></html>"))
    return nation.join(blocks, "n_nationkey", "left").select(F.col("n_nationkey").cast("long").alias("page_id"), F.concat(F.lit("https://e.com/"), "n_nationkey").alias("url"), whole.alias("html"))


register("sec2_nested_sections", f"""WITH {PIECES}, h AS (SELECT *, CAST(row_number() OVER w - 1 AS INTEGER) AS place, coalesce(lead(spot) OVER w, whole) - spot AS length FROM placed WHERE depth IS NOT NULL WINDOW w AS (PARTITION BY page_id ORDER BY a, b))
  SELECT CAST(page_id AS BIGINT) AS page_id, place, text AS heading, depth, CAST(spot AS BIGINT) AS starts, CAST(length AS BIGINT) AS length, CASE depth WHEN 1 THEN -1 WHEN 2 THEN 0 ELSE place - 1 END AS parent FROM h""")(
    lambda s, d: PG.extract_pages(crafted(s, d)).select("page_id", F.posexplode("sections").alias("place", "s")).select("page_id", "place", "s.heading", "s.depth", F.col("s.offset").alias("starts"), "s.length", "s.parent")
)
register("htm2_text_nodes", f"WITH {PIECES} SELECT CAST(page_id AS BIGINT) AS page_id, string_agg(text, ' ' ORDER BY a, b) AS full_text FROM pieces GROUP BY page_id")(lambda s, d: crafted(s, d).select("page_id", X.page_udf()("html").alias("p")).select("page_id", "p.full_text"))
register("qlt6_page_score", """SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN round(greatest(CAST(0 AS DOUBLE), base - 0.1) * 100) / 100 ELSE base END AS score, doc_id % 4 < 2 AS no_headings
  FROM (SELECT doc_id, CAST(doc_id % 21 AS DOUBLE) / 20 AS base FROM documents)""")(
    lambda s, d: I.table(s, d, "documents").select("doc_id", *[c.alias(n) for c, n in zip(Q.page_score(F.col("doc_id") % 21 / F.lit(20.0), F.col("doc_id") % 4), ("score", "no_headings"), strict=True)])
)

# --- messages --------------------------------------------------------------------------

register("m48_messages", """SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'reply' WHEN 1 THEN 'failure' WHEN 2 THEN 'event' ELSE 'reply' END AS kind, CASE WHEN turn % 4 <> 2 THEN conv_id END AS id,
  CASE turn % 4 WHEN 0 THEN CAST(to_json({'text': text}) AS VARCHAR) WHEN 1 THEN role WHEN 2 THEN CAST(to_json({'n': turn}) AS VARCHAR) ELSE 'null' END AS body, CASE WHEN turn % 4 = 2 THEN 'Page.' || role END AS method FROM conversations""")(
    lambda s, d: I.table(s, d, "conversations").select("conv_id", "turn", M.route(F.expr("CASE turn % 4 WHEN 0 THEN to_json(named_struct('id', conv_id, 'result', named_struct('text', text))) WHEN 1 THEN to_json(named_struct('id', conv_id, 'error', named_struct('message', role))) WHEN 2 THEN to_json(named_struct('method', concat('Page.', role), 'params', named_struct('n', turn))) ELSE to_json(named_struct('id', conv_id)) END")).alias("m")).select("conv_id", "turn", "m.*")
)
register("m30_error_codes", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'captcha' WHEN 1 THEN 'timeout' END AS code FROM events")(lambda s, d: I.table(s, d, "events").select("event_id", FR.parse_code(F.element_at(F.array(*map(F.lit, ("captcha", "timeout", "Captcha", "soon"))), (F.col("event_id") % 4 + 1).cast("int"))).alias("code")))
register("snk12_describe")(lambda s, d: s.createDataFrame([(describe(),)], "value string"))

# --- dispatch ------------------------------------------------------------------------

ADDRESS = """CASE page_id % 6 WHEN 0 THEN concat('https://arxiv.org/abs/2301.', page_id)
    WHEN 1 THEN concat('https://github.com/o/r/blob/main/f', page_id, '.rs')
    WHEN 2 THEN concat('https://e.com/d', page_id, '.pdf')
    WHEN 3 THEN concat('https://github.com/o', page_id, '/r')
    WHEN 4 THEN concat('https://github.com/o/r/issues/', page_id) ELSE url END"""


def captured(spark: SparkSession, sf: str) -> DataFrame:
    """Pages behind addresses of every kind; the bytes behind every other arXiv address are no PDF."""
    rows = headed(spark, sf).join(pdf_bodies(spark, sf).select("page_id", "url", "content"), "page_id")
    bytes_ = F.when((F.col("page_id") % 12 == 0), F.lit("gone").cast("binary")).otherwise(F.col("content"))
    return rows.select("page_id", F.expr(ADDRESS).alias("url"), F.col("page").alias("html"), bytes_.alias("content"))


register("art2_dispatch", rf"""
WITH {HEADED}, k AS (SELECT p.page_id, {ADDRESS} AS url, h.page, CASE page_id % 6 WHEN 0 THEN 'arxiv' WHEN 2 THEN 'pdf' WHEN 5 THEN 'web' ELSE 'github' END AS extractor, p.html FROM pages p JOIN headed h USING (page_id)),
f AS (SELECT page_id, {PDF_FIELDS} FROM pages)
SELECT k.page_id, url, extractor, CASE WHEN extractor = 'arxiv' THEN 'ArxivOai' WHEN extractor = 'pdf' THEN 'Pdf' WHEN page_id % 6 IN (1, 3) THEN 'Raw' ELSE 'Readability' END AS method,
  CASE WHEN page_id % 6 = 1 THEN 'rust' WHEN page_id % 6 = 3 THEN 'com/o' || page_id || '/r' END AS language,
  CASE WHEN extractor = 'pdf' THEN f.author WHEN page_id % 6 IN (1, 3) THEN NULL WHEN page_id % 3 = 0 THEN 'Ann ' || page_id ELSE {LD_AUTHOR} END AS author,
  CASE WHEN extractor = 'pdf' THEN f.error END AS error,
  CASE WHEN extractor = 'pdf' THEN md5(f.text) WHEN page_id % 6 IN (1, 3) THEN md5(page[1:40000]) END AS content
FROM k JOIN f USING (page_id)""")(
    lambda s, d: E.extract(captured(s, d)).select("page_id", "url", "extractor", "method", "language", "author", "error", F.when((F.col("extractor") == "pdf") | (F.col("method") == "Raw"), F.md5(F.col("content").cast("binary"))).alias("content"))
)
register("src6_pdf_addresses", f"""SELECT id, CASE
    WHEN contains(url, '/abs/') THEN replace(url, '/abs/', '/pdf/') WHEN contains(url, '/pdf/') THEN url
    ELSE rtrim(url, '/') || '/pdf' END AS pdf_url FROM (WITH {I.URLS}
    SELECT * FROM urls)""")(
    lambda s, d: I.urls(s, d).select("id", SP.arxiv_pdf_url(F.col("url")).alias("pdf_url"))
)

# --- settings -------------------------------------------------------------------------
# Each order is a run; its columns are the values of its variables.

SETTING_ROWS = [
    (1, "CDP_HOST", "concat('http://h', o_custkey, ':9222')", "o_custkey % 2 = 0"), (2, "UPDATE_DISABLED", "CASE WHEN o_orderkey % 2 = 0 THEN ' Yes ' ELSE 'no' END", "o_custkey % 3 = 0"),
    (3, "REPUTATION_TTL_SECS", "CASE WHEN o_custkey % 5 = 0 THEN 'soon' ELSE CAST(o_custkey AS STRING) END", "true"), (4, "SERVE_PORT", "CAST(o_custkey * 100 AS STRING)", "o_custkey % 2 = 1"),
    (5, "SERVE_BIND", "concat('0.0.0.0:', o_custkey)", "o_custkey % 7 = 0"), (6, "SIMPLE_TIMEOUT", "CAST(o_custkey AS STRING)", "o_custkey % 4 = 0"), (7, "REPUTATION_TTL_SECS", "'-1'", "o_custkey % 3 = 1"),
    (8, "TIMEOUT", "'9'", "true"), (9, "USER_AGENT", "'first'", "o_custkey % 2 = 0"), (10, "USER_AGENT", "o_orderstatus", "o_custkey % 4 = 0"),
]


def entries(spark: SparkSession, sf: str) -> DataFrame:
    rows = F.array(*[F.when(F.expr(when), F.struct(F.lit(at).alias("at"), F.lit(FS.PREFIX + key).alias("key"), F.expr(value).alias("value"))) for at, key, value, when in SETTING_ROWS])
    return I.table(spark, sf, "orders").select(F.col("o_orderkey").alias("run"), F.explode(F.array_compact(rows)).alias("x")).select("run", "x.*")


register("src26_settings", """
SELECT o_orderkey AS run, CASE WHEN o_custkey % 2 = 0 THEN 'http://h' || o_custkey || ':9222' ELSE 'http://127.0.0.1:9222' END AS cdp_host, o_custkey % 3 = 0 AND o_orderkey % 2 = 0 AS update_disabled,
  CASE WHEN o_custkey % 4 = 0 THEN o_orderstatus WHEN o_custkey % 2 = 0 THEN 'first' END AS user_agent, CASE WHEN o_custkey % 5 = 0 THEN 86400 ELSE o_custkey END AS reputation_ttl_secs,
  CASE WHEN o_custkey % 7 = 0 THEN '0.0.0.0:' || o_custkey WHEN o_custkey % 2 = 1 AND o_custkey * 100 <= 65535 THEN '127.0.0.1:' || (o_custkey * 100) ELSE '127.0.0.1:9080' END AS serve_bind,
  CASE WHEN o_custkey % 4 = 0 THEN o_custkey END AS simple_timeout
FROM orders""")(lambda s, d: FS.settings(entries(s, d)).select("run", "cdp_host", "update_disabled", "user_agent", "reputation_ttl_secs", "serve_bind", F.col("command_timeouts")["simple"].alias("simple_timeout")))
