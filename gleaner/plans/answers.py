"""Registered queries of captured answers of engines, code hosts and papers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import url as U
from gleaner.operators import pages as PG
from gleaner.plans import inputs as I
from gleaner.plans import oracle as O
from gleaner.plans.catalog import register
from gleaner.plans.logs import calls
from gleaner.sources import serp as SP

# Each page's hit is wrapped into an engine's answer and read back.


def answers(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    hits = I.hits(spark, sf).withColumn("answer", F.expr("ord div 10"))
    listed = hits.groupBy("answer").agg(F.array_sort(F.collect_list(F.struct("ord", "title", "url", "snippet", "score"))).alias("x"))
    if kind == "rss":
        item = lambda x: F.concat(F.lit("<item><title>"), x["title"], F.lit("</title><link> "), x["url"], F.lit(" </link><description>&lt;b&gt;"), x["snippet"], F.lit("</description></item>"))
        return listed.select("answer", F.concat(F.lit("<rss><channel>"), F.array_join(F.transform("x", item), "\n"), F.lit("</channel></rss>")).alias("body"))
    text = "description" if kind == "brave" else "content"
    items = F.transform("x", lambda x: F.struct(F.concat(F.lit("  "), x["title"]).alias("title"), x["url"].alias("url"), x["snippet"].alias(text), x["score"].alias("score")))
    return listed.select("answer", F.to_json(F.struct(F.struct(items.alias("results")).alias("web")) if kind == "brave" else F.struct(items.alias("results"))).alias("body"))


ORGANIC = f"""WITH {I.HITS}, n AS (SELECT ord // 10 AS answer, row_number() OVER (PARTITION BY ord // 10
    ORDER BY ord) AS position, {O.trim('title')} AS title, {O.trim('url')} AS url, {O.trim('snippet')} AS snippet, score
    FROM hits), k AS (SELECT *, row_number() OVER (PARTITION BY answer ORDER BY position) AS m FROM n
    WHERE title <> '' AND url <> '') SELECT answer, CAST(position AS INTEGER) AS position, title, url, snippet, CAST(score AS DOUBLE) AS score
    FROM k WHERE m <= 5"""
for _name, _kind, _read in (("src17_brave_api", "brave", SP.brave_api), ("src18_tavily", "tavily", SP.tavily), ("src19_organic", "brave", SP.brave_api)):
    register(_name, ORGANIC)(lambda s, d, k=_kind, r=_read: r(answers(s, d, k), 5).drop("published_date"))
def untagged(x: str) -> str:
    return f"regexp_replace({x}, '<[A-Za-z/!?][^>\\n]{{0,999}}>', '', 'g')"


register("src11_bing_rss", f"""WITH {I.HITS}, n AS (SELECT ord // 10 AS answer, row_number() OVER (PARTITION BY ord // 10
    ORDER BY ord) AS position, title, url, snippet FROM hits)
    SELECT answer, CAST(position AS INTEGER) AS position, {O.collapse(untagged(O.entities('title')))} AS title, {O.trim('url')} AS url, {O.collapse(untagged(O.entities('snippet')))} AS snippet
    FROM n WHERE position <= 5""")(lambda s, d: SP.bing_rss(answers(s, d, "rss"), 5))
STATUS = "CASE page_id % 7 WHEN 0 THEN 429 WHEN 1 THEN 401 WHEN 2 THEN 403 WHEN 3 THEN 500 ELSE 200 END"
RETRY = "CASE page_id % 3 WHEN 0 THEN ' 30 ' WHEN 1 THEN 'soon' END"
statuses = lambda s, d: I.table(s, d, "pages").select("page_id", F.expr(STATUS).alias("status"), F.expr(RETRY).alias("retry"))
register("src2_rate_limit", f"""SELECT page_id, CASE
    WHEN s = 429 THEN TRY_CAST(trim(r) AS BIGINT) END AS retry_after_s, CASE
    WHEN s = 429 THEN r IS NOT NULL AND TRY_CAST(trim(r) AS BIGINT) IS NULL END AS malformed
    FROM (SELECT page_id, {STATUS} AS s, {RETRY} AS r
    FROM pages)""")(
    lambda s, d: statuses(s, d).select("page_id", SP.rate_limit(F.col("status"), F.col("retry")).alias("x")).select("page_id", "x.retry_after_s", "x.malformed")
)
register("src20_status_error", f"""SELECT page_id, CASE WHEN s = 429 THEN 'RateLimited'
    WHEN s IN (401, 403) THEN 'Unavailable' WHEN s <> 200 THEN 'Network' END AS kind, CASE
    WHEN s = 429 THEN TRY_CAST(trim(r) AS BIGINT) * 1000 END AS retry_after_ms FROM (SELECT page_id, {STATUS} AS s, {RETRY} AS r
    FROM pages)""")(
    lambda s, d: statuses(s, d).select("page_id", SP.status_error(F.col("status"), F.col("retry")).alias("x")).select("page_id", "x.kind", "x.retry_after_ms")
)
register("src1_fetch", f"""SELECT page_id, CASE WHEN s = 429 THEN 'RateLimited'
    WHEN s <> 200 THEN 'Http' END AS error FROM (SELECT page_id, {STATUS} AS s
    FROM pages)""")(lambda s, d: statuses(s, d).select("page_id", SP.fetch_error(F.col("status")).alias("error")))
GITHUB = """CASE page_id % 5 WHEN 0 THEN replace(url, 'example', 'x')
    WHEN 1 THEN concat('https://github.com/o', page_id, '/r')
    WHEN 2 THEN concat('https://github.com/o/r/blob/main/f', page_id, '.rs')
    WHEN 3 THEN concat('https://github.com/o/r/tree/main/', page_id)
    ELSE concat('https://github.com/o/r/pull/', page_id, '.diff') END"""
register("src7_github_route", f"""WITH g AS (SELECT page_id, {GITHUB} AS u FROM pages), p AS (SELECT *, {O.piece('u', 3)} AS path FROM g),
  k AS (SELECT *, CASE WHEN regexp_matches(path, '/blob/|/tree/') OR regexp_matches(path, '\\.(diff|patch)$') THEN 'raw' WHEN len(list_filter(string_split(path, '/'), lambda x: x <> '')) = 2 THEN 'readme' ELSE 'web' END AS kind FROM p)
  SELECT page_id, kind, CASE WHEN contains(path, '/blob/') THEN replace(replace(u, 'github.com', 'raw.githubusercontent.com'), '/blob/', '/') WHEN contains(path, '/tree/') THEN replace(replace(u, 'github.com', 'raw.githubusercontent.com'), '/tree/', '/')
    WHEN kind = 'readme' THEN array_to_string(list_filter(string_split(path, '/'), lambda x: x <> ''), '/') ELSE u END AS target FROM k""")(
    lambda s, d: I.table(s, d, "pages").select("page_id", SP.github_route(F.expr(GITHUB)).alias("x")).select("page_id", "x.kind", "x.target")
)
register("src8_code_article", """SELECT doc_id, coalesce(CASE
    WHEN doc_id % 2 = 0 THEN 'rust' END, 'zig') AS language, md5(text[11:40]) AS content, CAST(length(regexp_replace(text, chr(10) || '$', '')) - length(replace(regexp_replace(text, chr(10) || '$', ''), chr(10), '')) + 1 AS INTEGER) AS line_count
    FROM documents""")(
    lambda s, d: I.table(s, d, "documents").select("doc_id", SP.code_article(F.concat(F.lit("https://x/y."), F.when(F.col("doc_id") % 2 == 0, "rs").otherwise("zig")), F.col("text"), 10, 30).alias("c")).select("doc_id", "c.language", F.md5(F.col("c.content").cast("binary")).alias("content"), "c.line_count")
)
register("src10_default_branch", """SELECT user_id, count(*) AS n, nullif(CASE WHEN user_id % 3 = 0 THEN ''
    WHEN user_id % 3 = 1 THEN 'b' || user_id END, '') AS branch FROM events GROUP BY user_id""")(
    lambda s, d: I.table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", "n", SP.default_branch(F.when(F.col("user_id") % 3 == 0, F.lit('{"default_branch":""}')).when(F.col("user_id") % 3 == 1, F.concat(F.lit('{"default_branch":"b'), F.col("user_id"), F.lit('"}'))).otherwise("{}")).alias("branch"))
)
README_DEFAULT = "CASE repo % 4 WHEN 1 THEN 'dev' WHEN 2 THEN 'master' WHEN 3 THEN '' END"
README_FOUND = "CASE repo % 3 WHEN 0 THEN array('dev', 'main', 'master') WHEN 1 THEN array('master') ELSE array('main', 'master') END"
register("src9_readme", """SELECT repo, CASE WHEN repo % 4 = 1 AND repo % 3 = 0 THEN 'dev' WHEN repo % 4 = 2 OR repo % 3 = 1 THEN 'master' ELSE 'main' END AS branch FROM (SELECT DISTINCT user_id AS repo FROM events)""")(
    lambda s, d: SP.first_readme(
        SP.readme_candidates(repos(s, d).withColumn("default_branch", F.expr(README_DEFAULT))),
        repos(s, d).select("repo", F.explode(F.expr(README_FOUND)).alias("branch"), F.lit("text").alias("content")),
    ).select("repo", "branch")
)


def repos(spark: SparkSession, sf: str) -> DataFrame:
    return I.table(spark, sf, "events").select(F.col("user_id").alias("repo")).distinct()


register("src6_arxiv_backfill", """SELECT page_id, 'https://arxiv.org/pdf/' || page_id AS pdf_url, CASE
    WHEN page_id % 2 = 0 THEN 'pdf title'
    ELSE regexp_extract(html, '(?s)<title>(.*?)</title>', 1) END AS title FROM pages""")(
    lambda s, d: SP.backfill(
        I.table(s, d, "pages").select("page_id", SP.arxiv_pdf_url(F.concat(F.lit("https://arxiv.org/abs/"), F.col("page_id"))).alias("pdf_url"), F.when(F.col("page_id") % 2 == 0, "pdf title").alias("title")),
        I.table(s, d, "pages").select("page_id", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title")), "page_id", ["title"],
    )
)
register("src14_bing_unwrap", "SELECT page_id, url AS target FROM pages")(
    lambda s, d: I.table(s, d, "pages").select("page_id", U.unwrap_bing_redirect(F.concat(F.lit("https://www.bing.com/ck/a?x=1&u=a1"), F.translate(F.regexp_replace(F.base64(F.col("url").cast("binary")), "=|\r\n", ""), "+/", "-_"))).alias("target"))
)
register("src16_empty_retry", """SELECT CAST(seq AS BIGINT) AS query, CASE WHEN event_type = 'click' THEN 1
    ELSE 0 END AS attempt FROM (SELECT event_id AS seq, event_type FROM events)""")(
    lambda s, d: SP.with_retry(calls(s, d).select(F.col("seq").alias("query"), F.lit(0).alias("attempt"), "hits").unionByName(calls(s, d).select(F.col("seq").alias("query"), F.lit(1).alias("attempt"), F.lit(5).alias("hits")))).select("query", "attempt")
)
register("src3_web_pages")(lambda s, d: PG.extract_pages(I.table(s, d, "pages")).select("page_id", "title", "error", "source.domain_authority", "source.language", "total_length", "score", "is_ok", F.size("sections").alias("n_sections"), F.array_join("reasons", ",").alias("reasons")))
