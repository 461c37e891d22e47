"""Captured answers of search engines as hit tables: RSS, JSON and status codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import quality as Q
from gleaner.functions import text as T

API_SCHEMA = "web struct<results: array<struct<title: string, url: string, description: string, score: double>>>"
TAVILY_SCHEMA = "results array<struct<title: string, url: string, content: string, score: double, published_date: string>>"


def rate_limit(status: Column, retry_after: Column) -> Column:
    """For a status of 429 the wait in seconds and whether the header makes no sense; else null."""
    seconds = F.expr("NULL") if retry_after is None else T.trim(retry_after).try_cast("long")
    return F.when(status == 429, F.struct(seconds.alias("retry_after_s"), (retry_after.isNotNull() & (seconds.isNull() | (seconds < 0))).alias("malformed")))


def status_error(status: Column, retry_after: Column) -> Column:
    """Error kind of an engine's status, null for success: with the wait in milliseconds where one is told."""
    seconds = T.trim(retry_after).try_cast("long")
    kind = F.when(status == 429, "RateLimited").when(status.isin(401, 403), "Unavailable").when((status < 200) | (status > 299), "Network")
    return F.struct(kind.alias("kind"), F.when((status == 429) & (seconds >= 0), seconds * 1000).alias("retry_after_ms"))


def fetch_error(status: Column) -> Column:
    return F.when(status == 429, "RateLimited").when((status < 200) | (status > 299), "Http")




def organic(answers: DataFrame, items: Column, count: int) -> DataFrame:
    """Rows of each answer's items (structs title, url, snippet, score, published_date).

    Trimmed; rows with a blank title or address are skipped; the first ``count``
    stay; a row's position is its place among all the items.
    """
    listed = answers.select("answer", F.posexplode(items).alias("at", "x"))
    rows = listed.select(
        "answer", (F.col("at") + 1).alias("position"), T.trim(F.col("x.title")).alias("title"), T.trim(F.col("x.url")).alias("url"),
        T.trim(F.coalesce(F.col("x.snippet"), F.lit(""))).alias("snippet"), F.coalesce("x.score", F.lit(0.0)).alias("score"), F.col("x.published_date").alias("published_date"),
    ).where("title != '' AND url != ''")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("answer").orderBy("position"))).where(F.col("n") <= count).drop("n")


def brave_api(answers: DataFrame, count: int) -> DataFrame:
    """Hits of (answer, body) in the first API's JSON."""
    parsed = F.from_json("body", API_SCHEMA)
    items = F.transform(parsed["web"]["results"], lambda x: F.struct(x["title"].alias("title"), x["url"].alias("url"), x["description"].alias("snippet"), x["score"].alias("score"), F.lit(None).cast("string").alias("published_date")))
    return organic(answers, items, count)


def tavily(answers: DataFrame, count: int) -> DataFrame:
    """Hits of (answer, body) in the second API's JSON."""
    parsed = F.from_json("body", TAVILY_SCHEMA)
    items = F.transform(parsed["results"], lambda x: F.struct(x["title"].alias("title"), x["url"].alias("url"), x["content"].alias("snippet"), x["score"].alias("score"), x["published_date"].alias("published_date")))
    return organic(answers, items, count)


def bing_rss(answers: DataFrame, count: int) -> DataFrame:
    """Hits of (answer, body) in RSS; items without a title or link are left out."""
    blocks = F.regexp_extract_all("body", F.lit(r"(?s)<item\b[^>]*>.*?</item>"), F.lit(0))
    part = lambda tag: F.regexp_extract("block", rf"(?s)<{tag}\b[^>]*>(.*?)</{tag}>", 1)
    rows = answers.select("answer", F.posexplode(blocks).alias("at", "block")).where(F.col("block").rlike(r"(?s)<title\b[^>]*>.*?</title>") & F.col("block").rlike(r"(?s)<link\b[^>]*>.*?</link>"))
    place = F.row_number().over(Window.partitionBy("answer").orderBy("at"))
    hits = rows.select("answer", place.alias("position"), T.clean_rss_text(part("title")).alias("title"), T.trim(part("link")).alias("url"), T.clean_rss_text(part("description")).alias("snippet"))
    return hits.where(F.col("position") <= count)


def rss_error(status: Column, body: Column) -> Column:
    """What an RSS answer's status or body means, null if it is a feed."""
    feed = body.contains("<rss") | body.contains("<channel")
    return F.when(status.isin(429, 403), "RateLimited").when(~feed & Q.has_block_markers(body), "Captcha").when(~feed, "Parse")


def github_route(url: Column) -> Column:
    """Where a GitHub address is read from: raw (with its address), readme (owner/repo) or web."""
    path = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    raw = F.replace(url, F.lit("github.com"), F.lit("raw.githubusercontent.com"))
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    kind = (
        F.when(path.rlike("/blob/|/tree/"), "raw").when(path.rlike(r"\.(diff|patch)$"), "raw").when(F.size(segments) == 2, "readme").otherwise("web")
    )
    target = (
        F.when(path.contains("/blob/"), F.replace(raw, F.lit("/blob/"), F.lit("/"))).when(path.contains("/tree/"), F.replace(raw, F.lit("/tree/"), F.lit("/")))
        .when(kind == "readme", F.array_join(segments, "/")).otherwise(url)
    )
    return F.struct(kind.alias("kind"), target.alias("target"))


def readme_candidates(repos: DataFrame) -> DataFrame:
    """Branches to try for (repo, default_branch): the default if it is known, then main, then master."""
    branches = F.array_compact(F.array(F.nullif("default_branch", F.lit("")), F.lit("main"), F.lit("master")))
    return repos.select("repo", F.posexplode(F.array_distinct(branches)).alias("try", "branch"))


def first_readme(candidates: DataFrame, found: DataFrame) -> DataFrame:
    """First branch of each repo whose file was captured (``found``: repo, branch, content)."""
    return candidates.join(found, ["repo", "branch"]).groupBy("repo").agg(F.min_by(F.struct("branch", "content"), "try").alias("x")).select("repo", "x.branch", "x.content")


def default_branch(body: Column) -> Column:
    return F.nullif(F.get_json_object(body, "$.default_branch"), F.lit(""))


def code_article(url: Column, text: Column, offset: int = 0, most: int = 40_000) -> Column:
    """A raw file as a code record."""
    from gleaner.functions import url as U

    return F.struct(U.detect_language(url).alias("language"), T.slice_text(text, offset, most).alias("content"), F.regexp_count(F.concat(F.regexp_replace(text, r"\n$", ""), F.lit("\n")), F.lit("\n")).alias("line_count"), F.lit(1.0).alias("confidence"))


def arxiv_pdf_url(url: Column) -> Column:
    """Where a paper's PDF is: its abstract's address with another path, or the address with one more part."""
    return F.when(url.contains("/abs/"), F.replace(url, F.lit("/abs/"), F.lit("/pdf/"))).when(url.contains("/pdf/"), url).otherwise(F.concat(F.regexp_replace(url, "/+$", ""), F.lit("/pdf")))


def arxiv_abstract_url(pdf_url: Column) -> Column:
    return F.regexp_replace(F.replace(pdf_url, F.lit("/pdf/"), F.lit("/abs/")), r"(\.pdf)+$", "")


def backfill(primary: DataFrame, other: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Fill a table's null columns from another by key."""
    renamed = other.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    return primary.join(renamed, key, "left").select(*[F.coalesce(c, f"__{c}").alias(c) if c in columns else c for c in primary.columns])


def with_retry(answers: DataFrame) -> DataFrame:
    """One answer of each query: an empty first one gives way to its retry (``attempt`` 0 and 1)."""
    return answers.groupBy("query").agg(F.min_by(F.struct(*[c for c in answers.columns if c != "query"]), F.struct((F.col("hits") == 0).alias("empty"), "attempt")).alias("x")).select("query", "x.*")
