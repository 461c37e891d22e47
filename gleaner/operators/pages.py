"""Captured pages to articles and followed bodies, and the harvest over hits and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import html as X
from gleaner.functions import quality as Q
from gleaner.functions import text as T
from gleaner.functions import url as U
from gleaner.operators import hits as H


#: Selected rows that may pass the driver.
LOCAL_ROWS = 1000


def extract_pages(pages: DataFrame, offset: int = 0, max_chars: int = 40_000) -> DataFrame:
    """Articles of (page_id, url, html); pages under 100 bytes or without text get the error Empty."""
    parsed = pages.withColumn("p", X.page_udf()(F.col("html"))).withColumn("s", X.sections_udf()(F.col("p.headings"), F.col("p.full_text")))
    text = F.col("p.full_text")
    parsed = Q.validate(parsed.withColumn("__part", T.slice_text(text, offset, max_chars)), "__part", "__")
    part, reasons = F.col("__part"), F.col("__reasons")
    empty = (F.octet_length("html") < 100) | T.is_blank(text)
    roots = F.size(F.filter("s", lambda s: s["parent"] == -1))
    score, bare = Q.page_score(F.col("__score"), roots)
    return parsed.select(
        "page_id", "url", F.col("p.title").alias("title"), F.when(empty, "Empty").alias("error"),
        F.struct(F.col("p.author").alias("author"), F.col("p.published").alias("published"), F.col("p.site_name").alias("site_name"), U.url_authority(F.col("url")).alias("domain_authority"), F.col("p.language").alias("language")).alias("source"),
        F.lit("Readability").alias("method"), part.alias("content"), F.octet_length(text).alias("total_length"), F.octet_length(part).alias("returned_length"),
        T.is_truncated(F.octet_length(text), offset, max_chars).alias("truncated"), F.col("s").alias("sections"),
        score.alias("score"), (score >= 0.5).alias("is_ok"), F.when(bare, F.array_append(reasons, F.lit("no_headings"))).otherwise(reasons).alias("reasons"), T.entropy(text).alias("entropy"),
        F.array_contains(Q.flags(text), "Paywall").alias("is_paywall"), F.lit(False).alias("is_bot_blocked"), Q.is_empty_shell(text).alias("is_empty_shell"),
    )


def page_signals(text: Column) -> Column:
    """Flags seen on a page before its text is extracted: only its first 2000 characters count."""
    return F.array_except(Q.flags(F.substring(text, 1, 2000)), F.array(F.lit("EmptyShell")))


def follow_json(answer: Column) -> Column:
    """Title, content and error of a follow answer's JSON; what it lacks is empty, also where it is no JSON."""
    parsed = F.from_json(answer, X.FOLLOW_SCHEMA)
    return F.struct(*[F.coalesce(parsed[c], F.lit("")).alias(c) for c in ("title", "content", "error")])


def follow_pages(pages: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """Followed bodies of (page_id, url, html): gate by reputation, extract, clean, flag.

    ``blocked``: hosts not to follow; the gate comes before the extraction.
    """
    rows = H.without_blocked(pages, blocked).drop("host") if blocked is not None else pages
    got = rows.withColumn("f", X.follow_udf()(F.col("html")))
    content = T.strip_leading_title(T.strip_boilerplate(F.col("f.content")), F.col("f.title"))
    return got.select("page_id", "url", F.col("f.title").alias("title"), content.alias("content"), F.col("f.error").alias("error")).withColumn("flags", Q.flags(F.col("content")))


def harvest(hits: DataFrame, pages: DataFrame, most: int = 8, strategy: str = "composite") -> DataFrame:
    """Dedup, rank and select hits, follow the selected ones in the captured pages, judge the bodies.

    PDF and paper addresses aren't followed (PdfUnextracted); hits without a
    captured page stay SnippetOnly.
    """
    first = H.dedup_by_key(hits)
    if "domain_authority" not in first.columns:
        first = first.withColumn("domain_authority", U.domain_authority(U.host(F.col("url"))))
    picked = H.select_candidates(H.place(first, strategy), most).drop("place")
    if most <= LOCAL_ROWS:  # so few rows that they are taken once and planned as they are
        picked = hits.sparkSession.createDataFrame(picked.collect(), picked.schema)
    chosen = picked.withColumn("url_canonical", U.dedup_key(F.col("url")))
    unread = U.is_pdf_url(F.col("url")) | U.is_arxiv_url(F.col("url"))
    wanted = chosen.where(~unread).select("url_canonical").distinct()
    wanted = F.broadcast(wanted) if most <= LOCAL_ROWS else wanted
    captured = pages.withColumn("url_canonical", U.dedup_key(F.col("url"))).join(wanted, "url_canonical")
    bodies = follow_pages(captured.groupBy("url_canonical").agg(F.min_by(F.struct("page_id", "url", "html"), "page_id").alias("x")).select("x.*"))
    bodies = Q.judge_body(bodies.withColumn("url_canonical", U.dedup_key(F.col("url"))), "content", "flags")
    joined = chosen.join(bodies.drop("url", "title", "page_id"), "url_canonical", "left")
    # after the join: two Python functions in one chain of projections would be merged, with all that lies between repeated
    joined = joined.withColumn("sections", F.when(F.col("content").isNotNull(), X.plain_sections_udf()(F.col("content"))))
    status = F.when(unread, "PdfUnextracted").when(F.col("content").isNull(), "SnippetOnly").otherwise(Q.body_status(F.col("content"), F.col("error"), F.col("q_is_ok"), F.col("q_reasons")))
    return joined.select("turn", "ord", "query", "url", "url_canonical", "content", "error", "flags", F.col("q_score").alias("quality"), F.col("q_reasons").alias("reasons"), F.size("sections").alias("n_sections"), status.alias("body_status"))
