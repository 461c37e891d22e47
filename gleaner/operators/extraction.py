"""Captured addresses to articles: each goes to the extractor that its address names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import html as X
from gleaner.functions import pdf as P
from gleaner.functions import text as T
from gleaner.functions import url as U
from gleaner.sources import serp as SP

# Names of the extraction methods.
METHODS = {"web": "Readability", "pdf": "Pdf", "arxiv": "ArxivOai", "github": "Raw"}


def extract(captured: DataFrame, offset: int = 0, max_chars: int = 40_000) -> DataFrame:
    """Articles of (page_id, url, html, content), ``html`` the page and ``content`` the bytes behind the address, either may be null.

    ``web`` reads the page; ``pdf`` the bytes; ``arxiv`` the bytes, with author,
    date, site and title filled from the abstract's page where they lack, and the
    page alone where the bytes are no readable PDF; ``github`` the page's text as a
    raw file or readme, other GitHub pages like any page.  Everything is read in
    one pass: an extractor gets null for rows that aren't its own.  ``error`` is
    Empty, Unsupported or Http (a PDF over the limit), else null.
    """
    kind = U.extractor_type(F.col("url"))
    route = SP.github_route(F.col("url"))
    rows = captured.withColumn("extractor", kind).withColumn("route", F.when(F.col("extractor") == "github", route["kind"]))
    raw = F.col("route").isin("raw", "readme")
    parsed = rows.withColumn("p", X.page_udf()(F.when(~F.coalesce(raw, F.lit(False)) & (F.col("extractor") != "pdf"), F.col("html"))))
    parsed = parsed.withColumn("d", P.record_udf()(F.when(F.col("extractor").isin("pdf", "arxiv"), F.col("content"))))
    parsed = parsed.withColumn("by_pdf", F.col("extractor").isin("pdf", "arxiv") & ((F.col("extractor") == "pdf") | F.col("d.error").isNull()))
    pdf, page = F.col("by_pdf"), F.col("p")
    filled = lambda own, other: F.when(pdf & (F.col("extractor") == "arxiv"), F.coalesce(own, other)).when(pdf, own).otherwise(other)
    text = F.when(pdf, F.col("d.text")).when(raw, F.col("html")).otherwise(page["full_text"])
    too_large = F.octet_length("content") > P.MAX_BYTES
    out = parsed.withColumn("text", F.coalesce(text, F.lit("")))
    error = F.when(pdf & too_large, "Http").when(pdf, F.col("d.error")).when(T.is_blank(F.col("text")), "Empty")
    return out.select(
        "page_id", "url", "extractor", F.when(raw | (F.col("extractor") != "github"), F.element_at(F.create_map(*[F.lit(x) for p in METHODS.items() for x in p]), F.col("extractor"))).otherwise(METHODS["web"]).alias("method"),
        filled(F.nullif(F.col("d.title"), F.lit("")), page["title"]).alias("title"), filled(F.col("d.author"), page["author"]).alias("author"), filled(T.pdf_date(F.col("d.creation_date")), page["published"]).alias("published"),
        F.when(raw, U.detect_language(F.col("url"))).alias("language"), error.alias("error"), T.slice_text(F.col("text"), offset, max_chars).alias("content"),
        F.octet_length("text").alias("total_length"), T.is_truncated(F.octet_length("text"), offset, max_chars).alias("truncated"),
    )
