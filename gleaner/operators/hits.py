"""Search hits as DataFrames: filter, dedup, map, rank, select, cover.

A hit has ``ord`` (its place in the input; order is part of the data), ``query``,
``title``, ``url``, ``snippet``, ``engine`` and ``score``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from gleaner.functions import text as T
from gleaner.functions import url as U


def keep_hit() -> Column:
    """Hits worth keeping: no wrappers, highlights, foreign scripts, dictionary or junk pages, blank titles or snippets."""
    title, url, snippet = F.col("title"), F.col("url"), F.col("snippet")
    return ~(
        U.is_fragment_url(url) | U.is_translate_wrapper(url) | U.has_non_latin_script(title) | U.has_non_latin_script(snippet)
        | U.is_dictionary_junk(url, title, snippet) | U.is_junk_url(url) | T.is_blank(title) | T.is_blank(snippet)
    )


def filter_hits(hits: DataFrame) -> DataFrame:
    return hits.where(keep_hit())


def first_by(hits: DataFrame, key: Column, *within: str) -> DataFrame:
    """First row of each key by ``ord``, found by aggregation, so that a hot key is combined before it moves."""
    columns = hits.columns
    keyed = hits.withColumn("__key", key)
    best = keyed.groupBy("__key", *within).agg(F.min_by(F.struct(*columns), "ord").alias("__row"))
    return best.select("__row.*")


def dedup_by_key(hits: DataFrame, *within: str) -> DataFrame:
    """First hit of each canonical address."""
    return first_by(hits, U.dedup_key(F.col("url")), *within)


def dedup_two_keys(hits: DataFrame, *within: str) -> DataFrame:
    """First of each address, then of these the first of each title.

    The same as keeping a hit iff both its address and its title are new: a
    title enters the seen set only with a hit whose address is new.
    """
    return first_by(dedup_by_key(hits, *within), T.normalize_title(F.col("title")), *within)


def map_hits(hits: DataFrame, mode: str = "hybrid") -> DataFrame:
    """Filter, dedup and number the hits of each query; a score of 0 or less becomes 1 / position."""
    kept = dedup_two_keys(filter_hits(hits), "query")
    place = F.row_number().over(Window.partitionBy("query").orderBy("ord"))
    url = F.col("url")
    return kept.withColumn("position", place).select(
        "ord", "query", T.collapse(F.col("title")).alias("title"), "url", T.collapse(F.col("snippet")).alias("snippet"), "position", "engine",
        F.when(F.col("score") <= 0, 1.0 / F.col("position")).otherwise(F.col("score")).alias("score"),
        T.round_score(U.domain_authority(U.host(url))).alias("domain_authority"), U.source_type(url).alias("source_type"), F.lit(mode).alias("mode"),
    )


def post_process(hits: DataFrame) -> DataFrame:
    """Hits scraped from a result page: four filters, dedup by address, clean texts, new positions."""
    url = F.col("url")
    kept = dedup_by_key(hits.where(~(U.is_fragment_url(url) | U.is_translate_wrapper(url) | U.is_junk_url(url) | T.is_blank(F.col("snippet")))), "query")
    place = F.row_number().over(Window.partitionBy("query").orderBy("ord"))
    return kept.select("ord", "query", T.clean_title(F.col("title")).alias("title"), "url", T.clean_snippet(F.col("snippet")).alias("snippet"), place.alias("position"))


# --- ranking ------------------------------------------------------------------
# Each gives a sort key: ``rank_key`` columns that, with ``ord``, order the rows.
# Ranks over everything would need one task; the keys leave that to a range sort.


def rank_serp(hits: DataFrame) -> DataFrame:
    """Round robin over queries in the order of their first hits: (turn, first_ord)."""
    per_query = Window.partitionBy("query")
    return hits.select("*", F.row_number().over(per_query.orderBy("ord")).alias("turn"), F.min("ord").over(per_query).alias("first_ord"))


def rank_composite(hits: DataFrame) -> DataFrame:
    """``rank_score``: half authority, three tenths snippet bytes over the longest, two tenths over the address's count.

    Hits without an address count as one address; without a snippet, as an empty one.
    """
    longest = hits.agg(F.max(F.octet_length("snippet")).alias("longest"))
    keyed = address_counts(hits).crossJoin(F.broadcast(longest))  # one row
    share = F.when(F.col("longest") > 0, F.coalesce(F.octet_length("snippet"), F.lit(0)) / F.col("longest")).otherwise(0.0)
    score = F.lit(0.5) * F.col("domain_authority") + F.lit(0.3) * share + F.lit(0.2) * (F.lit(1.0) / F.col("times"))
    return keyed.withColumn("rank_score", score).drop("times", "longest")


def place(hits: DataFrame, strategy: str) -> DataFrame:
    """Hits with ``place``, a struct whose order is the strategy's: serp, authority, snippet or composite.

    A key computed row by row, so it is the same wherever it is computed again; a
    rank would need a sort of everything.
    """
    if strategy == "serp":
        keyed, keys = rank_serp(hits), ["turn", "first_ord"]
    elif strategy == "authority":
        keyed, keys = hits, [(-F.col("domain_authority")).alias("key"), "ord"]
    elif strategy == "snippet":
        keyed, keys = hits, [(-F.coalesce(F.octet_length("snippet"), F.lit(0))).alias("key"), "ord"]
    elif strategy == "composite":
        keyed, keys = rank_composite(hits), [(-F.col("rank_score")).alias("key"), "ord"]
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return keyed.withColumn("place", F.struct(*keys)).select(*hits.columns, "place")


def rank(hits: DataFrame, strategy: str) -> DataFrame:
    """All hits in a strategy's order."""
    return place(hits, strategy).orderBy("place").drop("place")


# --- selection ----------------------------------------------------------------


def select_candidates(ranked: DataFrame, most: int, cap: int = 2) -> DataFrame:
    """Rows to follow: no junk, first of each address, then one a query in turn, at most ``cap`` a site.

    ``ranked`` carries ``place``, its rank or a key that orders like it.  Everything is taken, without a cap, if
    it fits.  The greedy turns are sequential, so one task takes them, over rows
    that can matter.  Of each site a query can use its best ``cap`` rows.  Before
    any pick of a query come at most ``most`` rows already taken and ``cap`` rows
    of each of at most ``most`` / ``cap`` full sites.  As long as a site isn't full,
    each query with a row of it takes one in its turn, so only the first ``most``
    of its queries, in order, can use it: its first ``cap`` * ``most`` rows.  Of the
    queries left, those whose sites are all full in the first turn are at most
    ``most`` * ``most``, and ``most`` others end it.
    """
    if most <= 0:
        return ranked.limit(0)
    url = F.col("url")
    clean = ranked.where(~U.is_junk_url(url) & ~U.is_junk_title(F.col("title")))
    columns = clean.columns
    clean = clean.groupBy(U.dedup_key(url).alias("__key")).agg(F.min_by(F.struct(*columns), "place").alias("__row")).select("__row.*")
    if clean.limit(most + 1).count() <= most:
        return clean.withColumn("turn", F.row_number().over(Window.orderBy("place")))
    sited = clean.withColumn("__site", F.coalesce(U.registered_domain(url), F.lit("")))
    bounded = sited.withColumn("__nth", F.row_number().over(Window.partitionBy("query", "__site").orderBy("place"))).where(F.col("__nth") <= cap)
    bounded = bounded.withColumn("__of_query", F.row_number().over(Window.partitionBy("query").orderBy("place"))).where(F.col("__of_query") <= cap * (most // cap) + most)
    bounded = bounded.withColumn("__first", F.min("place").over(Window.partitionBy("query")))
    bounded = bounded.withColumn("__of_site", F.row_number().over(Window.partitionBy("__site").orderBy("__first", "place"))).where(F.col("__of_site") <= cap * most)
    rows = most * (most + 1) * (cap * (most // cap) + most)  # of the queries that matter, which come first
    if rows < 1 << 31:  # as many as limit() takes
        bounded = bounded.orderBy("__first", "place").limit(rows)

    def greedy(rows):
        plain = lambda x: tuple(x.values()) if isinstance(x, dict) else tuple(x) if isinstance(x, (tuple, list)) else x
        rows = rows.assign(__first=rows["__first"].map(plain), __place=rows["place"].map(plain)).sort_values(["__first", "__place"], kind="stable")
        site_of, waiting = rows["__site"].to_dict(), [iter(list(g.index)) for _, g in rows.groupby("__first", sort=True)]
        taken, sites = [], {}
        while waiting and len(taken) < most:
            left = []
            for mine in waiting:
                if len(taken) >= most:
                    break
                at = next((i for i in mine if sites.get(site_of[i], 0) < cap), None)  # a full site stays full
                if at is not None:
                    sites[site_of[at]] = sites.get(site_of[at], 0) + 1
                    taken.append(at)
                    left.append(mine)
            waiting = left
        out = rows.loc[taken, columns].copy()
        out["turn"] = range(1, len(taken) + 1)
        return out

    schema = StructType([*clean.schema.fields, StructField("turn", IntegerType())])
    return bounded.withColumn("__run", F.lit(0)).groupBy("__run").applyInPandas(lambda rows: greedy(rows), schema)


def take(hits: DataFrame, count: int) -> DataFrame:
    """The first hits of each query, ``count`` at most; Spark cuts each partition before the exchange."""
    return hits.withColumn("__n", F.row_number().over(Window.partitionBy("query").orderBy("ord"))).where(F.col("__n") <= count).drop("__n")


def union(*parts: DataFrame) -> DataFrame:
    """All hits of several searches, repeated ones included."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def address_counts(hits: DataFrame) -> DataFrame:
    """Hits with ``times``, how many share their address; counted before they move, so a hot address is no task's load."""
    key = U.dedup_key(F.col("url"))
    counts = hits.groupBy(key.alias("__counted")).agg(F.count("*").alias("times"))
    return hits.withColumn("__key", key).join(counts, F.col("__key").eqNullSafe(F.col("__counted"))).drop("__key", "__counted")


def longest_snippet(hits: DataFrame) -> DataFrame:
    """Bytes of the longest snippet, one row; 1 where there is none."""
    return hits.agg(F.coalesce(F.max(F.octet_length("snippet")), F.lit(1)).cast("long").alias("longest"))


def char_histogram(texts: DataFrame, column: str = "text") -> DataFrame:
    """How often each character occurs in a column: (letter, n)."""
    return texts.select(F.explode(F.filter(F.split(column, ""), lambda c: c != "")).alias("letter")).groupBy("letter").agg(F.count("*").alias("n"))


# --- coverage -----------------------------------------------------------------


def coverage(followed: DataFrame) -> DataFrame:
    """Hits of each query, and how many of them have a body."""
    return followed.groupBy("query").agg(F.count("*").alias("total_hits"), F.count_if(F.col("body_status") == "Ok").alias("followed_ok"), F.count_if(F.col("body_status") != "Ok").alias("followed_failed"))


def unique_sources(followed: DataFrame) -> DataFrame:
    return followed.agg(F.countDistinct(U.registered_domain(F.col("url_canonical"))).alias("unique_sources"))


def run_summary(followed: DataFrame, total_queries: int) -> DataFrame:
    """One row, for an empty run as well."""
    return followed.agg(F.lit(total_queries).cast("long").alias("total_queries"), F.count("*").alias("total_results"), F.countDistinct(U.registered_domain(F.col("url_canonical"))).alias("unique_sources_followed"))


def warnings(followed: DataFrame) -> DataFrame:
    """(kind, query): one site only, queries without a body, nothing but snippets.

    ``all_snippet_only`` compares rows without a body to rows that are no PDF, as
    the stated rule has it; ``all_snippet_only_strict`` is the sound form.
    """
    sites = followed.agg(F.countDistinct(U.registered_domain(F.col("url_canonical"))).alias("sites"), F.count("*").alias("rows"))
    one_site = sites.where("sites <= 1 AND rows > 1").select(F.lit("collapsed_to_one_site").alias("kind"), F.lit(None).cast("string").alias("query"))
    no_body = coverage(followed).where("followed_ok = 0 AND total_hits > 0").select(F.lit("no_body_for_query").alias("kind"), "query")
    status = F.col("body_status")
    counts = followed.agg(F.count_if(status != "PdfUnextracted").alias("non_pdf"), F.count_if(status != "Ok").alias("not_ok"), F.count_if(status == "Ok").alias("ok"))
    loose = counts.where("non_pdf > 0 AND not_ok = non_pdf").select(F.lit("all_snippet_only").alias("kind"), F.lit(None).cast("string").alias("query"))
    strict = counts.where("non_pdf > 0 AND ok = 0").select(F.lit("all_snippet_only_strict").alias("kind"), F.lit(None).cast("string").alias("query"))
    return one_site.unionByName(no_body).unionByName(loose).unionByName(strict)


def winning_engine(hits: DataFrame) -> DataFrame:
    """The engine of all of a query's hits, null where there are several."""
    return hits.groupBy("query").agg(F.when(F.min("engine") == F.max("engine"), F.min("engine")).alias("engine"))


def without_blocked(hits: DataFrame, blocked: DataFrame) -> DataFrame:
    """Hits whose host isn't blocked (``blocked``: host)."""
    return hits.withColumn("host", U.host(F.col("url"))).join(blocked, "host", "left_anti")
