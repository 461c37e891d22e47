"""Mixing sources to target weights by Poisson replication, on DataFrame operations alone.

A source's documents repeat at the mean rate that brings it to its target share.
Each document's number of copies is the Poisson quantile, at that rate, of a
uniform number hashed from the seed and its id; copies are exploded and all rows
are put in the order of a second hash, one global shuffle.  Cumulative
probabilities are made once a source; a document finds its count in them by
binary search.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.tables import Scratch, bound, count_passed

#: Rates above this are drawn as sums of draws at most this large, so that exp(-rate) stays far from 0.
_PIECE = 32.0
#: Copies a single draw can give, a power of 2; the chance of more at a rate of 32 is below 1e-30.
_MOST = 128
#: Sources whose probabilities are broadcast (1 KB each); more are joined by an exchange.
BROADCAST_SOURCES = 1 << 14


def hashed(*parts: Column) -> Column:
    """52 bits of an md5 over the parts, as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]).cast("binary")), 1, 13), 16, 10).cast("long")


def cumulative(rate: Column) -> Column:
    """Poisson probabilities of at most 0, 1, 2, ... at ``rate``, as an array."""
    first = F.exp(-rate)
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all"))

    def step(s: Column, i: Column) -> Column:
        p = s["p"] * rate / i
        return F.struct(p.alias("p"), (s["c"] + p).alias("c"), F.array_append(s["all"], s["c"] + p).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(_MOST - 1)), start, step, lambda s: s["all"])


def mix_sources(docs: DataFrame, weights: dict[str, float] | DataFrame | None = None, size: float = 1.0, seed: int = 1, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Replicate documents so that sources have their target shares, in a global random order.

    ``weights``: target share of each source, a dict or a table (name, weight), on
    any scale; a source left out gets none; None: equal shares.  ``size``: expected output rows as a share of the
    input's.  Returns the input's columns plus ``copies`` and ``copy`` (int; the
    copy's number from 1) and ``order_key`` (long, ascending in the output), which
    replace input columns of these names.  A document drawn 0 times is left out:
    that is the sampling.  Nulls are a source of their own (None in ``weights``).
    Repeated rows draw alike, as the draw depends on the id; null ids draw as
    the id "null".  An empty table gives an empty table.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    names = ["copies", "copy", "order_key"]
    columns = [c for c in docs.columns if c not in names]
    found = docs.groupBy(F.col(source_col).alias("__source")).agg(F.count("*").alias("rows"))
    if weights is None:
        found = found.withColumn("weight", F.lit(1.0))
    else:
        if isinstance(weights, dict):
            weights = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "name string, weight double")
        wanted = weights.select(F.col("name").cast("string").alias("name"), F.col("weight").cast("double").alias("weight"))
        found = found.join(wanted, F.col("__source").cast("string").eqNullSafe(F.col("name")), "left").select("__source", "rows", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    found = scratch.save(found, "sources")
    whole = found.agg(F.sum("rows").alias("rows"), F.sum("weight").alias("weight"), F.count("*").alias("n")).first()
    if whole.weight is not None and not whole.weight > 0:
        raise ValueError("no source of the table has a positive weight")
    rates = found.select("__source", (F.lit(float(whole.rows or 0) * size) * F.col("weight") / F.lit(whole.weight or 1.0) / F.col("rows")).alias("rate"))
    rates = rates.withColumn("__draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / _PIECE)).cast("int"))
    rates = scratch.save(rates.select("__source", "__draws", cumulative(F.col("rate") / F.col("__draws")).alias("__chances")), "rates")
    scratch.drop("sources")
    if whole.n <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    rated = docs.select(*columns).join(rates, F.col(source_col).eqNullSafe(F.col("__source")))
    uniform = lambda i: hashed(F.lit(seed), F.col(id_col), i) / F.lit(float(1 << 52))
    drawn = rated.withColumn("__first", bound(uniform(F.lit(1)), lambda u: count_passed(lambda place: F.col("__chances")[place - 1], _MOST, lambda c: c <= u)))
    # further draws, for rates above ``_PIECE`` alone
    more = F.aggregate(F.sequence(F.lit(2), F.col("__draws")), F.lit(0), lambda s, i: s + F.size(F.filter("__chances", lambda c: c <= uniform(i))))
    drawn = drawn.withColumn("copies", F.col("__first") + F.when(F.col("__draws") > 1, more).otherwise(0))
    copied = drawn.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return copied.withColumn("order_key", hashed(F.lit(f"{seed} order"), F.col(id_col), F.col("copy"))).select(*columns, *names).orderBy("order_key")


def mix_oracle(seed: int, weight: str = "1") -> str:
    """DuckDB SQL of ``mix_sources`` with an SQL expression of ``source`` as its weight, for rates up to ``_PIECE``."""
    bits = "CAST('0x' || substr(md5({}), 1, 13) AS BIGINT)"
    return f"""
    WITH weighed AS (SELECT source, count(*) AS n, CAST({weight} AS DOUBLE) AS weight FROM documents GROUP BY source),
    rates AS (SELECT source, (SELECT count(*) FROM documents) * weight / (SELECT sum(weight) FROM weighed) / n AS rate FROM weighed),
    steps AS (SELECT source, rate, i, exp(-rate + i * ln(rate) - lgamma(i + 1)) AS p FROM rates, range(0, {_MOST}) r(i)),
    cdf AS (SELECT source, i, sum(p) OVER (PARTITION BY source ORDER BY i) AS c FROM steps),
    drawn AS (
      SELECT d.doc_id, d.source, (
        SELECT count(*) FROM cdf WHERE cdf.source = d.source AND cdf.c <= {bits.format(f"'{seed}:' || d.doc_id || ':1'")} / 4503599627370496.0) AS copies
      FROM documents d)
    SELECT doc_id, source, CAST(copies AS INTEGER) AS copies, CAST(copy AS INTEGER) AS copy, {bits.format(f"'{seed} order:' || doc_id || ':' || copy")} AS order_key
    FROM (SELECT *, unnest(range(1, copies + 1)) AS copy FROM drawn)"""
