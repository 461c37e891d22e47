"""Jobs: validation, time budgets, targets, admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as T

# Operations, their strategies and budgets in milliseconds, limits and defaults.
BUDGET_MS = {"simple": 10_000, "parallel": 20_000, "harvest": 45_000, "extract": 30_000, "ax": 30_000, "pdf-url": 30_000, "pdf-file": 15_000}
STRATEGY = {"simple": "simple", "parallel": "parallel", "harvest": "harvest", "extract": "non-search", "ax": "non-search", "pdf-url": "non-search", "pdf-file": "non-search"}
ENGINES, CAP_MS, COUNT, FOLLOW_TOP, MAX_QUERIES = ["auto", "brave", "bing", "google"], 120_000, 5, 8, 16
ARGS = "query string, queries array<string>, count long, strategy string, engine string, follow_top long, url string, path string, max_chars long, freshness string, search_depth string"


def problem(op: Column, a: Column) -> Column:
    """What is wrong with a job's arguments (a struct of ``ARGS``); null if nothing; the first that fits."""
    strategy = F.coalesce(F.create_map(*[F.lit(x) for p in STRATEGY.items() for x in p])[op], F.lit("non-search"))
    count, top = F.coalesce(a["count"], F.lit(COUNT)), F.coalesce(a["follow_top"], F.lit(FOLLOW_TOP))
    query = F.nullif(T.trim(a["query"]), F.lit(""))
    queries = F.filter(F.transform(F.coalesce(a["queries"], F.array().cast("array<string>")), lambda q: T.trim(q)), lambda q: q != "")
    url, path = F.nullif(T.trim(a["url"]), F.lit("")), F.nullif(T.trim(a["path"]), F.lit(""))
    fresh, depth = T.trim(a["freshness"]), T.trim(a["search_depth"])
    many = op.isin("parallel", "harvest")
    direct = op.isin("extract", "ax", "pdf-url", "pdf-file")
    return (
        F.when(a["strategy"].isNotNull() & ~a["strategy"].isin(*set(STRATEGY.values())), "unknown strategy")
        .when(a["strategy"].isNotNull() & (a["strategy"] != strategy), "strategy is not valid for the op")
        .when(~count.between(1, 100), "count out of range").when(~top.between(1, 50), "follow_top out of range")
        .when(a["engine"].isNotNull() & ~F.lower(a["engine"]).isin(ENGINES), "unknown engine")
        .when(fresh.isNotNull() & ~fresh.isin("day", "week", "month", "year") & ~fresh.rlike("^[0-9]+-[0-9]+-[0-9]+$"), "bad freshness")
        .when(depth.isNotNull() & ~depth.isin("basic", "advanced"), "bad search_depth")
        .when((op == "simple") & query.isNull(), "query is missing").when((op == "simple") & (F.size(queries) > 0), "queries are not accepted")
        .when(many & query.isNotNull(), "query is not accepted").when(many & (F.size(queries) == 0), "queries are missing").when(many & (F.size(queries) > MAX_QUERIES), "too many queries")
        .when(direct & (query.isNotNull() | (F.size(queries) > 0)), "query is not accepted")
        .when((op == "extract") & (a["max_chars"] == 0), "max_chars must be positive")
        .when(op.isin("extract", "ax", "pdf-url") & url.isNull(), "url is missing").when(op.isin("extract", "ax", "pdf-url") & ~url.rlike("^https?://"), "url must be http or https")
        .when((op == "pdf-file") & path.isNull(), "path is missing").when(~op.isin(*BUDGET_MS), "unknown op")
    )


def timeout_ms(op: Column, asked: Column) -> Column:
    own = F.create_map(*[F.lit(x) for p in BUDGET_MS.items() for x in p])[op]
    return F.least(F.when(asked > 0, asked).otherwise(own), F.lit(CAP_MS))


def needs_connection(op: Column, engine: Column) -> Column:
    return (op == "ax") | F.coalesce(F.lower(engine) == "google", F.lit(False))


def targets(jobs: DataFrame) -> DataFrame:
    """Searches of each valid job (job, op, a): one for ``simple``, one a query for ``parallel`` and ``harvest``."""
    listed = F.when(F.col("op") == "simple", F.array("a.query")).when(F.col("op").isin("parallel", "harvest"), F.col("a.queries")).otherwise(F.array().cast("array<string>"))
    trimmed = F.filter(F.transform(listed, lambda q: T.trim(q)), lambda q: q != "")
    return jobs.select("job", F.posexplode(trimmed).alias("at", "query"), F.coalesce("a.count", F.lit(COUNT)).alias("count"), F.coalesce(F.lower("a.engine"), F.lit("auto")).alias("engine"))


def admit(jobs: DataFrame, spend: int = 0, limit: int = 2000, capacity: int = 256, accepting: bool = True) -> DataFrame:
    """Status of each job (job, trace_id, problem, engine) in order of arrival.

    400 for bad arguments, 503 while closing, 429 over quota (automatic choice
    only), 409 for a trace id that an admitted job has, 429 for a full queue, else
    202.  The queue's room is counted over the first ``capacity`` jobs that pass.
    """
    passed = F.col("problem").isNull() & F.lit(accepting) & ~((F.col("engine") == "auto") & F.lit(spend >= limit))
    # conditions stay inside the aggregates: a filter would be pushed into the parsing and repeat it for every argument
    firsts = jobs.groupBy("trace_id").agg(F.min(F.when(passed, F.col("job"))).alias("first"))
    marked = jobs.join(firsts, "trace_id", "left").withColumn("twice", passed & (F.col("job") > F.coalesce("first", "job")))
    waiting = marked.select(F.when(passed & ~F.col("twice"), F.col("job")).alias("job"))
    room = waiting.orderBy(F.asc_nulls_last("job")).limit(capacity).agg(F.max("job").alias("last"), F.count("job").alias("n"))
    full = passed & (F.coalesce(F.col("n"), F.lit(0)) >= capacity) & (F.col("job") > F.col("last"))
    code = (
        F.when(F.col("problem").isNotNull(), F.struct(F.lit(400).alias("status"), F.lit("invalid-input").alias("code")))
        .when(F.lit(not accepting), F.struct(F.lit(503).alias("status"), F.lit("unavailable").alias("code"))).when(~passed, F.struct(F.lit(429).alias("status"), F.lit("quota-exceeded").alias("code")))
        .when(F.col("twice"), F.struct(F.lit(409).alias("status"), F.lit("duplicate_trace_id").alias("code"))).when(full, F.struct(F.lit(429).alias("status"), F.lit("rate-limited").alias("code")))
        .otherwise(F.struct(F.lit(202).alias("status"), F.lit("accepted").alias("code")))
    )
    return marked.crossJoin(F.broadcast(room)).select("job", "trace_id", code.alias("c")).select("job", "trace_id", "c.status", "c.code")  # one row of counts


def unique_traces(jobs: DataFrame) -> DataFrame:
    """First job of each trace id."""
    return jobs.groupBy("trace_id").agg(F.min_by(F.struct(*jobs.columns), "job").alias("x")).select("x.*")
