"""Registered queries of envelopes, frames, job validation and admission."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import jobs as JB
from gleaner.plans import inputs as I
from gleaner.plans import oracle as O
from gleaner.plans.catalog import register
from gleaner.sinks import frames as FR

CONV_JSON = "CAST(to_json({'role': role, 'text': text}) AS VARCHAR)"
data = lambda: F.to_json(F.struct("role", "text"))
register("snk1_envelope", f"""SELECT conv_id, turn, md5(CASE WHEN turn % 3 = 0 THEN '{{\"status\":\"error\",\"data\":null,\"error\":' || CAST(to_json({{'code': 'captcha', 'detail': role}}) AS VARCHAR) || '}}'
    ELSE '{{\"status\":\"ok\",\"data\":' || {CONV_JSON} || ',\"error\":null}}' END) AS envelope
    FROM conversations""")(
    lambda s, d: I.table(s, d, "conversations").select("conv_id", "turn", F.md5(F.when(F.col("turn") % 3 == 0, FR.error_envelope(F.lit("captcha"), F.col("role"))).otherwise(FR.ok_envelope(data())).cast("binary")).alias("envelope"))
)
register("snk3_json_lines", f"SELECT md5({CONV_JSON}) AS line, count(*) AS n FROM conversations GROUP BY 1")(
    lambda s, d: FR.json_lines(I.table(s, d, "conversations").select("role", "text")).groupBy(F.md5(F.col("value").cast("binary")).alias("line")).agg(F.count("*").alias("n"))
)
register("snk2_pretty_json", """SELECT conv_id, turn, '{' || chr(10) || '  \"role\" : ' || CAST(to_json(role) AS VARCHAR) || ',' || chr(10) || '  \"text\" : ' || CAST(to_json(text) AS VARCHAR) || chr(10) || '}' AS json
    FROM conversations""")(lambda s, d: I.table(s, d, "conversations").select("conv_id", "turn", FR.pretty(F.struct("role", "text")).alias("json")))
register("snk4_text", f"""SELECT conv_id, turn, 'role: ' || role || chr(10) || 'text: ' || CASE
    WHEN strlen(text) <= 200 THEN text ELSE {O.preview('text', 200)} || '...' END AS text
    FROM conversations""")(lambda s, d: I.table(s, d, "conversations").select("conv_id", "turn", FR.text_udf()(data()).alias("text")))
register("snk5_sse_frames", f"""SELECT conv_id, turn, md5('event:' || CASE role WHEN 'system' THEN 'job-started'
    WHEN 'user' THEN 'engine-event' ELSE 'result' END || chr(10) || 'data:' || {CONV_JSON} || chr(10) || chr(10)) AS frame
    FROM conversations""")(
    lambda s, d: I.table(s, d, "conversations").select("conv_id", "turn", F.md5(FR.sse_frame(FR.event_name(F.when(F.col("role") == "system", "JobStarted").when(F.col("role") == "user", "EngineEvent").otherwise("Result")), data()).cast("binary")).alias("frame"))
)
register("str2_collected", """WITH e AS (SELECT conv_id AS job, turn AS seq, CASE
    WHEN role = 'assistant' THEN 'result' WHEN turn = 4 THEN 'error' ELSE 'engine-event' END AS name
    FROM conversations) SELECT job, seq FROM e WHERE name = 'result' AND seq < coalesce((SELECT min(seq)
    FROM e x WHERE x.job = e.job AND x.name = 'error'), 1000000)""")(
    lambda s, d: _collected(s, d)
)


def _collected(spark: SparkSession, sf: str) -> DataFrame:
    from gleaner.streaming import state as ST

    name = F.when(F.col("role") == "assistant", "result").when(F.col("turn") == 4, "error").otherwise("engine-event")
    return ST.collected(I.table(spark, sf, "conversations").select(F.col("conv_id").alias("job"), F.col("turn").alias("seq"), name.alias("name"), F.col("text").alias("data"))).select("job", "seq")


JOBS_SQL = """SELECT o_orderkey AS job, CASE o_orderkey % 7 WHEN 0 THEN 'simple' WHEN 1 THEN 'parallel'
    WHEN 2 THEN 'harvest' WHEN 3 THEN 'extract' WHEN 4 THEN 'ax' WHEN 5 THEN 'pdf-url'
    ELSE 'pdf-file' END AS op, o_custkey, o_orderstatus, o_totalprice FROM orders"""


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.sql(JOBS_SQL.replace("FROM orders", "FROM {orders}"), orders=I.table(spark, sf, "orders"))
    text = F.when(F.col("op").isin("simple"), F.to_json(F.struct(F.when(F.col("o_custkey") % 9 != 0, F.lit(" rust ")).alias("query"), (F.col("o_custkey") % 120).alias("count"))))
    text = text.when(F.col("op").isin("parallel", "harvest"), F.to_json(F.struct(F.transform(F.sequence(F.lit(1), (F.col("o_custkey") % 18 + 1).cast("int")), lambda i: F.concat(F.lit("q"), i)).alias("queries"), F.when(F.col("o_orderstatus") == "F", "Bing").when(F.col("o_orderstatus") == "P", "yahoo").alias("engine"))))
    text = text.when(F.col("op") == "pdf-file", F.to_json(F.struct(F.when(F.col("o_custkey") % 4 != 0, "/x.pdf").alias("path"))))
    text = text.otherwise(F.to_json(F.struct(F.when(F.col("o_custkey") % 5 == 0, "ftp://x").otherwise("https://x").alias("url"), (F.col("o_custkey") % 3).alias("max_chars"))))
    return rows.select("job", "op", F.from_json(text, JB.ARGS).alias("a"), "o_custkey")


PROBLEM = """CASE WHEN op = 'simple' AND NOT o_custkey % 120 BETWEEN 1 AND 100 THEN 'count out of range' WHEN op IN ('parallel', 'harvest') AND o_orderstatus = 'P' THEN 'unknown engine'
  WHEN op = 'simple' AND o_custkey % 9 = 0 THEN 'query is missing' WHEN op IN ('parallel', 'harvest') AND o_custkey % 18 + 1 > 16 THEN 'too many queries'
  WHEN op = 'extract' AND o_custkey % 3 = 0 THEN 'max_chars must be positive' WHEN op IN ('extract', 'ax', 'pdf-url') AND o_custkey % 5 = 0 THEN 'url must be http or https' WHEN op = 'pdf-file' AND o_custkey % 4 = 0 THEN 'path is missing' END"""
register("job1_validate", f"SELECT job, op, {PROBLEM} AS problem FROM ({JOBS_SQL})")(
    lambda s, d: jobs(s, d).select("job", "op", JB.problem(F.col("op"), F.col("a")).alias("problem"))
)
register("job2_timeout", """SELECT job, least(CASE WHEN o_custkey % 200000 > 700 THEN o_custkey % 200000
    ELSE CASE op WHEN 'simple' THEN 10000 WHEN 'parallel' THEN 20000 WHEN 'harvest' THEN 45000
    WHEN 'pdf-file' THEN 15000 ELSE 30000 END END, 120000) AS timeout_ms FROM (""" + JOBS_SQL + ")")(
    lambda s, d: jobs(s, d).select("job", JB.timeout_ms(F.col("op"), F.when(F.col("o_custkey") % 200000 > 700, F.col("o_custkey") % 200000).otherwise(F.lit(0))).cast("long").alias("timeout_ms"))
)
register("job3_targets", f"""WITH j AS (SELECT * FROM ({JOBS_SQL}) WHERE ({PROBLEM}) IS NULL)
    SELECT job, CAST(i - 1 AS INTEGER) AS place, CASE WHEN op = 'simple' THEN 'rust'
    ELSE 'q' || i END AS query FROM (SELECT *, unnest(range(1, CASE WHEN op = 'simple' THEN 2
    WHEN op IN ('parallel', 'harvest') THEN o_custkey % 18 + 2 ELSE 1 END)) AS i FROM j)""")(
    lambda s, d: JB.targets(jobs(s, d).where(JB.problem(F.col("op"), F.col("a")).isNull())).select("job", F.col("at").alias("place"), "query")
)
ADMITTED = f"""j AS (SELECT job, 'trace-' || (o_custkey % 400) AS trace_id, {PROBLEM} AS problem, CASE WHEN op = 'simple' THEN 'auto' ELSE 'bing' END AS engine FROM ({JOBS_SQL})),
  m AS (SELECT *, row_number() OVER (PARTITION BY trace_id, problem IS NULL ORDER BY job) AS n FROM j),
  r AS (SELECT *, CASE WHEN problem IS NULL AND n = 1 THEN row_number() OVER (PARTITION BY problem IS NULL AND n = 1 ORDER BY job) END AS q FROM m),
  x AS (SELECT job, trace_id, CASE WHEN problem IS NOT NULL THEN 400 WHEN n > 1 THEN 409 WHEN q > 256 THEN 429 ELSE 202 END AS status, CASE WHEN problem IS NOT NULL THEN 'invalid-input' WHEN n > 1 THEN 'duplicate_trace_id' WHEN q > 256 THEN 'rate-limited' ELSE 'accepted' END AS code FROM r)"""


def admitted(spark: SparkSession, sf: str) -> DataFrame:
    found = jobs(spark, sf).select("job", F.concat(F.lit("trace-"), F.col("o_custkey") % 400).alias("trace_id"), JB.problem(F.col("op"), F.col("a")).alias("problem"), F.when(F.col("op") == "simple", "auto").otherwise("bing").alias("engine"))
    return JB.admit(found)


register("job5_admission", f"WITH {ADMITTED} SELECT job, trace_id, status, code FROM x")(admitted)
register("agg7_job_counters", f"WITH {ADMITTED} SELECT code, count(*) AS n FROM x GROUP BY code")(
    lambda s, d: admitted(s, d).groupBy("code").agg(F.count("*").alias("n"))
)
register("snk9_metrics", f"""WITH {ADMITTED}, n AS (SELECT count(*) FILTER (WHERE status = 202) AS a, count(*) FILTER (WHERE code = 'quota-exceeded') AS b, count(*) FILTER (WHERE code = 'duplicate_trace_id') AS c FROM x)
  SELECT '# HELP gleaner_jobs_submitted Jobs admitted.\n# TYPE gleaner_jobs_submitted counter\ngleaner_jobs_submitted ' || a || '\n# HELP gleaner_jobs_over_quota Jobs rejected over quota.\n# TYPE gleaner_jobs_over_quota counter\ngleaner_jobs_over_quota ' || b
    || '\n# HELP gleaner_jobs_duplicate Jobs rejected for a used trace id.\n# TYPE gleaner_jobs_duplicate counter\ngleaner_jobs_duplicate ' || c || '\n# HELP gleaner_queue_depth Jobs waiting.\n# TYPE gleaner_queue_depth gauge\ngleaner_queue_depth 0\n' AS value FROM n""")(
    lambda s, d: FR.metrics_text(admitted(s, d))
)
register("jn5_unique_traces", f"""SELECT min(job) AS job, 'trace-' || (o_custkey % 400) AS trace_id FROM ({JOBS_SQL})
    GROUP BY o_custkey % 400""")(lambda s, d: JB.unique_traces(jobs(s, d).select("job", F.concat(F.lit("trace-"), F.col("o_custkey") % 400).alias("trace_id"))))
register("job_needs_connection", f"SELECT op, count(*) AS n, op = 'ax' AS needs FROM ({JOBS_SQL}) GROUP BY op")(
    lambda s, d: jobs(s, d).groupBy("op").agg(F.count("*").alias("n"), F.max(JB.needs_connection(F.col("op"), F.col("a.engine"))).alias("needs"))
)
