"""Registered queries of searches as events, batches, job frames, queues, health and telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import runs as R
from gleaner.operators import state as S
from gleaner.plans import inputs as I
from gleaner.plans.catalog import MAPPED, register
from gleaner.plans.logs import CALLS, SNAP, calls, snap

# Four calls in a row are a request's attempts, three requests a job's searches.

EVENTS = f"""{CALLS}, attempts AS (SELECT seq // 4 AS request, seq, engine, outcome, hits FROM calls),
ends AS (SELECT request, min(seq) FILTER (WHERE outcome = 'Ok' AND hits > 0) AS served_at, bool_or(outcome <> 'Ok') AS failed FROM attempts GROUP BY request),
tried AS (SELECT a.*, served_at FROM attempts a JOIN ends USING (request) WHERE served_at IS NULL OR seq <= served_at),
told AS (SELECT request, seq, engine, CASE WHEN outcome = 'RateLimited' THEN ['RateLimited', 'Cooldown'] WHEN outcome = 'Captcha' THEN ['Captcha', 'Cooldown'] WHEN hits > 0 THEN [] ELSE ['Fallback'] END AS e FROM tried),
parts AS (
  SELECT request, 0 AS stage, 0 AS part, 0 AS sub, 'JobStarted' AS kind, NULL AS engine, NULL AS detail FROM ends
  UNION ALL SELECT request, 1, seq, i, 'EngineEvent', engine, e[i] FROM (SELECT *, unnest(range(1, len(e) + 1)) AS i FROM told)
  UNION ALL SELECT request, 2, p, 0, 'Result', engine, CAST(p AS VARCHAR) FROM (SELECT *, unnest(range(1, hits + 1)) AS p FROM tried WHERE seq = served_at)
  UNION ALL SELECT request, 3, 0, 0, CASE WHEN served_at IS NULL AND failed THEN 'Error' ELSE 'Done' END, NULL, CASE WHEN served_at IS NULL AND failed THEN 'AllEnginesFailed' END FROM ends),
events AS (SELECT request, CAST(row_number() OVER (PARTITION BY request ORDER BY stage, part, sub) - 1 AS INTEGER) AS seq, kind, engine, detail FROM parts)"""
OUTCOMES = f"""{EVENTS}, outcomes AS (
  SELECT request // 3 AS job, count(*) FILTER (WHERE kind = 'Result') AS results, CASE WHEN min(engine) FILTER (WHERE kind = 'Result') = max(engine) FILTER (WHERE kind = 'Result') THEN min(engine) FILTER (WHERE kind = 'Result') END AS engine,
    arg_min(detail, request) FILTER (WHERE kind = 'Error') AS failure FROM events GROUP BY 1)"""


def events(spark: SparkSession, sf: str) -> DataFrame:
    return R.search_events(calls(spark, sf).select(F.expr("seq div 4").alias("request"), "seq", "engine", "outcome", "hits"))


def targets(spark: SparkSession, sf: str) -> DataFrame:
    requests = calls(spark, sf).select(F.expr("seq div 4").alias("request")).distinct()
    return requests.select("request", F.expr("request div 3").alias("job"), (F.col("request") % 3).cast("int").alias("at"))


register("str1_search_events", f"WITH {EVENTS} SELECT * FROM events")(events)
register("str3_pump", f"WITH {EVENTS} SELECT * FROM events WHERE kind IN ('EngineEvent', 'Result')")(
    lambda s, d: R.pump(events(s, d)).select("request", "seq", "kind", "engine", "detail")
)
register("str4_fan_out", f"WITH {OUTCOMES} SELECT * FROM outcomes")(lambda s, d: R.fan_out(events(s, d), targets(s, d)))
register("str6_batch", f"""WITH {EVENTS} SELECT request, CASE WHEN bool_or(kind = 'Error') THEN 'err'
    ELSE 'ok' END AS status, count(*) FILTER (WHERE kind = 'Result') AS results, max(detail) FILTER (WHERE kind = 'Error') AS error
    FROM events GROUP BY request""")(lambda s, d: R.batch(events(s, d)))
# Each query asks the engines in their order of priority; google is out of service for half of them.
PLACE = "CASE engine WHEN 'google' THEN 0 WHEN 'brave' THEN 1 WHEN 'bing' THEN 2 WHEN 'brave_api' THEN 3 ELSE 4 END"
ASKED = f"SELECT query AS request, CAST({PLACE} AS BIGINT) AS seq, engine, CASE WHEN engine = 'google' AND query IN ('en', 'es') THEN 'Captcha' ELSE 'Ok' END AS outcome, CAST(count(*) AS INT) AS hits"
SERVED = f"""all_hits AS {I.HITS.removeprefix('hits AS ')}, asked AS ({ASKED} FROM all_hits GROUP BY query, engine),
  won AS (SELECT request AS query, arg_min(engine, seq) AS engine FROM asked WHERE outcome = 'Ok' AND hits > 0 GROUP BY request), hits AS (SELECT h.* FROM all_hits h JOIN won USING (query, engine))"""
register("m6_search", f"WITH {MAPPED.replace(I.HITS, SERVED)} SELECT ord, query, title, url, snippet, position, engine, CASE WHEN score <= 0 THEN 1.0 / position ELSE CAST(score AS DOUBLE) END AS score, domain_authority, source_type, 'hybrid' AS mode FROM mapped")(
    lambda s, d: R.search(s.sql(f"{ASKED} FROM {{hits}} GROUP BY query, engine", hits=I.hits(s, d)), I.hits(s, d))
)
FRAMES = f"""{OUTCOMES}, jobs AS (SELECT job, job % 10 = 3 AS refused, job % 10 = 4 AS late, results, engine, failure FROM outcomes),
done AS (SELECT job, refused, CASE WHEN refused OR late THEN 0 ELSE results END AS results, engine, CASE WHEN refused THEN 'connection-failed' WHEN late THEN 'timeout' WHEN failure IS NOT NULL THEN 'engine-failed' END AS code FROM jobs),
pieces AS (
  SELECT job, 0 AS stage, 0 AS part, 0 AS sub, 'job-started' AS name, NULL AS engine, NULL AS detail FROM done WHERE NOT refused
  UNION ALL SELECT job, 1, request % 3, seq, CASE kind WHEN 'Result' THEN 'result' ELSE 'engine-event' END, e.engine, detail FROM events e JOIN done ON e.request // 3 = job WHERE kind IN ('EngineEvent', 'Result') AND NOT refused
  UNION ALL SELECT job, 2, 0, 0, 'error', NULL, code FROM done WHERE code IS NOT NULL
  UNION ALL SELECT job, 3, 0, 0, 'done', CASE WHEN results > 0 THEN engine END, CASE WHEN results = 0 AND code IS NOT NULL THEN code ELSE CAST(results AS VARCHAR) END FROM done)
SELECT job, CAST(row_number() OVER (PARTITION BY job ORDER BY stage, part, sub) - 1 AS INTEGER) AS seq, name, engine, detail FROM pieces"""


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    return targets(spark, sf).select("job").distinct().select("job", (F.col("job") % 10 == 3).alias("refused"), (F.col("job") % 10 == 4).alias("late"))


register("job6_run", f"WITH {FRAMES}")(lambda s, d: R.run_jobs(jobs(s, d), events(s, d), targets(s, d)))


def queued(spark: SparkSession, sf: str) -> DataFrame:
    """Calls as jobs of a queue a user: they run as long as their value says."""
    return calls(spark, sf).join(I.table(spark, sf, "events").select(F.col("event_id").alias("seq"), "value"), "seq").select(F.col("user_id").alias("queue"), F.col("seq").alias("job"), F.col("ts_ms").alias("arrived_ms"), (F.col("value") * 1000).cast("long").alias("run_ms"))


QUEUED = f"""{CALLS}, q AS (SELECT c.user_id AS queue, seq AS job, ts_ms AS arrived_ms, CAST(floor(e.value * 1000) AS BIGINT) AS run_ms
    FROM calls c JOIN events e ON e.event_id = c.seq)"""
# with as many places as jobs none waits: a check of times that SQL can say; the tests hold fewer places against brute force
register("job4_queue_without_waiting", f"""WITH {QUEUED}
    SELECT queue, job, arrived_ms AS start_ms, arrived_ms + run_ms AS end_ms, CAST(0 AS BIGINT) AS waiting
    FROM q""")(lambda s, d: R.queue(queued(s, d), 1 << 12))
# one place: a job ends at its own end of work after the latest start of a busy spell
register("job4_queue", f"""WITH {QUEUED}, n AS (SELECT *, row_number() OVER w AS n, sum(run_ms) OVER (PARTITION BY queue ORDER BY arrived_ms, job ROWS UNBOUNDED PRECEDING) AS work FROM q WINDOW w AS (PARTITION BY queue ORDER BY arrived_ms, job)),
  e AS (SELECT *, work + max(arrived_ms - (work - run_ms)) OVER (PARTITION BY queue ORDER BY arrived_ms, job ROWS UNBOUNDED PRECEDING) AS end_ms FROM n)
  SELECT queue, job, CAST(end_ms - run_ms AS BIGINT) AS start_ms, CAST(end_ms AS BIGINT) AS end_ms, (SELECT count(*) FROM q x WHERE x.queue = e.queue AND x.arrived_ms <= e.end_ms - e.run_ms) - n AS waiting FROM e""")(lambda s, d: R.queue(queued(s, d), 1))
register("snk10_health", f"""WITH {CALLS}, {SNAP}, e AS (SELECT unnest([0, 1, 2, 3, 4]) AS place, unnest(['google', 'brave', 'bing', 'brave_api', 'tavily']) AS engine)
  SELECT place, engine, coalesce(retry_after_ms, 0) AS retry_after_ms, cooldown_until_ms, last_call_ms, 7 AS queue_depth FROM e LEFT JOIN snap USING (engine)""")(
    lambda s, d: S.health(snap(s, d), 7)
)
register("snk11_telemetry", """SELECT '{\"ts\":\"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00\",\"level\":\"' || CASE
    WHEN event_type = 'error' THEN 'warn'
    ELSE 'info' END || '\",\"trace_id\":\"' || md5(CAST(event_id AS VARCHAR)) || '\",\"event\":{\"op\":\"' || event_type || '\"}}' AS value
    FROM events""")(
    lambda s, d: R.telemetry(I.table(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.md5(F.col("event_id").cast("string").cast("binary")).alias("trace_id"), "event_type"), F.when(F.col("event_type") == "error", "warn").otherwise("info"), F.struct(F.col("event_type").alias("op")))
)


register("rtr8_search_priority")(lambda s, d: S.route(calls(s, d).withColumnRenamed("user_id", "run"), "free"))
register("rtr9_search_pinned")(lambda s, d: S.route(calls(s, d).withColumnRenamed("user_id", "run"), pinned=True))
