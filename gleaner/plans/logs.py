"""Registered queries of engine-call and reputation logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import quality as Q
from gleaner.operators import state as S
from gleaner.plans import inputs as I
from gleaner.plans.catalog import register

# Calls are made of ``events``: user 0..4 mod 5 names the engine, the event type the outcome.

CALLS_SQL = """
SELECT event_id AS seq, CASE user_id % 5 WHEN 0 THEN 'google' WHEN 1 THEN 'brave' WHEN 2 THEN 'bing' WHEN 3 THEN 'brave_api' ELSE 'tavily' END AS engine,
  {ms} AS ts_ms, CASE event_type WHEN 'error' THEN 'RateLimited' WHEN 'view' THEN 'Captcha' ELSE 'Ok' END AS outcome,
  CASE WHEN event_type = 'click' THEN 0 ELSE 3 END AS hits, user_id FROM events"""
CALLS = "calls AS (" + CALLS_SQL.format(ms="epoch_us(ts) // 1000") + ")"
#: Calls come twenty minutes apart on average, so the intervals are minutes here.
MINUTES = {"brave": 25, "bing": 5, "google": 30, "brave_api": 5, "tavily": 5}
INTERVALS = "CASE engine " + " ".join(f"WHEN '{e}' THEN {m * 60000}" for e, m in MINUTES.items()) + " END"
REAL = "CASE engine " + " ".join(f"WHEN '{e}' THEN {m}" for e, m in S.INTERVAL_MS.items()) + " END"
ENDS = "CASE outcome WHEN 'RateLimited' THEN ts_ms + 300000 WHEN 'Captcha' THEN ts_ms + 1800000 END"


def calls(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(CALLS_SQL.format(ms="unix_millis(CAST(ts AS TIMESTAMP))").replace("FROM events", "FROM {events}"), events=I.table(spark, sf, "events"))


NOW = 1704931200000  # 2024-01-11
SNAP = f"""snap AS (SELECT engine, max(ts_ms) AS last_call_ms, CASE WHEN max({ENDS}) > {NOW} THEN max({ENDS}) END AS cooldown_until_ms, greatest(0, coalesce(CASE
    WHEN max({ENDS}) > {NOW} THEN max({ENDS}) END - {NOW}, 0), max(ts_ms) + {REAL} - {NOW}) AS retry_after_ms
    FROM calls WHERE ts_ms <= {NOW}
    GROUP BY engine)"""
snap = lambda s, d: S.snapshot(calls(s, d), NOW)

register("pac1_intervals", f"""WITH {CALLS} SELECT engine, CAST({REAL} AS INTEGER) AS interval_ms, count(*) AS n
    FROM calls GROUP BY engine""")(lambda s, d: calls(s, d).groupBy("engine").agg(F.count("*").alias("n")).select("engine", S.lookup(S.INTERVAL_MS, F.col("engine")).alias("interval_ms"), "n"))
register("pac2_remaining", f"""WITH {CALLS}, g AS (SELECT seq, engine, {INTERVALS} AS i, greatest(ts_ms - lag(ts_ms) OVER (PARTITION BY engine
    ORDER BY ts_ms, seq), 0) AS e, lag(ts_ms) OVER (PARTITION BY engine ORDER BY ts_ms, seq) AS b FROM calls)
    SELECT seq, engine, CASE WHEN b IS NOT NULL AND e < i THEN i - e END AS remaining_ms FROM g""")(
    lambda s, d: S.pacing(calls(s, d), S.lookup({e: m * 60000 for e, m in MINUTES.items()}, F.col("engine")).cast("long")).select("seq", "engine", "remaining_ms")
)
register("pac4_quota", f"""WITH {CALLS}, p AS (SELECT engine, seq, row_number() OVER (ORDER BY ts_ms, seq) AS spend
    FROM calls WHERE engine IN ('brave_api', 'tavily'))
    SELECT engine, seq, spend, spend - 1 >= 2000 AS exceeded FROM p""")(
    lambda s, d: S.quota(calls(s, d)).select("engine", "seq", "spend", "exceeded")
)
register("pac5_snapshot", f"WITH {CALLS}, {SNAP} SELECT engine, last_call_ms, cooldown_until_ms, retry_after_ms FROM snap")(snap)
register("agg10_earliest", f"WITH {CALLS}, {SNAP} SELECT min(retry_after_ms) AS wait_ms FROM snap")(lambda s, d: S.earliest_available(snap(s, d)))
register("rtr1_next_engine", f"""WITH {CALLS}, {SNAP} SELECT arg_min(engine, CASE engine WHEN 'google' THEN 0
    WHEN 'brave' THEN 1 WHEN 'bing' THEN 2 WHEN 'brave_api' THEN 3 ELSE 4 END) AS engine FROM snap
    WHERE retry_after_ms = 0""")(lambda s, d: S.next_engine(snap(s, d)))
register("rtr4_cooldowns", f"""WITH {CALLS} SELECT seq, engine, max({ENDS}) OVER (PARTITION BY engine
    ORDER BY ts_ms, seq ROWS UNBOUNDED PRECEDING) AS cooldown_until_ms FROM calls""")(
    lambda s, d: S.cooldowns(calls(s, d)).select("seq", "engine", "cooldown_until_ms")
)
register("rtr5_unexpired", f"WITH {CALLS}, {SNAP} SELECT engine, cooldown_until_ms FROM snap WHERE cooldown_until_ms > {NOW}")(
    lambda s, d: S.unexpired(snap(s, d), NOW)
)
ATTEMPTS = f"{CALLS}, attempts AS (SELECT seq // 4 AS request, seq, engine, outcome, hits FROM calls)"
register("rtr6_fallback", f"""WITH {ATTEMPTS}
    SELECT request, arg_min(engine, seq) FILTER (WHERE outcome = 'Ok' AND hits > 0) AS engine, CASE
    WHEN bool_or(outcome = 'Ok' AND hits > 0) THEN 'Served'
    WHEN bool_or(outcome <> 'Ok') THEN 'AllEnginesFailed' ELSE 'Empty' END AS result FROM attempts
    GROUP BY request""")(lambda s, d: S.fallback(calls(s, d).withColumn("request", F.expr("seq div 4"))))
register("rtr10_dispatch_events", f"""WITH {CALLS}
    SELECT seq, engine, CAST(i - 1 AS INTEGER) AS step, e[i] AS event
    FROM (SELECT seq, engine, e, unnest(range(1, len(e) + 1)) AS i FROM (SELECT seq, engine, CASE
    WHEN outcome = 'RateLimited' THEN ['RateLimited', 'Cooldown']
    WHEN outcome = 'Captcha' THEN ['Captcha', 'Cooldown'] WHEN outcome = 'Ok' AND hits > 0 THEN ['Served']
    ELSE ['Fallback'] END AS e FROM calls))""")(lambda s, d: S.dispatch_events(calls(s, d)))


register("rtr7_search_auto")(lambda s, d: S.route(calls(s, d).withColumnRenamed("user_id", "run")))
# Reputation log: the user is the domain, the type the entry.
LOG_SQL = """SELECT concat('d', user_id % 40) AS domain, event_id AS seq, ts, CASE
    WHEN event_type IN ('click', 'purchase') THEN 'decay' ELSE 'write' END AS kind, CASE event_type
    WHEN 'error' THEN 'BotWall' WHEN 'view' THEN 'Captcha' WHEN 'signup' THEN 'Paywall' ELSE '' END AS flag
    FROM events"""


def reputation_log(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.sql(LOG_SQL.replace("FROM events", "FROM {events}"), events=I.table(spark, sf, "events"))
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("flags", F.array_compact(F.array(F.nullif("flag", F.lit(""))))).drop("flag")


REP = f"""WITH log AS ({LOG_SQL}),
  a AS (SELECT *, CASE WHEN epoch_us(ts) // 1000000 - epoch_us(lag(ts) OVER w) // 1000000 > 86400 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM log WINDOW w AS (PARTITION BY domain ORDER BY seq)),
  b AS (SELECT *, sum(fresh) OVER (PARTITION BY domain ORDER BY seq ROWS UNBOUNDED PRECEDING) AS life FROM a),
  c AS (SELECT *, sum(CASE WHEN kind = 'decay' THEN 1 ELSE 0 END) OVER (PARTITION BY domain, life ORDER BY seq ROWS UNBOUNDED PRECEDING) AS spell FROM b),
  e AS (SELECT domain, seq, count(*) FILTER (WHERE kind = 'write') OVER s AS hits, bool_or(kind = 'write' AND flag = 'BotWall') OVER s AS bot, bool_or(kind = 'write' AND flag = 'Paywall') OVER s AS pay, bool_or(kind = 'write' AND flag = 'Captcha') OVER l AS cap
    FROM c WINDOW s AS (PARTITION BY domain, life, spell ORDER BY seq ROWS UNBOUNDED PRECEDING), l AS (PARTITION BY domain, life ORDER BY seq ROWS UNBOUNDED PRECEDING))
  SELECT domain, seq, hits, array_to_string(list_filter([CASE WHEN bot THEN 'BotWall' END, CASE WHEN cap THEN 'Captcha' END, CASE WHEN pay THEN 'Paywall' END], lambda f: f IS NOT NULL), ',') AS flags, hits >= 2 AND (bot OR pay) AS blocked FROM e"""
register("rep3_blocked", REP)(lambda s, d: S.reputation(reputation_log(s, d)).select("domain", "seq", "hits", F.array_join("flags", ",").alias("flags"), "blocked"))
register("rep4_time_to_live", f"""SELECT domain, seq FROM (SELECT *, lag(ts) OVER (PARTITION BY domain
    ORDER BY seq) AS b FROM ({LOG_SQL}))
    WHERE epoch_us(ts) // 1000000 - epoch_us(b) // 1000000 > 3600""")(
    lambda s, d: S.expired(reputation_log(s, d), 3600).select("domain", "seq")
)
FLAG_SETS = "SELECT user_id, list_sort(list_distinct(list(event_type))) AS f FROM events GROUP BY user_id"
flag_sets = lambda s, d: I.table(s, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("f"))
register("set2_flag_union", f"""SELECT user_id, array_to_string(list_sort(list_distinct(list_concat(f, ['Captcha', 'view']))), ',') AS flags
    FROM ({FLAG_SETS})""")(lambda s, d: flag_sets(s, d).select("user_id", F.array_join(F.array_sort(Q.flag_union(F.col("f"), F.array(F.lit("Captcha"), F.lit("view")))), ",").alias("flags")))
register("set3_flag_difference", f"""SELECT user_id, array_to_string(list_filter(f, lambda x: x NOT IN ('error', 'view')), ',') AS flags
    FROM ({FLAG_SETS})""")(lambda s, d: flag_sets(s, d).select("user_id", F.array_join(F.array_sort(Q.flag_difference(F.col("f"), F.array(F.lit("error"), F.lit("view")))), ",").alias("flags")))
