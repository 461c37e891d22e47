"""Searches as ordered events, and jobs as frames, over logs of engine calls.

An attempt is (request, seq, engine, outcome, hits): engines are tried in order of
``seq`` until one serves.  Events and frames carry ``seq``, gapless from 0 in each
request or job, so that order is data and any exchange may follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators import hits as H
from gleaner.operators import state as S
from gleaner.sinks import frames as FR


def _numbered(df: DataFrame, key: str, *order: str) -> DataFrame:
    """``seq`` from 0 by an order within a key; a key's events are few."""
    return df.withColumn("seq", (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("int"))


def served(attempts: DataFrame) -> DataFrame:
    """Where each request ends: (request, served_at, failed); no place where nothing served."""
    ok = (F.col("outcome") == "Ok") & (F.col("hits") > 0)
    return attempts.groupBy("request").agg(F.min(F.when(ok, F.col("seq"))).alias("served_at"), F.max(F.col("outcome") != "Ok").alias("failed"))


def search_events(attempts: DataFrame) -> DataFrame:
    """Events of each request: (request, seq, kind, engine, detail).

    JobStarted; an EngineEvent for each thing that befell an engine before one
    served; a Result for each hit, ``detail`` its position; then one terminal
    event, Done, or Error where nothing served and some engine failed.
    """
    ends = served(attempts)
    tried = attempts.join(ends, "request").where("served_at IS NULL OR seq <= served_at")
    none = F.lit(None).cast("string")
    event = lambda stage, at, sub, kind, engine, detail: [F.lit(stage).alias("stage"), at.cast("long").alias("at"), sub.cast("long").alias("sub"), kind.alias("kind"), engine.alias("engine"), detail.cast("string").alias("detail")]
    zero = F.lit(0)
    start = ends.select("request", *event(0, zero, zero, F.lit("JobStarted"), none, none))
    told = S.dispatch_events(tried, "request").where("event != 'Served'").select("request", *event(1, F.col("seq"), F.col("step"), F.lit("EngineEvent"), F.col("engine"), F.col("event")))
    hits = tried.where("seq = served_at").select("request", "engine", F.explode(F.sequence(F.lit(1), F.col("hits").cast("int"))).alias("position"))
    results = hits.select("request", *event(2, F.col("position"), zero, F.lit("Result"), F.col("engine"), F.col("position")))
    last = F.when(F.col("served_at").isNull() & F.col("failed"), "Error").otherwise("Done")
    end = ends.select("request", *event(3, zero, zero, last, none, F.when(last == "Error", "AllEnginesFailed")))
    events = start.unionByName(told).unionByName(results).unionByName(end)
    return _numbered(events, "request", "stage", "at", "sub").select("request", "seq", "kind", "engine", "detail")


def search(attempts: DataFrame, hits: DataFrame, mode: str = "hybrid") -> DataFrame:
    """Results of each request: the hits of the engine that served it, filtered, deduplicated and numbered.

    ``hits`` have ``query``, the request they answer, and the engine they come from;
    a request that nothing served has no results.
    """
    winner = attempts.join(served(attempts), "request").where("seq = served_at").select(F.col("request").alias("query"), "engine")
    return H.map_hits(hits.join(winner, ["query", "engine"], "left_semi"), mode)


def pump(events: DataFrame) -> DataFrame:
    """What a job passes on of its searches' events: engine events and results before a search's first error."""
    stops = events.where("kind = 'Error'").groupBy("request").agg(F.min("seq").alias("stop"))
    passed = events.where("kind IN ('EngineEvent', 'Result')").join(stops, "request", "left")
    return passed.where("stop IS NULL OR seq < stop").drop("stop")


def fan_out(events: DataFrame, targets: DataFrame) -> DataFrame:
    """Each job's outcome over its searches (``targets``: request, job, at): (job, results, engine, failure).

    Results of searches that failed later or never count all the same; the failure
    is that of the first failing search in the order of targets; ``engine`` is the
    one engine of all results, null where there are several or none.
    """
    results = pump(events).where("kind = 'Result'").select("request", "engine")
    got = targets.join(results, "request", "left").groupBy("job").agg(F.count("engine").alias("results"), F.min("engine").alias("low"), F.max("engine").alias("high"))
    failed = events.where("kind = 'Error'").join(targets, "request").groupBy("job").agg(F.min_by("detail", "at").alias("failure"))
    one = F.when(F.col("low") == F.col("high"), F.col("low"))
    return got.select("job", "results", one.alias("engine")).join(failed, "job", "left")


def batch(events: DataFrame) -> DataFrame:
    """One row a query: (request, status, results, error); a failure is that query's own."""
    ends = events.groupBy("request").agg(F.count_if(F.col("kind") == "Result").alias("results"), F.max(F.when(F.col("kind") == "Error", F.col("detail"))).alias("error"))
    return ends.select("request", F.when(F.col("error").isNull(), "ok").otherwise("err").alias("status"), F.when(F.col("error").isNull(), F.col("results")).otherwise(F.lit(0)).alias("results"), "error")


def run_jobs(jobs: DataFrame, events: DataFrame, targets: DataFrame) -> DataFrame:
    """Frames of each job: (job, seq, name, engine, detail), ``done`` always the last.

    ``jobs``: job, refused (no connection for it), late (its time was up before its
    searches ended).  A refused job has an error and the end.  Others start, pass on
    their searches' frames, tell a failure, and end; ``done`` details the number of
    results, or the error's code where there is a failure and nothing to show for it.
    """
    outcome = jobs.join(fan_out(events, targets), "job", "left").withColumn("results", F.coalesce("results", F.lit(0)))
    outcome = outcome.withColumn("failure", F.when(F.col("refused"), "ConnectionFailed").when(F.col("late"), "Timeout").otherwise(F.col("failure")))
    outcome = outcome.withColumn("results", F.when(F.col("refused") | F.col("late"), 0).otherwise(F.col("results")))
    outcome = outcome.withColumn("code", F.when(F.col("failure").isNotNull(), FR.error_code(F.col("failure"))))
    none = F.lit(None).cast("string")
    frame = lambda stage, at, sub, name, engine, detail: [F.lit(stage).alias("stage"), at.cast("long").alias("at"), sub.cast("long").alias("sub"), name.alias("name"), engine.alias("engine"), detail.cast("string").alias("detail")]
    zero = F.lit(0)
    start = outcome.where("NOT refused").select("job", *frame(0, zero, zero, F.lit("job-started"), none, none))
    passed = pump(events).join(targets, "request").join(jobs.where("NOT refused"), "job")
    told = passed.select("job", *frame(1, F.col("at"), F.col("seq"), FR.event_name(F.col("kind")), F.col("engine"), F.col("detail")))
    error = outcome.where("failure IS NOT NULL").select("job", *frame(2, zero, zero, F.lit("error"), none, F.col("code")))
    shown = F.when((F.col("results") == 0) & F.col("code").isNotNull(), F.col("code")).otherwise(F.col("results").cast("string"))
    done = outcome.select("job", *frame(3, zero, zero, F.lit("done"), F.when(F.col("results") > 0, F.col("engine")), shown))
    frames = start.unionByName(told).unionByName(error).unionByName(done)
    return _numbered(frames, "job", "stage", "at", "sub").select("job", "seq", "name", "engine", "detail")


def queue(jobs: DataFrame, running: int = 4) -> DataFrame:
    """Start and end of jobs (queue, job, arrived_ms, run_ms) on ``running`` places, in order of arrival: one queue's fold.

    A job starts when it has arrived and a place is free; ``waiting`` is how many
    jobs are still waiting when it starts.  Queues spread over tasks; one queue is
    sequential by nature.
    """
    import heapq

    import pandas as pd

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["arrived_ms", "job"], kind="stable")
        free, out = [0] * running, []
        for r in rows.itertuples():
            begin = max(int(r.arrived_ms), heapq.heappop(free))
            heapq.heappush(free, begin + int(r.run_ms))
            out.append((r.queue, r.job, begin, begin + int(r.run_ms)))
        table = pd.DataFrame(out, columns=["queue", "job", "start_ms", "end_ms"])
        arrived, started = rows["arrived_ms"].to_numpy(), table["start_ms"].to_numpy()
        table["waiting"] = arrived.searchsorted(started, side="right") - pd.RangeIndex(1, len(table) + 1)
        return table

    return jobs.groupBy("queue").applyInPandas(fold, "queue long, job long, start_ms long, end_ms long, waiting long")


def telemetry(rows: DataFrame, level: Column, event: Column) -> DataFrame:
    """A JSON line a row of (ts, trace_id): time, level, trace id and event."""
    line = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx").alias("ts"), level.alias("level"), "trace_id", event.alias("event")))
    return rows.select(line.alias("value"))
