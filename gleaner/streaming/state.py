"""The state folds of ``operators.state`` for live input, keyed and kept in the state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gleaner.operators.state import BLOCKING, COOLDOWN_MS, INTERVAL_MS, TTL_S

HEARTBEAT_MS = 25_000


def reputation_step(state: tuple[int, tuple[str, ...], float], kind: str, flags: list[str], now: float, ttl_s: float = TTL_S) -> tuple[int, tuple[str, ...], float]:
    """(hits, flags, last seen) after an entry; entries past the time to live start anew."""
    hits, held, seen = state
    if seen and now - seen > ttl_s:
        hits, held = 0, ()
    if kind == "decay":
        return 0, tuple(f for f in held if f not in BLOCKING), now
    return hits + 1, (*held, *(f for f in dict.fromkeys(flags) if f not in held)), now


def is_blocked(hits: int, flags) -> bool:
    return hits >= 2 and any(f in BLOCKING for f in flags)


def reputation(log: DataFrame, ttl_s: int = TTL_S) -> DataFrame:
    """State after each entry of a stream (domain, seq, ts, kind, flags): hits, flags, blocked.

    Within a micro-batch entries are taken by ``seq``.  A domain that is silent
    past the time to live gives its state back.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = (state.get[0], tuple(state.get[1].split(",")) if state.get[1] else (), state.get[2]) if state.exists else (0, (), 0.0)
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        out = []
        for r in rows.itertuples():
            now = reputation_step(now, r.kind, list(r.flags), r.ts.timestamp(), ttl_s)
            out.append((key[0], r.seq, now[0], ",".join(sorted(now[1])), is_blocked(now[0], now[1])))
        state.update((now[0], ",".join(now[1]), now[2]))
        state.setTimeoutDuration(ttl_s * 1000)
        yield pd.DataFrame(out, columns=["domain", "seq", "hits", "flags", "blocked"])

    return log.groupBy("domain").applyInPandasWithState(fold, "domain string, seq long, hits long, flags string, blocked boolean", "hits long, flags string, seen double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def pacing(calls: DataFrame, interval_ms: dict[str, int] | None = None) -> DataFrame:
    """Wait and cooldown of each call of a stream (engine, seq, ts_ms, outcome)."""
    intervals = INTERVAL_MS | (interval_ms or {})

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, until = state.get if state.exists else (-1, -1)
        out = []
        for r in pd.concat(list(batches)).sort_values(["ts_ms", "seq"], kind="stable").itertuples():
            gap = max(r.ts_ms - last, 0) if last >= 0 else intervals[key[0]]
            wait = intervals[key[0]] - gap if gap < intervals[key[0]] else None
            if r.outcome in COOLDOWN_MS:
                until = max(until, r.ts_ms + COOLDOWN_MS[r.outcome])
            last = r.ts_ms
            out.append((key[0], r.seq, wait, until if until >= 0 else None))
        state.update((last, until))
        yield pd.DataFrame(out, columns=["engine", "seq", "remaining_ms", "cooldown_until_ms"]).astype({"remaining_ms": "Int64", "cooldown_until_ms": "Int64"})

    return calls.groupBy("engine").applyInPandasWithState(fold, "engine string, seq long, remaining_ms long, cooldown_until_ms long", "last long, until long", "append", GroupStateTimeout.NoTimeout)


def frames(events: DataFrame, heartbeat_ms: int = HEARTBEAT_MS) -> DataFrame:
    """Event-stream frames of each job (job, seq, name, data): in order, nothing after ``done``, a heartbeat when idle.

    The idle timer starts when a job first has nothing to say and starts again
    after each heartbeat; finished jobs give their state back.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = ["job", "seq", "frame"]
        if state.hasTimedOut:
            if state.get[1]:
                state.remove()
                return
            state.setTimeoutDuration(heartbeat_ms)
            yield pd.DataFrame([(key[0], state.get[0], ":heartbeat\n\n")], columns=columns)
            return
        seq, done = state.get if state.exists else (-1, False)
        out = []
        for r in pd.concat(list(batches)).sort_values("seq", kind="stable").itertuples():
            if done or r.seq <= seq:
                continue
            seq, done = r.seq, r.name == "done"
            out.append((key[0], r.seq, f"event:{r.name}\ndata:{r.data}\n\n"))
        state.update((seq, done))
        state.setTimeoutDuration(heartbeat_ms)
        yield pd.DataFrame(out, columns=columns)

    named = events.select("job", "seq", "name", "data")
    return named.groupBy("job").applyInPandasWithState(fold, "job long, seq long, frame string", "seq long, done boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


def collected(events: DataFrame) -> DataFrame:
    """Results of each job's events (job, seq, name, data), up to its first error."""
    stops = events.where("name = 'error'").groupBy("job").agg(F.min("seq").alias("stop"))
    return events.where("name = 'result'").join(stops, "job", "left").where("stop IS NULL OR seq < stop").select("job", "seq", "data")


def activity(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events of each kind in tumbling windows of event time; an addition to the state operators, with late data bounded."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
