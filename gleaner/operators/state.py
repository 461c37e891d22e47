"""Reputation, pacing, cooldown, quota and engine choice over logs of events.

Every operator folds an event log by key with windows; the streaming package
holds the same folds for live input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Engines by priority, their least intervals and cooldowns in milliseconds, the paid quota.
FREE, PAID = ["google", "brave", "bing"], ["brave_api", "tavily"]
PRIORITY = {"free": FREE, "api": PAID, "hybrid": FREE + PAID}
INTERVAL_MS = {"brave": 5000, "bing": 1000, "google": 6000, "brave_api": 1000, "tavily": 1000}
COOLDOWN_MS = {"RateLimited": 300_000, "Captcha": 1_800_000}
QUOTA, TTL_S, DAY_MS = 2000, 86_400, 86_400_000
BLOCKING = ["BotWall", "Paywall"]
#: Browser engines can't do without a session.
BROWSER_ONLY = ["brave", "google"]


def lookup(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def reputation(log: DataFrame, ttl_s: int = TTL_S, stretch: int = 1 << 20) -> DataFrame:
    """State after each entry of (domain, seq, ts, kind, flags): hits, flags and whether the domain is blocked.

    ``write`` adds flags and a hit; ``decay`` drops blocking flags and the hits,
    keeping the rest.  Entries further apart than the time to live start anew.
    Blocked: two hits or more and a blocking flag.

    A domain's log is cut into stretches of ``stretch`` numbers, each of which
    stands alone once it knows what came before: running sums and maxima, carried
    from stretch to stretch.  A flag is held if it was last seen since the last
    entry that drops it; hits are the writes since the last that drops them.
    """
    keys = ["domain", "__part"]
    own, before = Window.partitionBy(*keys).orderBy("seq"), Window.partitionBy("domain").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    rows = log.select("domain", "seq", "ts", "kind", "flags").withColumn("__part", F.floor(F.col("seq") / stretch))
    last = rows.groupBy(*keys).agg(F.max(F.struct("seq", "ts")).alias("x")).select(*keys, F.max("x").over(before)["ts"].alias("__before"))
    rows = rows.join(last, keys).withColumn("__before", F.coalesce(F.lag("ts").over(own), "__before"))
    fresh = F.coalesce(F.unix_timestamp("ts") - F.unix_timestamp("__before") > ttl_s, F.lit(True))
    rows = rows.select("domain", "__part", "seq", "kind", "flags", fresh.alias("__fresh"))

    writes, seq, names = (F.col("kind") == "write").cast("long"), F.col("seq"), ("BotWall", "Paywall", "Captcha", "EmptyShell")
    marks = {"__life": F.col("__fresh"), "__spell": F.col("__fresh") | (F.col("kind") == "decay")}
    marks |= {f"__{f}": (F.col("kind") == "write") & F.array_contains("flags", f) for f in names}
    told = rows.select("domain", "__part", "seq", writes.alias("__write"), F.sum(writes).over(so_far).alias("__writes"), *[F.when(when, seq).alias(m) for m, when in marks.items()])
    told = told.withColumn("__base", F.when(F.col("__spell").isNotNull(), F.col("__writes") - F.col("__write")))
    parts = told.groupBy(*keys).agg(F.sum("__write").alias("n"), F.max("__base").alias("base"), *[F.max(m).alias(m) for m in marks])
    carried = parts.withColumn("carried", F.coalesce(F.sum("n").over(before), F.lit(0)))
    carried = carried.select(*keys, "carried", F.max(F.col("carried") + F.col("base")).over(before).alias("base"), *[F.max(m).over(before).alias(f"{m}_before") for m in marks])
    out = told.join(carried, keys)
    at = {m: F.greatest(F.max(m).over(so_far), f"{m}_before") for m in marks}
    hits = F.col("carried") + F.col("__writes") - F.greatest(F.col("carried") + F.max("__base").over(so_far), "base")
    out = out.select("domain", "seq", hits.alias("hits"), *[column.alias(m) for m, column in at.items()])
    has = {f: F.coalesce(F.col(f"__{f}") >= F.col("__spell" if f in BLOCKING else "__life"), F.lit(False)) for f in names}
    held = F.array_sort(F.array_compact(F.array(*[F.when(has[f], f) for f in names])))
    return out.select("domain", "seq", "hits", held.alias("flags"), ((F.col("hits") >= 2) & (has["BotWall"] | has["Paywall"])).alias("blocked"))


def _by_day(calls: DataFrame, carried: Column, name: str) -> DataFrame:
    """Calls with their day, and ``name``: a maximum over all earlier days of the engine.

    Engines are few, so a log by engine would be a few tasks; days are summed up
    first, and each day's calls then stand alone.
    """
    dated = calls.withColumn("__day", F.floor(F.col("ts_ms") / DAY_MS))
    days = dated.groupBy("engine", "__day").agg(F.max(carried).alias("__of_day"))
    before = F.max("__of_day").over(Window.partitionBy("engine").orderBy("__day").rowsBetween(Window.unboundedPreceding, -1))
    return dated.join(days.select(F.col("engine"), "__day", before.alias(name)), ["engine", "__day"])


def pacing(calls: DataFrame, interval_ms: Column) -> DataFrame:
    """What each call of (engine, seq, ts_ms) would have had to wait since the one before (``before_ms``); null if nothing."""
    dated = _by_day(calls, F.col("ts_ms"), "__last")
    own = F.lag("ts_ms").over(Window.partitionBy("engine", "__day").orderBy("ts_ms", "seq"))
    paced = dated.withColumn("before_ms", F.coalesce(own, "__last"))
    elapsed = F.greatest(F.col("ts_ms") - F.col("before_ms"), F.lit(0))
    return paced.select(*calls.columns, "before_ms", F.when(F.col("before_ms").isNotNull() & (elapsed < interval_ms), interval_ms - elapsed).alias("remaining_ms"))


def cooldowns(calls: DataFrame) -> DataFrame:
    """End of the cooldown that holds after each call, by its outcome; null without one so far."""
    ends = F.col("ts_ms") + lookup(COOLDOWN_MS, F.col("outcome"))
    frame = Window.partitionBy("engine", "__day").orderBy("ts_ms", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return _by_day(calls, ends, "__until").select(*calls.columns, F.greatest(F.max(ends).over(frame), "__until").alias("cooldown_until_ms"))


def quota(calls: DataFrame, limit: int = QUOTA) -> DataFrame:
    """Paid calls so far, whatever came of them, and whether the quota was used up before this one.

    A running total over all paid calls: days are summed first, then the running
    total within each day starts from the days before, so no task holds the log.
    """
    paid = calls.where(F.col("engine").isin(PAID)).withColumn("day", F.floor(F.col("ts_ms") / DAY_MS))
    days = paid.groupBy("day").agg(F.count("*").alias("n"))
    before = days.select("day", F.coalesce(F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("day").orderBy("ts_ms", "seq"))
    counted = paid.withColumn("within", within).join(before, "day")
    spend = F.col("before") + F.col("within")
    return counted.select("engine", "seq", "ts_ms", spend.alias("spend"), (spend - 1 >= limit).alias("exceeded"))


def snapshot(calls: DataFrame, now_ms: int) -> DataFrame:
    """Last call, cooldown and wait of each engine at a time."""
    ends = F.col("ts_ms") + lookup(COOLDOWN_MS, F.col("outcome"))
    last = calls.where(F.col("ts_ms") <= now_ms).groupBy("engine").agg(F.max("ts_ms").alias("last_call_ms"), F.max(ends).alias("ends"))
    cooling = F.when(F.col("ends") > now_ms, F.col("ends"))
    wait = F.greatest(F.lit(0), F.coalesce(cooling - now_ms, F.lit(0)), F.col("last_call_ms") + lookup(INTERVAL_MS, F.col("engine")) - now_ms)
    return last.select("engine", "last_call_ms", cooling.alias("cooldown_until_ms"), wait.alias("retry_after_ms"))


def health(states: DataFrame, queue_depth: int = 0) -> DataFrame:
    """A row an engine, in order of priority, whether it was ever called or not: pacing state and the queue's depth."""
    engines = states.sparkSession.createDataFrame(list(enumerate(PRIORITY["hybrid"])), "place int, engine string")
    told = engines.join(states, "engine", "left")
    return told.select("place", "engine", F.coalesce("retry_after_ms", F.lit(0)).cast("long").alias("retry_after_ms"), "cooldown_until_ms", "last_call_ms", F.lit(queue_depth).alias("queue_depth"))


def expired(log: DataFrame, ttl_s: int = TTL_S) -> DataFrame:
    """Entries of (domain, seq, ts) that come after their domain's record has run out."""
    before = F.lag("ts").over(Window.partitionBy("domain").orderBy("seq"))
    return log.withColumn("__before", before).where(F.unix_timestamp("ts") - F.unix_timestamp("__before") > ttl_s).drop("__before")


def earliest_available(states: DataFrame) -> DataFrame:
    return states.agg(F.min("retry_after_ms").alias("wait_ms"))


def next_engine(states: DataFrame, mode: str = "hybrid") -> DataFrame:
    """First engine by priority that needn't wait; engines without calls are ready."""
    order = PRIORITY[mode]
    ready = states.where(F.col("engine").isin(order) & (F.col("retry_after_ms") == 0))
    return ready.agg(F.min_by("engine", lookup({e: i for i, e in enumerate(order)}, F.col("engine"))).alias("engine"))


def unexpired(states: DataFrame, now_ms: int) -> DataFrame:
    """Cooldowns to restore."""
    return states.where(F.col("cooldown_until_ms") > now_ms).select("engine", "cooldown_until_ms")


def fallback(attempts: DataFrame) -> DataFrame:
    """Outcome of each request's attempts (request, seq, engine, outcome, hits) in order.

    The first attempt with hits is served.  An empty answer isn't a success; if
    none has hits, any error makes it AllEnginesFailed, else it is empty.
    """
    served = (F.col("outcome") == "Ok") & (F.col("hits") > 0)
    out = attempts.groupBy("request").agg(
        F.min_by(F.when(served, F.col("engine")), F.when(served, F.col("seq"))).alias("engine"), F.max(served).alias("served"), F.max(F.col("outcome") != "Ok").alias("failed")
    )
    return out.select("request", "engine", F.when(F.col("served"), "Served").when(F.col("failed"), "AllEnginesFailed").otherwise("Empty").alias("result"))


def dispatch_events(calls: DataFrame, *keep: str) -> DataFrame:
    """Events that a call's outcome gives rise to, in order: (keep..., seq, engine, step, event)."""
    kinds = (
        F.when(F.col("outcome") == "RateLimited", F.array(F.lit("RateLimited"), F.lit("Cooldown"))).when(F.col("outcome") == "Captcha", F.array(F.lit("Captcha"), F.lit("Cooldown")))
        .when((F.col("outcome") == "Ok") & (F.col("hits") > 0), F.array(F.lit("Served"))).otherwise(F.array(F.lit("Fallback")))
    )
    return calls.select(*keep, "seq", "engine", F.posexplode(kinds).alias("step", "event"))


class Router:
    """Sequential choice of engines on a simulated clock: what a request would meet, in order.

    The state is a handful of numbers; use it inside ``applyInPandas`` or a
    stateful stream keyed by run, never over a whole corpus at once.
    """

    def __init__(self, mode: str = "hybrid", quota: int = QUOTA, interval_ms: dict[str, int] | None = None, wait_ms: int = 10_000) -> None:
        self.mode, self.quota, self.wait = mode, quota, wait_ms
        self.interval = INTERVAL_MS | (interval_ms or {})
        self.last: dict[str, int] = {}
        self.until: dict[str, int] = {}
        self.spend = 0

    def remaining(self, engine: str, now: int) -> int:
        since = now - self.last[engine] if engine in self.last else None
        pace = 0 if since is None or since >= self.interval[engine] else self.interval[engine] - max(since, 0)
        return max(pace, self.until.get(engine, 0) - now, 0)

    def pick(self, now: int, engines: list[str]) -> str | None:
        """First ready engine; stamped at once.  A paid engine counts against the quota when it is called."""
        for e in engines:
            if self.remaining(e, now) == 0 and not (e in PAID and self.spend >= self.quota):
                self.last[e] = now
                return e
        return None

    def record(self, engine: str, now: int, outcome: str) -> None:
        self.last[engine] = now
        if engine in PAID:
            self.spend += 1
        if outcome in COOLDOWN_MS:
            self.until[engine] = now + COOLDOWN_MS[outcome]

    def _pass(self, now: int, engines: list[str], call) -> tuple[str | None, str, int]:
        left, failed, waited = list(engines), False, 0
        while left:
            e = self.pick(now, left)
            if e is None:
                gap = min((self.remaining(x, now) for x in left if not (x in PAID and self.spend >= self.quota)), default=None)
                if gap is None or waited + gap > self.wait:
                    break
                now, waited = now + gap, waited + gap
                continue
            left.remove(e)
            outcome, hits = call(e)
            self.record(e, now, outcome)
            if outcome == "Ok" and hits:
                return e, "Served", now
            failed |= outcome != "Ok"
        return None, "AllEnginesFailed" if failed or not engines or len(left) == len(engines) else "Empty", now

    def search(self, now: int, call, pinned: str | None = None) -> tuple[str | None, str]:
        """(engine, result) of a request; ``call(engine)`` gives (outcome, hits)."""
        if pinned:
            if self.until.get(pinned, 0) > now:
                return None, "Unavailable"
            if pinned in PAID and self.spend >= self.quota:
                return None, "QuotaExceeded"
            now += self.remaining(pinned, now)
            outcome, hits = call(pinned)
            self.record(pinned, now, outcome)
            return (pinned, "Served" if hits else "Empty") if outcome == "Ok" else (None, outcome)
        if self.mode != "hybrid":
            return self._pass(now, PRIORITY[self.mode], call)[:2]
        engine, result, now = self._pass(now, FREE, call)  # a failed free pass is no end
        return (engine, result) if engine else self._pass(now, PAID, call)[:2]


def route(calls: DataFrame, mode: str = "hybrid", pinned: bool = False) -> DataFrame:
    """Each run's calls (run, seq, ts_ms, engine, outcome, hits) as its requests in order: (run, seq, engine, result).

    The named engine answers as the log says, any other answers nothing.  ``pinned``
    asks the named engine alone.  Rows stream past one router a run, whatever a
    run's length.
    """

    def fold(batches):
        import pandas as pd

        run, router = None, None
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                if run is None or r.run != run:
                    run, router = r.run, Router(mode)
                engine, result = router.search(int(r.ts_ms), lambda e, r=r: (r.outcome, r.hits) if e == r.engine else ("Ok", 0), pinned=r.engine if pinned else None)
                out.append((r.run, r.seq, engine, result))
            yield pd.DataFrame(out, columns=["run", "seq", "engine", "result"])

    ordered = calls.select("run", "seq", "ts_ms", "engine", "outcome", "hits").repartition("run").sortWithinPartitions("run", "ts_ms", "seq")
    return ordered.mapInPandas(fold, "run long, seq long, engine string, result string")
