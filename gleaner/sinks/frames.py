"""Output: envelopes, JSON lines, summaries, event-stream frames, metrics."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.arrow import row_udf

# Error kinds and their wire codes; kinds of engine events and stream events.
ERROR_CODES = {"RateLimited": "rate-limited", "Captcha": "captcha", "QuotaExceeded": "quota-exceeded", "Network": "engine-failed", "Parse": "engine-failed", "Unavailable": "engine-failed", "AllEnginesFailed": "engine-failed", "Timeout": "timeout", "Http": "extract-failed", "Empty": "extract-failed", "Unsupported": "extract-failed", "BotBlocked": "extract-failed", "ConnectionFailed": "connection-failed", "BrowserNotFound": "browser-not-found", "InvalidInput": "invalid-input"}
EVENT_NAMES = {"JobStarted": "job-started", "Result": "result", "EngineEvent": "engine-event", "Done": "done", "Error": "error"}


def error_code(kind: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for p in ERROR_CODES.items() for x in p])[kind], F.lit("engine-failed"))


def parse_code(text: Column) -> Column:
    """An error code as it goes over the wire; null for anything else."""
    return F.when(text.isin(*dict.fromkeys(ERROR_CODES.values())), text)


def ok_envelope(data_json: Column) -> Column:
    """Envelope of a result given as JSON text."""
    return F.concat(F.lit('{"status":"ok","data":'), data_json, F.lit(',"error":null}'))


def error_envelope(code: Column, detail: Column, hint: Column | None = None) -> Column:
    body = F.to_json(F.struct(code.alias("code"), detail.alias("detail"), *([hint.alias("hint")] if hint is not None else [])))
    return F.concat(F.lit('{"status":"error","data":null,"error":'), body, F.lit("}"))


def json_lines(df: DataFrame) -> DataFrame:
    """One compact JSON line a row, in a ``value`` column that the text sink takes."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def pretty(struct: Column) -> Column:
    return F.to_json(struct, {"pretty": "true"})


def _summary(x) -> str:
    if isinstance(x, str):
        raw = x.encode()
        return x if len(raw) <= 200 else raw[:200].decode(errors="ignore") + "..."
    if isinstance(x, list):
        return f"[{len(x)} items]"
    if isinstance(x, dict):
        return "{" + ", ".join(x) + "}"
    return json.dumps(x)


def as_text(document: str) -> str:
    """Readable text of JSON: scalars as they are, a line for each element or field; what is no JSON stays as it is."""
    try:
        x = json.loads(document)
    except (ValueError, RecursionError):
        return document
    if isinstance(x, list):
        return "\n".join(f"[{i}] {_summary(v)}" for i, v in enumerate(x, 1))
    if isinstance(x, dict):
        return "\n".join(f"{k}: {_summary(v)}" for k, v in x.items())
    return x if isinstance(x, str) else json.dumps(x)


def text_udf():
    return row_udf("string", lambda document: None if document is None else as_text(document))


def event_name(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for p in EVENT_NAMES.items() for x in p])[kind]


def is_terminal(kind: Column) -> Column:
    return kind == "Done"


def sse_frame(name: Column, data_json: Column) -> Column:
    return F.concat(F.lit("event:"), name, F.lit("\ndata:"), data_json, F.lit("\n\n"))


def metrics_text(statuses: DataFrame, queue_depth: int = 0) -> DataFrame:
    """Prometheus text of admission outcomes (status, code): one row."""
    n = statuses.agg(F.count_if(F.col("status") == 202).alias("a"), F.count_if(F.col("code") == "quota-exceeded").alias("b"), F.count_if(F.col("code") == "duplicate_trace_id").alias("c"))
    one = lambda name, help_, kind, value: F.concat(F.lit(f"# HELP {name} {help_}\n# TYPE {name} {kind}\n{name} "), value.cast("string"), F.lit("\n"))
    return n.select(F.concat(
        one("gleaner_jobs_submitted", "Jobs admitted.", "counter", F.col("a")), one("gleaner_jobs_over_quota", "Jobs rejected over quota.", "counter", F.col("b")),
        one("gleaner_jobs_duplicate", "Jobs rejected for a used trace id.", "counter", F.col("c")), one("gleaner_queue_depth", "Jobs waiting.", "gauge", F.lit(queue_depth)),
    ).alias("value"))
