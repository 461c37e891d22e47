"""What the library offers, as JSON for people and programs that call it."""

from __future__ import annotations

import json

PACKAGES = {
    "functions": "column functions: URL, text, quality, query rewriting, dot paths; HTML and PDF parsers on Arrow batches",
    "operators": "DataFrame operators: hits, state, jobs, runs, pages, extraction, trees",
    "sources": "captured answers, result pages, files and messages as tables",
    "sinks": "envelopes, JSON lines, event-stream frames, metrics",
    "streaming": "state folds, frames and submitted jobs on Structured Streaming",
    "plans": "registered queries and their equivalents in SQL",
}
USAGE = {
    "list": "names of all registered queries",
    "run NAME DIR [--format json|lines|text] [--limit N]": "run a query over the tables in a folder; json prints an envelope",
    "config": "settings from the environment",
    "describe": "this guide",
}
EXIT_CODES = {"0": "done", "1": "the query failed", "2": "the command line is wrong"}


def describe() -> str:
    return json.dumps({"name": "gleaner", "packages": PACKAGES, "usage": USAGE, "exit_codes": EXIT_CODES}, ensure_ascii=False)
