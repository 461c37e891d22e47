"""Query rewriting for an engine's search operators, as array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions import text as T

# Operator keywords, and those that each engine takes.
KEYWORDS = ["site", "filetype", "intitle", "allintitle", "inurl", "allinurl", "intext", "related", "cache", "define", "before", "after", "near", "inanchor", "inbody", "loc", "language"]
SUPPORTED = {
    "google": [k for k in KEYWORDS if k not in ("cache", "define")],
    "brave": ["site", "filetype", "intitle", "inurl", "intext", "before", "after"],
    "bing": [],
    "brave_api": KEYWORDS,
    "tavily": KEYWORDS,
}


def tokenize(query: Column) -> Column:
    """Parts between white space; a quoted stretch belongs to its part."""
    return F.regexp_extract_all(query, F.lit(r"""(?:[^ \t\n\r"]|"[^"]*"|"[^"]*$)+"""), F.lit(0))


def keyword(token: Column) -> Column:
    return F.lower(F.regexp_extract(token, r"^([^:]+):", 1))


def classify(token: Column) -> Column:
    """Kind of a token; the first that fits."""
    return (
        F.when(token.rlike("^-."), "exclusion").when(token.contains('"'), "quoted").when(keyword(token).isin(KEYWORDS), "keyvalue")
        .when(token.rlike(r"^(?i)AROUND\([0-9]+\)$"), "around").when(token.contains(".."), "range").when(F.lower(token).isin("or", "and"), "boolean")
        .when(token.rlike("[()]"), "paren").when(token.contains("*"), "wildcard").otherwise("plain")
    )


def keyword_supported(engine: str, word: Column) -> Column:
    known = SUPPORTED[engine]
    return word.isin(known) if known else F.lit(False)


def rewrite(query: Column, engine: str) -> Column:
    """The query without operators that the engine lacks and without repeated plain words.

    A query that would lose everything, or has nothing to rewrite, comes back as it is.
    """
    tokens = F.transform(tokenize(query), lambda t: F.struct(t.alias("t"), classify(t).alias("k"), F.lower(t).alias("l")))
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<string>").alias("out"), F.lit(False).alias("twice"))

    def step(s: Column, x: Column) -> Column:
        plain = x["k"] == "plain"
        again = plain & F.array_contains(s["seen"], x["l"])
        keep = ~again & F.when(x["k"] == "keyvalue", keyword_supported(engine, keyword(x["t"]))).when(x["k"] == "around", F.lit(engine == "google")).otherwise(F.lit(True))
        text = x["t"]
        if engine != "google":
            bare = F.regexp_replace(text, r"\*", "")
            text = F.when(text.contains("*"), F.when(text.contains('"'), F.regexp_replace(bare, " +", " ")).otherwise(bare)).otherwise(text)
        if engine == "bing":
            text = F.when(x["k"] == "paren", F.regexp_replace(text, "[()]", "")).otherwise(text)
        return F.struct(
            F.when(plain & ~again, F.array_append(s["seen"], x["l"])).otherwise(s["seen"]).alias("seen"),
            F.when(keep & (text != ""), F.array_append(s["out"], text)).otherwise(s["out"]).alias("out"),
            (s["twice"] | again).alias("twice"),
        )

    done = F.aggregate(tokens, start, step)
    triggered = query.rlike(r'["\-:()*]') | query.contains("..")
    result = F.array_join(done["out"], " ")
    return F.when(T.is_blank(query), query).when(~triggered & ~done["twice"], query).when(F.size(done["out"]) == 0, query).otherwise(result)
