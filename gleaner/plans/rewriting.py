"""Registered queries of search-operator rewriting."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import rewrite as R
from gleaner.plans import inputs as I
from gleaner.plans.catalog import register

REWRITES = [
    ("react cache:react.dev define:rust hooks", "google", "react hooks"), ("rust near:3 cargo inanchor:docs", "bing", "rust cargo"), ("site:a.com filetype:pdf", "bing", "site:a.com filetype:pdf"),
    ("(docker OR podman) compose after:2025 AROUND(2)", "bing", "docker OR podman compose"), ("a related:x.com b AROUND(3) c", "brave", "a b c"), ("Rust rust RUST async", "google", "Rust async"),
    ('"context deadline exceeded" site:github.com', "brave", '"context deadline exceeded" site:github.com'), ("wild* card", "brave", "wild card"), ("wild* card", "google", "wild* card"), ("plain words", "bing", "plain words"),
    ('"a * b" c', "brave", '"a b" c'), ("-site:x.com y", "bing", "-site:x.com y"), ("$200..1000 laptop", "bing", "$200..1000 laptop"), ("", "bing", ""), ("x cache:y", "tavily", "x cache:y"),
]
register("qrw4_rewrite", I.values([(i, e, w) for i, (_, e, w) in enumerate(REWRITES)], "id, engine, rewritten"))(
    lambda s, d: s.createDataFrame([(i, q, e) for i, (q, e, _) in enumerate(REWRITES)], "id int, q string, engine string").select("id", "engine", F.coalesce(*[F.when(F.col("engine") == e, R.rewrite(F.col("q"), e)) for e in R.SUPPORTED]).alias("rewritten"))
)
TOKENS = r"""regexp_extract_all(text, '(?:[^ \t\n\r"]|"[^"]*"|"[^"]*$)+')"""
register("qrw1_tokens", f"SELECT item_id, {TOKENS}[1:3][-1] AS third, CAST(len({TOKENS}) AS INTEGER) AS n FROM benchmark")(
    lambda s, d: I.table(s, d, "benchmark").select("item_id", F.element_at(F.slice(R.tokenize(F.col("text")), 1, 3), -1).alias("third"), F.size(R.tokenize(F.col("text"))).alias("n"))
)
KEYS = "('site', 'filetype', 'intitle', 'allintitle', 'inurl', 'allinurl', 'intext', 'related', 'cache', 'define', 'before', 'after', 'near', 'inanchor', 'inbody', 'loc', 'language')"
register("qrw2_classify", f"""SELECT kind, count(*) AS n FROM (SELECT unnest({TOKENS}) AS t FROM benchmark), LATERAL (SELECT CASE WHEN regexp_matches(t, '^-.') THEN 'exclusion' WHEN contains(t, '"') THEN 'quoted'
  WHEN lower(regexp_extract(t, '^([^:]+):', 1)) IN {KEYS} THEN 'keyvalue' WHEN regexp_matches(t, '^(?i)AROUND\\([0-9]+\\)$') THEN 'around' WHEN contains(t, '..') THEN 'range' WHEN lower(t) IN ('or', 'and') THEN 'boolean'
  WHEN regexp_matches(t, '[()]') THEN 'paren' WHEN contains(t, '*') THEN 'wildcard' ELSE 'plain' END AS kind) GROUP BY kind""")(
    lambda s, d: I.table(s, d, "benchmark").select(F.explode(R.tokenize(F.col("text"))).alias("t")).groupBy(R.classify(F.col("t")).alias("kind")).agg(F.count("*").alias("n"))
)
register("qrw3_support", f"""SELECT engine, keyword, CASE engine WHEN 'google' THEN keyword NOT IN ('cache', 'define') WHEN 'brave' THEN keyword IN ('site', 'filetype', 'intitle', 'inurl', 'intext', 'before', 'after') WHEN 'bing' THEN false ELSE true END AS supported
  FROM (SELECT unnest(['google', 'brave', 'bing', 'brave_api', 'tavily']) AS engine), (SELECT unnest({KEYS.replace('(', '[').replace(')', ']')}) AS keyword)""")(
    lambda s, d: s.createDataFrame([(k,) for k in R.KEYWORDS], "keyword string").select(F.explode(F.array(*[F.struct(F.lit(e).alias("engine"), R.keyword_supported(e, F.col("keyword")).alias("supported")) for e in R.SUPPORTED])).alias("x"), "keyword").select("x.engine", "keyword", "x.supported")
)


# --- rewriting over a table ------------------------------------------------------------
# Each benchmark text with a suffix that its number asks for, rewritten for the engine without operators of its own.

SUFFIX = "CASE item_id % 4 WHEN 0 THEN ' cache:x' WHEN 1 THEN ' (site:a.com)' WHEN 2 THEN ' near:3 AROUND(2) wild*' ELSE '' END"
register("qrw4_rewrite_texts", f"""
WITH q AS (SELECT item_id, text || {SUFFIX} AS text FROM benchmark), l AS (SELECT item_id, text, {TOKENS} AS toks FROM q),
t AS (SELECT item_id, text, i, toks[i] AS t FROM (SELECT *, unnest(range(1, len(toks) + 1)) AS i FROM l)),
k AS (SELECT *, CASE WHEN regexp_matches(t, '^-.') THEN 'exclusion' WHEN contains(t, '"') THEN 'quoted' WHEN lower(regexp_extract(t, '^([^:]+):', 1)) IN {KEYS} THEN 'keyvalue' WHEN regexp_matches(t, '^(?i)AROUND\\([0-9]+\\)$') THEN 'around'
  WHEN contains(t, '..') THEN 'range' WHEN lower(t) IN ('or', 'and') THEN 'boolean' WHEN regexp_matches(t, '[()]') THEN 'paren' WHEN contains(t, '*') THEN 'wildcard' ELSE 'plain' END AS kind FROM t),
d AS (SELECT *, kind = 'plain' AND row_number() OVER (PARTITION BY item_id, kind = 'plain', CASE WHEN kind = 'plain' THEN lower(t) END ORDER BY i) > 1 AS again FROM k),
x AS (SELECT *, CASE WHEN contains(t, '*') AND contains(t, '"') THEN regexp_replace(replace(t, '*', ''), ' +', ' ', 'g') ELSE replace(t, '*', '') END AS bare FROM d),
y AS (SELECT *, CASE WHEN kind = 'paren' THEN regexp_replace(bare, '[()]', '', 'g') ELSE bare END AS word FROM x),
r AS (SELECT item_id, any_value(text) AS text, string_agg(word, ' ' ORDER BY i) FILTER (WHERE word <> '' AND kind NOT IN ('keyvalue', 'around') AND NOT again) AS rewritten, bool_or(again) AS twice FROM y GROUP BY item_id)
SELECT item_id, CASE WHEN NOT regexp_matches(text, '["\\-:()*]') AND NOT contains(text, '..') AND NOT twice THEN text ELSE coalesce(rewritten, text) END AS rewritten FROM r""")(
    lambda s, d: I.table(s, d, "benchmark").select("item_id", R.rewrite(F.concat("text", F.expr(SUFFIX)), "bing").alias("rewritten"))
)
