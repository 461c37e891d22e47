"""Registered queries of captured pages and their texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import html as X
from gleaner.functions import jsonpath as J
from gleaner.functions import text as T
from gleaner.operators import pages as PG
from gleaner.plans import inputs as I
from gleaner.plans import oracle as O
from gleaner.plans.catalog import register
from gleaner.sinks import frames as FR

register("htm1_extract")(lambda s, d: I.table(s, d, "pages").select("page_id", X.page_udf()(F.col("html")).alias("p")).select("page_id", "p.title", "p.language", "p.full_text", F.size("p.headings").alias("n_headings")))
register("htm5_follow")(lambda s, d: PG.follow_pages(I.table(s, d, "pages")).select("page_id", "title", "content", "error", F.array_join("flags", ",").alias("flags")))
FOLLOWED = "CASE doc_id % 4 WHEN 0 THEN to_json(named_struct('title', source, 'content', text, 'error', '')) WHEN 1 THEN to_json(named_struct('title', source, 'error', concat('late ', doc_id))) WHEN 2 THEN to_json(named_struct('content', text, 'x', 1)) ELSE '{broken' END"
register("htm6_follow_json", """SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN source ELSE '' END AS title, md5(CASE WHEN doc_id % 4 IN (0, 2) THEN text ELSE '' END) AS content,
    CASE doc_id % 4 WHEN 1 THEN 'late ' || doc_id ELSE '' END AS error FROM documents""")(
    lambda s, d: I.table(s, d, "documents").select("doc_id", PG.follow_json(F.expr(FOLLOWED)).alias("f")).select("doc_id", "f.title", F.md5(F.col("f.content").cast("binary")).alias("content"), "f.error")
)
register("sec1_sections")(lambda s, d: PG.extract_pages(I.table(s, d, "pages")).select("page_id", F.posexplode("sections").alias("place", "s")).select("page_id", "place", "s.heading", "s.depth", "s.offset", "s.length", "s.parent"))
HEADING = "{t} <> '' AND strlen({t}) < 100 AND {t}[-1] NOT IN ('.', '!', '?') AND length({t}) - length(replace({t}, ' ', '')) < 12"
# lines stand as blocks of their own here, so a section is a heading line before a line that is none
register("sec3_plain_sections", f"""
WITH d AS (SELECT doc_id, string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)) AS blocks FROM documents WHERE strlen(replace(text, chr(10), chr(10) || chr(10))) >= 50),
b AS (SELECT doc_id, unnest(range(1, len(blocks) + 1)) AS i, blocks FROM d),
c AS (SELECT doc_id, i, blocks[i] AS own, blocks[i + 1] AS following, {O.trim('blocks[i]')} AS t, {O.trim('blocks[i + 1]')} AS u FROM b),
o AS (SELECT *, coalesce(sum(strlen(own) + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spot FROM c)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS place, t AS heading, CAST(spot AS BIGINT) AS starts, CAST(strlen(own) + 2 + strlen(following) AS BIGINT) AS length
FROM o WHERE {HEADING.format(t='t')} AND u <> '' AND NOT ({HEADING.format(t='u')})""")(lambda s, d: I.table(s, d, "documents").select("doc_id", F.posexplode(X.plain_sections_udf()(F.regexp_replace("text", "\n", "\n\n"))).alias("place", "s")).select("doc_id", "place", "s.heading", F.col("s.offset").alias("starts"), "s.length"))
register("harvest")(lambda s, d: PG.harvest(I.hits(s, d), I.table(s, d, "pages")).select("turn", "ord", "query", "body_status", "quality", "n_sections"))
register("src22_page_signals", f"""SELECT doc_id, array_to_string(list_filter({O.flags('h')}, lambda f: f <> 'EmptyShell'), ',') AS flags
    FROM (SELECT doc_id, text[1:2000] AS h FROM (WITH {I.TEXTS}
    SELECT * FROM texts))""")(lambda s, d: I.texts(s, d).select("doc_id", F.array_join(PG.page_signals(F.col("text")), ",").alias("flags")))
TAGGED = "regexp_replace(html, '<[A-Za-z/!?][^>\\n]{0,1022}>', '', 'g')"
register("txt2_strip_tags", f"SELECT page_id, md5({TAGGED.replace('0,1022', '0,999')}) AS text FROM pages")(
    lambda s, d: I.table(s, d, "pages").select("page_id", F.md5(T.strip_tags(F.col("html")).cast("binary")).alias("text"))
)
register("txt1_decode_entities", f"SELECT page_id, md5({O.entities('html', tuple(T.ENTITIES))}) AS text FROM pages")(
    lambda s, d: I.table(s, d, "pages").select("page_id", F.md5(T.decode_entities(F.col("html")).cast("binary")).alias("text"))
)
register("txt8_clean_snippet", f"""WITH {I.HITS} SELECT ord, {O.clean_snippet('s')} AS snippet
    FROM (SELECT ord, concat(snippet, CASE ord % 3 WHEN 0 THEN '...Read more' WHEN 1 THEN 'Read more'
    ELSE '' END) AS s FROM hits)""")(
    lambda s, d: I.hits(s, d).select("ord", T.clean_snippet(F.concat("snippet", F.when(F.col("ord") % 3 == 0, "...Read more").when(F.col("ord") % 3 == 1, "Read more").otherwise(""))).alias("snippet"))
)
register("txt9_clean_title", f"""WITH {I.HITS} SELECT ord, {O.clean_title('t')} AS title
    FROM (SELECT ord, concat(title, CASE WHEN ord % 2 = 0 THEN 'Example.com' ELSE ' https://x.y' END) AS t
    FROM hits)""")(lambda s, d: I.hits(s, d).select("ord", T.clean_title(F.concat("title", F.when(F.col("ord") % 2 == 0, "Example.com").otherwise(" https://x.y"))).alias("title")))
register("txt15_round_score", "SELECT l_orderkey, l_linenumber, round(l_tax * l_discount * 100) / 100 AS score FROM lineitem")(
    lambda s, d: I.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", T.round_score(F.col("l_tax") * F.col("l_discount")).alias("score"))
)
register("txt16_pdf_date", """SELECT event_id, CASE event_id % 4
    WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00'
    WHEN 1 THEN strftime(ts, '%Y-%m-%d') || 'T00:00:00+00:00'
    WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+05:30' END AS date FROM events""")(
    lambda s, d: I.table(s, d, "events").select("event_id", T.pdf_date(F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("D:"), F.date_format("ts", "yyyyMMddHHmmss"), F.lit("Z"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit("D:"), F.date_format("ts", "yyyyMMdd"))).when(F.col("event_id") % 4 == 2, F.concat(F.lit("D:"), F.date_format("ts", "yyyyMMddHHmmss"), F.lit("+05'30'"))).otherwise("yesterday")).alias("date"))
)
NESTED = "concat('{\"a\":{\"b\":[{\"c\":', o_custkey, '},{\"c\":', o_orderkey, '},{\"d\":1}]},\"s\":\"', o_orderstatus, '\",\"e\":[]}')"
register("txt18_dot_paths", """SELECT o_orderkey, '"' || o_orderstatus || '"' AS field, '[' || o_custkey || ',' || o_orderkey || ']' AS spread, '[{"c":' || o_custkey || '},{"c":' || o_orderkey || '},{"d":1}]' AS whole,
    '[{"c":' || o_custkey || '},{"c":' || o_orderkey || '},{"d":1}]' AS items, '[]' AS missing, '"' || o_orderstatus || '"' AS scalar, '[]' AS nothing FROM orders""")(
    lambda s, d: I.table(s, d, "orders").select("o_orderkey", *[J.apply_path(F.expr(NESTED), path).alias(name) for name, path in (("field", ".s"), ("spread", ".a.b[].c"), ("whole", ".a.b"), ("items", ".a.b[]"), ("missing", ".a.x.y"), ("scalar", ".s[]"), ("nothing", ".e[]"))])
)
register("txt18_dot_path", "SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, '[]' AS missing FROM events")(
    lambda s, d: I.table(s, d, "events").select("event_id", J.apply_path(F.col("props"), ".k").alias("k"), J.apply_path(F.col("props"), ".nothing[]").alias("missing"))
)
register("txt19_traceparent", """SELECT event_id, CASE
    WHEN event_id % 2 = 0 THEN md5(CAST(event_id AS VARCHAR)) END AS trace FROM events""")(
    lambda s, d: I.table(s, d, "events").select("event_id", T.traceparent_id(F.concat(F.lit("00-"), F.when(F.col("event_id") % 2 == 0, F.md5(F.col("event_id").cast("string").cast("binary"))).otherwise("xyz"), F.lit("-01"))).alias("trace"))
)
register("txt20_parse_bool", "SELECT event_id, event_id % 5 IN (0, 1, 3) AS value FROM events")(
    lambda s, d: I.table(s, d, "events").select("event_id", T.parse_bool(F.element_at(F.array(*map(F.lit, ("1", " TRUE ", "off", "Yes", ""))), (F.col("event_id") % 5 + 1).cast("int"))).alias("value"))
)
register("txt21_agent", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'mine' ELSE 'gleaner/1' END AS agent FROM events")(
    lambda s, d: I.table(s, d, "events").select("event_id", T.or_default(F.when(F.col("event_id") % 2 == 0, " mine ").otherwise("  "), "gleaner/1").alias("agent"))
)
register("txt24_error_codes", """SELECT event_type, count(*) AS n, CASE event_type
    WHEN 'error' THEN 'rate-limited' WHEN 'view' THEN 'captcha' ELSE 'engine-failed' END AS code FROM events
    GROUP BY event_type""")(lambda s, d: I.table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).select("event_type", "n", FR.error_code(F.when(F.col("event_type") == "error", "RateLimited").when(F.col("event_type") == "view", "Captcha").otherwise("Other")).alias("code")))
