"""Registered queries of accessibility trees and PDF bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import pdf as P
from gleaner.operators import ax as A
from gleaner.plans import inputs as I
from gleaner.plans.catalog import register

def tree_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """A tree a region: main > nation headings > supplier links with their text."""
    region, nation, supplier = (I.table(spark, sf, t) for t in ("region", "nation", "supplier"))
    sup = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    empty = F.array().cast("array<string>")
    sid, nid, rid = F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "r_regionkey")
    node = lambda place, i, role, name, kids, dom, props=F.lit("{}"): F.struct(place.cast("long").alias("place"), i.alias("node_id"), F.lit(role).alias("role"), name.alias("name"), F.lit(False).alias("ignored"), kids.alias("child_ids"), dom.cast("long").alias("backend_dom_id"), props.alias("properties"))
    links = sup.select(F.col("r_regionkey").cast("long").alias("page_id"), F.explode(F.array(
        node(F.col("s_suppkey") + 1000, sid, "link", F.col("s_name"), F.array(F.concat(F.lit("t"), "s_suppkey")), F.col("s_suppkey"), F.when(F.col("s_suppkey") % 3 == 0, '{"focused":true}').otherwise("{}")),
        node(F.col("s_suppkey") + 100000, F.concat(F.lit("t"), "s_suppkey"), "StaticText", F.col("s_name"), empty, F.lit(None)),
    )).alias("x"))
    kids = sup.groupBy("r_regionkey", "n_nationkey", "n_name").agg(F.transform(F.array_sort(F.collect_list("s_suppkey")), lambda k: F.concat(F.lit("s"), k)).alias("kids"))
    heads = kids.select(F.col("r_regionkey").cast("long").alias("page_id"), node(F.col("n_nationkey") + 10, nid, "heading", F.col("n_name"), F.col("kids"), F.col("n_nationkey"), F.lit('{"level":2}')).alias("x"))
    mains = kids.groupBy("r_regionkey").agg(F.array_sort(F.collect_list("n_nationkey")).alias("k")).select(F.col("r_regionkey").cast("long").alias("page_id"), node(F.lit(0), rid, "main", F.lit(""), F.transform("k", lambda k: F.concat(F.lit("n"), k)), F.lit(None)).alias("x"))
    return links.unionByName(heads).unionByName(mains).select("page_id", "x.*")


def tree_sql(limit: int) -> str:
    """Headings and their links in order, numbered as they stand; texts that repeat a link's name are hidden."""
    return f"""
WITH x AS (SELECT n_regionkey AS page_id, n_nationkey AS nk, n_name, s_suppkey AS sk, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
l AS (SELECT DISTINCT page_id, nk, -1 AS sk, 'heading "' || n_name || '" (h2)' AS body, '  ' AS pad, nk AS dom FROM x
  UNION ALL SELECT page_id, nk, sk, 'link "' || s_name || '"' || CASE WHEN sk % 3 = 0 THEN ' <focused>' ELSE '' END, '    ', sk FROM x),
o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY nk, sk) AS i FROM l),
t AS (SELECT page_id, count(*) + 1 AS total_nodes, string_agg(pad || '[' || i || '] ' || body, chr(10) ORDER BY i) FILTER (WHERE i < {limit}) AS lines, string_agg('[' || i || ']=' || dom, ' ' ORDER BY i) AS refs FROM o GROUP BY page_id)
SELECT CAST(page_id AS BIGINT) AS page_id, 'main' || coalesce(chr(10) || lines, '') || CASE WHEN total_nodes > {limit} THEN chr(10) || chr(10) || '... truncated ' || (total_nodes - {limit}) || ' nodes (max {limit}) ...' ELSE '' END
  || chr(10) || chr(10) || '# refs -> backendDOMNodeId' || chr(10) || refs AS tree, total_nodes, total_nodes > {limit} AS truncated FROM t"""


register("ax1_compress", tree_sql(500))(lambda s, d: A.compress_trees(tree_nodes(s, d)))
register("lim3_node_budget", tree_sql(3))(lambda s, d: A.compress_trees(tree_nodes(s, d), 3))
register("ax3_keep_self", """SELECT role, count(*) AS n FROM (SELECT 'link' AS role FROM supplier UNION ALL
    SELECT 'StaticText' FROM supplier UNION ALL SELECT 'heading' FROM (SELECT DISTINCT s_nationkey
    FROM supplier) UNION ALL SELECT 'main' FROM (SELECT DISTINCT n_regionkey FROM supplier
    JOIN nation ON s_nationkey = n_nationkey)) GROUP BY role""")(
    lambda s, d: tree_nodes(s, d).where(A.keep_self(F.col("role"), F.col("name"))).groupBy("role").agg(F.count("*").alias("n"))
)
register("ax2_nodes_array", "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN '[1,2]' ELSE '[]' END AS nodes FROM events")(
    lambda s, d: I.table(s, d, "events").select("event_id", A.nodes_array(F.element_at(F.array(*map(F.lit, ('{"result":{"nodes":[1,2]}}', '{"nodes":[1,2]}', "[1,2]", '{"x":1}'))), (F.col("event_id") % 4 + 1).cast("int"))).alias("nodes"))
)
SNAPS = """SELECT user_id AS page_id, event_id AS poll, event_type AS fingerprint, CASE WHEN value > 20 THEN 5
    ELSE 1 END AS n_nodes, event_id % 9 <> 0 AS has_root FROM events"""
register("ax8_settled", f"""WITH p AS ({SNAPS}), l AS (SELECT *, lag(fingerprint) OVER (PARTITION BY page_id
    ORDER BY poll) AS b FROM p) SELECT page_id, min(poll) FILTER (WHERE b = fingerprint AND n_nodes >= 2 AND has_root) AS settled_at, max(poll) AS last_poll
    FROM l GROUP BY page_id""")(
    lambda s, d: A.settled(s.sql(SNAPS.replace("FROM events", "FROM {events}"), events=I.table(s, d, "events")))
)
register("src21_ax_ready", f"""WITH p AS ({SNAPS})
    SELECT page_id, count(*) FILTER (WHERE has_root AND n_nodes >= 2) AS ready FROM p GROUP BY page_id""")(
    lambda s, d: s.sql(SNAPS.replace("FROM events", "FROM {events}"), events=I.table(s, d, "events")).groupBy("page_id").agg(F.count_if(A.ready(F.col("has_root"), F.col("n_nodes"))).alias("ready"))
)

PDF_HEAD = "%PDF-1.4\n1 0 obj << /Type /Catalog >> endobj\n2 0 obj << /Type /Page >> endobj\n3 0 obj << /Author (A \\(b\\)) /Title <FEFF00E9> /CreationDate (D:20240102030405Z) >> endobj\n4 0 obj << /Length 1 >> stream\nBT (Hello ) Tj (PDF) Tj ET\nendstream endobj\ntrailer << /Info 3 0 R >>"
register("pdf5_record", "SELECT r_regionkey, true AS is_pdf, 1 AS pages, 'A (b)' AS author, 'é' AS title, 'Hello PDF' AS text FROM region")(
    lambda s, d: I.table(s, d, "region").select("r_regionkey", P.record_udf()(F.lit(PDF_HEAD).cast("binary")).alias("p")).select("r_regionkey", "p.is_pdf", "p.pages", "p.author", "p.title", "p.text")
)
