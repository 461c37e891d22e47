"""The registered queries of this subpackage: one ``opN_<name>`` for each operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.fingerprints import fingerprints

    found = fingerprints(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_chars", F.col("edited_text_sha256").alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str):
    """The model on ``labels.quality``, without the held-out ids."""
    from gleaner.llm.quality import held_out, learn

    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("label"))
    return learn(docs.select(F.col("doc_id").alias("id"), "text"), labels.where(~held_out(F.col("id"))))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.quality import held_out, score_quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, quality_model(spark, docs, sf_dir))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.urls import Rule, judge_urls

    rules = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/")]
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = r"""
WITH u AS (
  SELECT page_id, coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', ['h', 'p']), {'h': '', 'p': ''}) AS x FROM pages),
s AS (SELECT page_id, translate(x.h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, x.p AS path FROM u),
r(verdict, rh, rp) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (
  SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict
  FROM s JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT s.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM s LEFT JOIN m USING (page_id)"""


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.jaccard import jaccard_groups

    found = jaccard_groups(table(spark, sf_dir, "documents"), shingle=3, percent=90)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
t AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
l AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM t a JOIN t b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
r(u, v) AS (SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u),
c AS (SELECT u, min(v) AS low FROM r GROUP BY u)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.u = d.doc_id"""


#: Target weights by a rule that holds for any sources: one to four, from the first digit of the name's md5.
OP5_WEIGHT = "CAST({} AS INTEGER) % 4 + 1"


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.mixing import mix_sources
    from gleaner.llm.tables import Scratch

    docs = table(spark, sf_dir, "documents")
    weight = OP5_WEIGHT.format("conv(substr(md5(CAST(source AS BINARY)), 1, 1), 16, 10)")
    weights = docs.select("source").distinct().select(F.col("source").alias("name"), F.expr(weight).alias("weight"))
    # whole documents are copied, shuffled and written; the result tells which and in what order
    mixed = Scratch(spark).save(mix_sources(docs, weights, seed=1), "mixed")
    return mixed.select("doc_id", "source", "copies", "copy", "order_key").orderBy("order_key")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from gleaner.llm.tokens import count_tokens

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.shards import shard

    placed = shard(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.vectors import quantised, top_k, usable

    vectors = table(spark, sf_dir, "embeddings").where(usable(F.col("embedding"))).select(F.col("vec_id").alias("id"), quantised(F.col("embedding")).alias("vector"))
    found = top_k(vectors, vectors.where("id % 50 = 0"), 5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5"""


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from gleaner.llm.bpe import bpe_encode

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False, digests=True)
    return encoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.repeats import remove_repeats

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, window=50).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d),
h AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS win FROM s),
f AS (SELECT doc_id, list(i) AS bad FROM (SELECT *, min(doc_id) OVER (PARTITION BY win) AS low FROM h) WHERE low < doc_id GROUP BY doc_id),
c AS (SELECT doc_id, list_distinct(flatten(list_transform(bad, lambda i: range(i, i + 50)))) AS gone FROM f),
g AS (
  SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, CASE WHEN gone IS NULL THEN w ELSE NULL END AS whole, gone, w
  FROM d LEFT JOIN c USING (doc_id)),
k AS (
  SELECT doc_id, string_agg(w[i], ' ' ORDER BY i) AS kept
  FROM (SELECT doc_id, w, gone, unnest(range(1, len(w) + 1)) AS i FROM g WHERE gone IS NOT NULL) WHERE NOT list_contains(gone, i) GROUP BY doc_id)
SELECT g.doc_id, n_words, n_removed, sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
FROM g LEFT JOIN k USING (doc_id)"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_fingerprints, op2_quality, op3_url_rules, op4_jaccard, op5_mixing, op6_token_counts, op7_shards, op8_top_k, op9_byte_bpe, op10_repeats, pipeline]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from gleaner.llm.mixing import mix_oracle

    return {"op3_url_rules": OP3_SQL, "op4_jaccard": OP4_SQL, "op5_mixing": mix_oracle(1, OP5_WEIGHT.format("('0x' || substr(md5(source), 1, 1))")), "op8_top_k": OP8_SQL, "op10_repeats": OP10_SQL}
