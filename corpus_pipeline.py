"""From raw documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and
is written as Parquet before the next one reads it.  All but the last return the
columns of ``documents``; repeated doc_ids after the mixing stage are copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.bpe import bpe_encode
from gleaner.llm.jaccard import drop_near_copies
from gleaner.llm.mixing import mix_sources
from gleaner.llm.quality import score_quality
from gleaner.llm.queries import quality_model
from gleaner.llm.repeats import remove_repeats
from gleaner.llm.tables import Scratch, drop_since, made


def _own(docs: DataFrame, *clashing: str) -> tuple[DataFrame, dict[str, str]]:
    """Documents with columns that an operator would replace put aside under names of their own, and those names."""
    aside = {c: f"__own_{c}" for c in clashing if c in docs.columns}
    return docs.withColumnsRenamed(aside), aside


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at 0.3 or more."""
    own, aside = _own(docs, "score")
    scored = score_quality(own, quality_model(spark, docs, sf_dir)).where("score >= 0.3")
    return scored.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard 0.8 or more."""
    return drop_near_copies(docs, shingle=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-word passages that an earlier document holds; other texts stay as they are."""
    own, aside = _own(docs, "n_words", "n_removed", "kept")
    lost = F.col("n_removed") > 0
    text = F.when(lost, F.col("kept")).otherwise(F.col("text"))
    cut = remove_repeats(own).withColumn("text", text)
    cut = cut.withColumn("n_chars", F.when(lost, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cut.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Equal shares of all sources, as many rows as before on average, in a global random order."""
    own, aside = _own(docs, "copies", "copy", "order_key")
    return mix_sources(own).select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of the bytes they decode to."""
    import public_tokenizers

    encoded = bpe_encode(docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)
    return encoded.select("doc_id", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("quality", keep_good), ("near_copies", keep_one_of_each), ("repeats", cut_repeats), ("mixing", mix), ("encoding", encode)]

#: No SQL: the classifier and the byte-level BPE can't be put in it; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written and read again; scratch tables of a stage go once it is written."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        mark = made()
        docs = scratch.save(stage(spark, docs, sf_dir), f"{i}-{name}")
        drop_since(mark)
        if i:
            scratch.drop(f"{i - 1}-{STAGES[i - 1][0]}")
    return docs
