"""Shared plumbing: scratch tables in the cluster's shared folder, bit filters, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.words import U, mix

_LOCAL: dict[str, str] = {}
_MADE: list[Scratch] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Unset, it is an error on a cluster, whose machines share no temporary folder;
    a local session (tests, bench) gets a folder of its own.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: scratch tables need a folder that all machines share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="gleaner-")
    return _LOCAL[context.applicationId]


class Scratch:
    """Tables written once and read again, so that a lost executor costs one table's tasks at most."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/gleaner-{uuid.uuid4().hex}"
        _MADE.append(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")

    def _delete(self, at: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def made() -> int:
    """How many scratch folders there are so far; a mark for :func:`drop_since`."""
    return len(_MADE)


def drop_since(mark: int, keep: Scratch | None = None) -> None:
    """Delete the scratch folders made since the mark, once what was read from them is written or no longer needed."""
    for scratch in _MADE[mark:]:
        if scratch is not keep:
            scratch._delete(scratch.root)
    _MADE[mark:] = [keep] if keep in _MADE[mark:] else []


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def count_passed(entry: Callable[[Column], Column], size: int, passed: Callable[[Column], Column]) -> Column:
    """How many entries of a sorted array are passed, fewer than ``size``, a power of 2: a binary search.

    ``entry`` gives the entry of a place, counted from 1.  A fold over the steps'
    widths: steps written one on another would double the expression with each
    filter that is pushed below them.
    """
    widths = F.array(*[F.lit(1 << i) for i in reversed(range(size.bit_length() - 1))])
    return F.aggregate(widths, F.lit(0), lambda at, width: at + F.when(passed(entry(at + width)), width).otherwise(0))


def padded(values: list, last) -> list:
    """The values and as many of ``last`` as fill a power of 2, one more than the values at least."""
    size = 1
    while size <= len(values):
        size *= 2
    return [*values, *[last] * (size - len(values))]


def bit_filter(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """The set of values of a long column in ``[0, 2**bits)``, as packed bits on the driver.

    Its size is ``2**bits / 8`` bytes whatever the table holds; each task
    merges its own bits before the exchange.
    """
    value = F.col(column) + 1  # Spark's bitmaps begin at 1
    pages = df.groupBy(F.bitmap_bucket_number(value).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(value)).alias("bits"))
    out = np.zeros(max(1, (1 << bits) // 8), np.uint8)
    for batch in pages.toArrow().to_batches():
        for page, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            at = (page - 1) * 4096
            part = np.frombuffer(value.as_buffer(), np.uint8)[: len(out) - at]
            out[at : at + len(part)] = part
    return out


def in_filter(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each position's bit is set."""
    return (bits[(at >> at.dtype.type(3)).astype(np.int64)] >> (at & at.dtype.type(7)).astype(np.uint8)) & 1 == 1


def spots(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two positions in ``[0, 2**bits)`` for each 64-bit value."""
    values = mix(values.view(U) ^ U(0x5851F42D4C957F2D))
    return values >> U(64 - bits), mix(values) >> U(64 - bits)


def value_filter(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """A Bloom filter of a long column, two bits a value; ``2**bits / 8`` bytes."""

    def both(batches):
        for batch in batches:
            at = spots(np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)), bits)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(at).astype(np.int64))], ["spot"])

    return bit_filter(df.select(column).where(F.col(column).isNotNull()).mapInArrow(both, "spot long"), "spot", bits)


def maybe_in(filter_bits: np.ndarray, values: np.ndarray, bits: int) -> np.ndarray:
    """False only for values that :func:`value_filter` has not seen."""
    one, two = spots(np.ascontiguousarray(values), bits)
    hit = in_filter(filter_bits, one)
    hit[hit] = in_filter(filter_bits, two[hit])
    return hit


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Connected components of edges (a long, b long): (node, root), root the smallest node.

    Alternates large-star and small-star contractions until nothing moves;
    each round is aggregates with map-side combining and joins that can be
    split, written to the shared folder.  Nodes without edges are absent.
    """
    now = scratch.save(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    before, step = None, 0
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before, step = mark, step + 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.save(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), f"{name}-low-{step}a")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        large = scratch.save(large, f"{name}-large-{step}")
        low = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-low-{step}b")
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u != v")
        kept = scratch.save(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}", f"{name}-low-{step}a", f"{name}-low-{step}b", f"{name}-large-{step}")
        now = kept
    done = scratch.save(now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node"), name)
    scratch.drop(f"{name}-{step}")
    return done
