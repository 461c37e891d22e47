"""Shards of near equal bytes by histogram sort, on DataFrame operations alone.

Rows are ordered by (hash of the text, id), so equal texts stand together.
Splitters are found by counting: each round sums, over all partitions, the exact
bytes that fall into finer key ranges around every splitter still open, and
narrows it to the range that its target falls into, until a boundary lies within
the tolerance or the range is a single text's.  A large group of equal texts is
split by id.  Then rows move once, straight to their place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.tables import Scratch, bound, count_passed, padded

_LOW = -(1 << 63)
_SPAN = 1 << 64
#: Bytes of a range, and so of one task's sort; ranges whose table (some 60 bytes each) is broadcast.
PART_BYTES, BROADCAST_RANGES = 128 << 20, 1 << 20


@dataclass
class _Open:
    """A splitter being narrowed: hashes in [lo, lo + width), or ids in it under one hash."""

    target: float
    lo: int = _LOW
    width: int = _SPAN
    hash: int | None = None
    below: int = 0


def _splitters(keys: DataFrame, targets: list[float], slack: float, whole: float, first_bits: int = 12, bits: int = 6) -> list[tuple[int, int]]:
    """For each target the key (hash, id) such that the bytes of smaller keys come near it."""
    spark = keys.sparkSession
    done: dict[float, tuple[int, int]] = {}
    todo = {t: _Open(t) for t in targets}
    step = first_bits
    while todo:
        by_hash = sorted({(o.lo, o.width) for o in todo.values() if o.hash is None})
        by_id = sorted({(o.hash, o.lo, o.width) for o in todo.values() if o.hash is not None})
        sums = [F.sum("size").alias("bytes"), F.min("h").alias("h0"), F.max("h").alias("h1"), F.min("k").alias("k0"), F.max("k").alias("k1")]
        found: dict[tuple, list] = {}
        if by_hash:  # all ranges of a round are equally wide powers of two, so a shift names them
            width = by_hash[0][1]
            shift = width.bit_length() - 1
            fine = shift - step
            flipped = F.col("h").bitwiseXOR(F.lit(_LOW))
            part = F.shiftrightunsigned(flipped, fine) if fine else flipped
            rows = keys.withColumn("part", part)
            if shift < 64:
                ranges = spark.createDataFrame([((lo - _LOW) >> shift if (lo - _LOW) >> shift < 1 << 63 else ((lo - _LOW) >> shift) - _SPAN,) for lo, _ in by_hash], "range long")
                rows = rows.join(F.broadcast(ranges), F.shiftrightunsigned(flipped, shift) == F.col("range"), "left_semi")
            for r in rows.groupBy("part").agg(*sums).collect():
                start = (r.part % _SPAN << fine) + _LOW
                found.setdefault((None, _LOW + ((start - _LOW) >> shift << shift)), []).append((start, 1 << fine, r))
        if by_id:
            ranges = spark.createDataFrame([(h, lo, lo + w - 1, -(-w // (1 << step))) for h, lo, w in by_id], "rh long, lo long, hi long, w long")
            rows = keys.join(F.broadcast(ranges), (F.col("h") == F.col("rh")) & F.col("k").between(F.col("lo"), F.col("hi")))
            rows = rows.withColumn("part", F.expr("(k - lo) div w"))
            for r in rows.groupBy("h", "lo", "w", "part").agg(F.sum("size").alias("bytes"), F.min("k").alias("k0"), F.max("k").alias("k1")).collect():
                found.setdefault((r.h, r.lo), []).append((r.lo + r.part * r.w, r.w, r))
        for t, o in list(todo.items()):
            below, at = o.below, None
            for start, width, r in sorted(found.get((o.hash, o.lo), []), key=lambda x: x[0]):
                at = (start, width, r, below)
                if below + r.bytes >= t:
                    break
                below += r.bytes
            if at is None:
                done[t] = (o.lo, _LOW) if o.hash is None else (o.hash, o.lo)
            else:
                start, width, r, below = at
                above = below + r.bytes
                # a single key, or a group of equal texts small enough to stay together
                one = r.k0 == r.k1 and (o.hash is not None or r.h0 == r.h1) or o.hash is None and r.h0 == r.h1 and r.bytes <= whole
                if one or min(t - below, abs(above - t)) <= slack:
                    end = start + width
                    key = start if t - below <= abs(above - t) else end
                    if o.hash is not None:
                        done[t] = (o.hash, key)
                    elif one:
                        done[t] = (r.h0, _LOW) if key == start else (min(r.h0 + 1, -_LOW - 1), _LOW)
                    else:
                        done[t] = (min(key, -_LOW - 1), _LOW)
                elif o.hash is None and r.h0 == r.h1:
                    todo[t] = _Open(t, r.k0, r.k1 - r.k0 + 1, r.h0, below)
                    continue
                else:
                    todo[t] = _Open(t, start, width, o.hash, below)
                    continue
            del todo[t]
        # hash ranges opened in this round all have the same width; those of an earlier round are gone
        step = bits if step == first_bits else min(bits, step)
        left = [o.width for o in todo.values() if o.hash is None]
        if left:
            step = min(step, min(left).bit_length() - 1)
    return [done[t] for t in targets]


def _placed(cuts: list[tuple[int, int]]) -> Column:
    """How many splitters a key (__h, __k) has reached."""
    steps = padded(cuts, (-_LOW - 1, -_LOW - 1))
    ladder = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(k).alias("k")) for h, k in steps])

    def found(key: Column) -> Column:
        return count_passed(lambda place: F.element_at(ladder, place), len(steps), lambda cut: (cut["h"] < key["h"]) | ((cut["h"] == key["h"]) & (cut["k"] <= key["k"])))

    return F.least(bound(F.struct(F.col("__h").alias("h"), F.col("__k").alias("k")), found), F.lit(len(cuts)))


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.002, whole: float = 0.1, part_bytes: int = PART_BYTES) -> DataFrame:
    """Place every row into shards 0 to ``shards - 1`` of near equal bytes, in one exchange.

    A row's size is its text's UTF-8 bytes plus 8 (a null text has none).  Returns
    the input's columns plus ``size`` and ``text_crc32`` (long; crc32 of the UTF-8
    bytes, 0 for null), ``shard`` (int) and ``slot`` (long; gapless from 0 within
    a shard), which replace input columns of these names.  Boundaries lie within
    ``tolerance`` of a shard's bytes of their targets, or next to the row or
    group that they would have to cut.  Equal texts share a shard, but for a group
    that meets a boundary and holds over ``whole`` of a shard's bytes: shards of
    near equal size can't hold it, so it is split by id.  Null ids order as -1.
    Repeated rows stand together.  An empty table gives an empty table.

    ``part_bytes``: the exchange cuts a shard into ranges of about so many bytes,
    each one task's sort, as many as the table needs; a range with more (a group of
    equal texts) is dealt on by id.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    size, crc = (F.octet_length(text) + 8).cast("long"), F.crc32(text.cast("binary"))
    h, k = F.xxhash64(text), F.coalesce(F.col(id_col).cast("long"), F.lit(-1))
    keys = scratch.save(docs.select(h.alias("__h"), k.alias("__k"), size.alias("size")), "keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    targets = [total * i / shards for i in range(1, shards)]
    plain = keys.select(F.col("__h").alias("h"), F.col("__k").alias("k"), "size")
    cuts = sorted(_splitters(plain, targets, tolerance * total / shards, whole * total / shards)) if total else [(_LOW, _LOW)] * (shards - 1)
    # ranges of a shard: its hashes' upper halves in equal steps
    fine = max(1, -(-total // (shards * part_bytes)))
    edges = [_LOW, *(c[0] for c in cuts), -_LOW - 1]
    starts = [e >> 32 for e in edges[:-1]]
    steps = [max(1, -(-((hi >> 32) - (lo >> 32) + 1) // fine)) for lo, hi in zip(edges, edges[1:], strict=False)]
    of_shard = lambda values: F.element_at(F.array(*[F.lit(x).cast("long") for x in values]), F.col("shard") + 1)

    def ranged(df: DataFrame) -> DataFrame:
        placed = df.withColumn("shard", _placed(cuts)).withColumn("__start", of_shard(starts)).withColumn("__step", of_shard(steps))
        return placed.withColumn("__range", F.expr("(shiftright(__h, 32) - __start) div __step")).drop("__start", "__step")

    small = shards * fine <= BROADCAST_RANGES
    dealt = F.pmod(F.xxhash64("__k"), F.col("__deals")).cast("int")
    deals = ranged(keys).groupBy("shard", "__range").agg(F.greatest(F.lit(1), F.ceil(F.sum("size") / (2 * part_bytes))).cast("int").alias("__deals"))
    deals = scratch.save(deals, "deals")
    counted = ranged(keys).join(F.broadcast(deals) if small else deals, ["shard", "__range"]).groupBy("shard", "__range", "__deals", dealt.alias("deal")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("__range", "deal").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    offsets = counted.groupBy("shard", "__range", "__deals").agg(F.map_from_entries(F.collect_list(F.struct("deal", "offset"))).alias("__offsets"))
    offsets = scratch.save(offsets, "offsets")
    scratch.drop("keys", "deals")

    names = ["size", "text_crc32", "shard", "slot"]
    columns = [c for c in docs.columns if c not in names]
    carried = ranged(docs.select(*columns, size.alias("size"), crc.alias("text_crc32"), h.alias("__h"), k.alias("__k")))
    carried = carried.join(F.broadcast(offsets) if small else offsets, ["shard", "__range"]).withColumn("__deal", dealt)
    place = F.row_number().over(Window.partitionBy("shard", "__range", "__deal").orderBy("__h", "__k"))
    return carried.withColumn("slot", F.col("__offsets")[F.col("__deal")] + place - 1).select(*columns, *names)
