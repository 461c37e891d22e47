"""Removal of word passages that a document with a smaller id holds too.

Fixed-block anchors.  With windows of ``window`` words, every window holds a
whole block of the ``window // 2``-word blocks that its document is cut into.

1. *Index*: the hashes of all non-overlapping blocks, as a bit filter of fixed size.
2. *Probe*: every rolling ``window // 2``-word run of every document is looked up;
   hits are grouped by hash, and the hashes that a block and some other document
   share form a second, far sparser filter.
3. *Extend*: the windows around each shared anchor are named by hash.  A window
   is repeated if the smallest id that has it is smaller than the document's own.
   Adjoining repeated windows merge into the maximal repeats, whose words go.

The filters only save work: whatever they let through wrongly is settled by
the groupings, so the result is exact at any fill (up to equal 64-bit hashes
of different word runs).  No pairs of documents are ever formed: a passage that
N documents share costs N rows.  Texts move only for documents that lose words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleaner.llm.tables import Scratch, bit_filter, in_filter, maybe_in, value_filter
from gleaner.llm.words import U, Words, pieces

FILTER_BITS = 27


def _blocks(words: Words, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rolling runs: hash, first word, row, and whether the run is one of the fixed blocks."""
    hashes, at = words.windows(block)
    row = np.searchsorted(words.first[1:], at, side="right")
    return hashes, at, row, (at - words.first[row]) % block == 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Cut words covered by a ``window``-word run that also starts in a document with a smaller id.

    Returns the input's columns plus ``n_words``, ``n_removed`` (long) and
    ``kept`` (the kept words joined by one space); input columns of these names
    are replaced.  Windows are judged on the input.  Null texts have no words.
    Rows with a null id neither cause nor suffer removal.  Rows that share an id
    don't count as smaller than each other, so a repeated row changes nothing.
    An empty table gives an empty table.
    """
    block = window // 2
    spark = docs.sparkSession
    scratch = Scratch(spark)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = base.where(F.col("id").isNotNull() & F.col("text").isNotNull())
    shift = 64 - filter_bits

    def index(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                hashes, _, _, fixed = _blocks(Words(part.column("text")), block)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(hashes[fixed] >> U(shift)).astype(np.int64))], ["spot"])

    first = spark.sparkContext.broadcast(bit_filter(known.select("text").mapInArrow(index, "spot long"), "spot", filter_bits))

    def probe(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                hashes, _, row, fixed = _blocks(Words(part.column("text")), block)
                hit = np.flatnonzero(fixed | in_filter(first.value, hashes >> U(shift)))
                ids = part.column("id").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(hashes[hit].view(np.int64)), pa.array(ids[row[hit]]), pa.array(fixed[hit])], ["hash", "id", "fixed"])

    hits = known.mapInArrow(probe, "hash long, id long, fixed boolean")
    shared = hits.groupBy("hash").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.max("fixed").alias("fixed")).where("low < high AND fixed")
    second = spark.sparkContext.broadcast(value_filter(shared, "hash", filter_bits))

    def extend(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                words = Words(part.column("text"))
                hashes, at, row, _ = _blocks(words, block)
                near = maybe_in(second.value, hashes, filter_bits)
                wide, start = words.windows(window)
                runs = np.zeros(len(words.hashes) + 1, np.int64)
                runs[at[near] + 1] = 1
                np.cumsum(runs, out=runs)
                # an anchor may begin at any of the first window - block + 1 words of its window
                take = runs[start + window - block + 1] > runs[start]
                row = np.searchsorted(words.first[1:], start[take], side="right")
                ids = part.column("id").to_numpy()[row]
                pair = np.unique(np.rec.fromarrays([ids, wide[take]])) if take.any() else np.rec.fromarrays([ids, wide[take]])
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pair["f1"]).view(np.int64)), pa.array(np.ascontiguousarray(pair["f0"]))], ["hash", "id"])

    named = known.mapInArrow(extend, "hash long, id long")
    lowest = scratch.save(named.groupBy("hash").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").drop("high"), "lowest")
    lost = named.join(lowest, "hash").where("low < id").groupBy("id").agg(F.collect_set("hash").alias("lost"))
    lost = scratch.save(lost, "lost")
    scratch.drop("lowest")
    touched = spark.sparkContext.broadcast(value_filter(lost, "id", filter_bits))

    columns = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept")]
    carried = docs.select(*columns)
    out_schema = StructType([*carried.schema.fields, *StructType.fromDDL("n_words long, n_removed long, kept string").fields])

    def maybe(part: pa.RecordBatch) -> np.ndarray:
        ids = part.column(id_col)
        return maybe_in(touched.value, ids.fill_null(0).to_numpy().astype(np.int64), filter_bits) & ids.is_valid().to_numpy(zero_copy_only=False)

    def untouched(batches):
        for batch in batches:
            for part in pieces(batch, text_col):
                rest = part.filter(pa.array(~maybe(part)))
                yield _finish(rest, columns, text_col, None)

    def candidates(batches):
        for batch in batches:
            for part in pieces(batch, text_col):
                yield part.filter(pa.array(maybe(part)))

    def cut(batches):
        for batch in batches:
            for part in pieces(batch, text_col):
                words = Words(part.column(text_col))
                wide, start = words.windows(window)
                bounds = np.searchsorted(start, words.first)
                gone = np.zeros(len(words.hashes) + 1, np.int64)
                lists = part.column("__lost")
                for i in np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False)):
                    mine = wide[bounds[i] : bounds[i + 1]].view(np.int64)
                    bad = start[bounds[i] : bounds[i + 1]][np.isin(mine, lists[int(i)].values.to_numpy())]
                    gone[bad] += 1
                    gone[bad + window] -= 1
                stay = np.cumsum(gone)[:-1] == 0
                yield _finish(part, columns, text_col, [stay[words.first[i] : words.first[i + 1]] for i in range(len(words))])

    clean = carried.mapInArrow(untouched, out_schema)
    suspects = carried.mapInArrow(candidates, carried.schema).join(lost.select(F.col("id").alias(id_col), F.col("lost").alias("__lost")), id_col, "left")
    return clean.unionByName(suspects.select(*columns, "__lost").mapInArrow(cut, out_schema))


def _finish(part: pa.RecordBatch, columns: list[str], text_col: str, stay: list[np.ndarray] | None) -> pa.RecordBatch:
    """The carried columns with the counts and the kept words; ``stay`` marks kept words row by row."""
    kept, total, removed = [], [], []
    for i, text in enumerate(part.column(text_col).to_pylist()):
        words = text.encode().split() if text else []
        total.append(len(words))
        if stay is not None and not stay[i].all():
            words = [w for w, ok in zip(words, stay[i].tolist(), strict=True) if ok]
        removed.append(total[-1] - len(words))
        kept.append(b" ".join(words).decode())
    arrays = [part.column(part.schema.get_field_index(n)) for n in columns]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], [*columns, "n_words", "n_removed", "kept"])
