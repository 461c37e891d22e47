"""Document quality by nearest-neighbour voting in a latent-semantic space.

A document is described by hashed terms on the shape of its writing: shapes of
words (runs of letters, capitals, digits and each mark), pairs of neighbouring
shapes, word lengths, repetition of near words, and its length and variety.
Weighted counts of a bounded sample of labelled documents are factored once
(truncated singular values); the labelled vectors are broadcast, and every
document's exact cosines with all of them come from blocked matrix products.
The ``neighbours`` most similar labelled documents vote, weighted by similarity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleaner.llm.words import _VALUES, U, Words, mix, pieces, slices_hash

#: Hashed terms, latent dimensions, voting neighbours, and the bound on labelled documents.
TERMS, RANK, NEIGHBOURS, SAMPLE = 2048, 48, 15, 8192

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("0") : ord("9") + 1] = ord("0")
_CLASS[128:] = ord("a")


def _shapes(words: Words) -> np.ndarray:
    """Hash of each word's shape: classes of its bytes, runs folded."""
    kind = _CLASS[words.data]
    keep = np.ones(len(kind), bool)
    np.not_equal(kind[1:], kind[:-1], out=keep[1:])
    keep[words.starts] = True
    place = np.zeros(len(kind) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    return slices_hash(_VALUES[False][kind[keep]], place[words.starts], place[words.ends])


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and count of each distinct term of each row, sorted by row and term."""
    words = Words(column)
    n = words.counts()
    row = np.repeat(np.arange(len(words)), n)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def put(rows: np.ndarray, family: int, values: np.ndarray) -> None:
        found.append((rows, mix(values.astype(U) * U(16) + U(family)) % U(TERMS)))

    if len(row):
        shape, h = _shapes(words), words.hashes
        put(row, 1, shape)
        same = row[1:] == row[:-1]
        put(row[1:][same], 2, mix(shape[:-1][same]) + shape[1:][same] * U(3))
        put(row, 3, np.minimum((words.ends - words.starts) // 3, 12))
        put(row[1:][same], 4, (h[1:] == h[:-1])[same])
        order = np.lexsort((h, row))
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
        distinct = np.bincount(row[order][fresh], minlength=len(words))
    else:
        distinct = np.zeros(len(words), np.int64)
    rows = np.arange(len(words))
    put(rows, 5, np.log2(n + 1).astype(int))
    put(rows, 6, (10 * distinct) // np.maximum(n, 1) + 16 * np.minimum(np.log2(n + 1).astype(int) // 2, 4))
    key = np.sort(np.concatenate([r.astype(U) * U(TERMS) + t for r, t in found]))
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    count = np.diff(np.append(first, len(key)))
    return (key[first] // U(TERMS)).astype(np.int64), (key[first] % U(TERMS)).astype(np.int64), count


class Model:
    """Term weights, projection, labelled vectors and their labels."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray, float]], neighbours: int) -> None:
        self.neighbours = min(neighbours, len(rows))
        table = np.zeros((len(rows), TERMS), np.float32)
        for i, (terms, counts, _) in enumerate(rows):
            table[i, terms] = 1 + np.log(counts)
        self.idf = (1 + np.log((1 + len(rows)) / (1 + (table > 0).sum(axis=0)))).astype(np.float32)
        table *= self.idf
        table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)
        rank = min(RANK, len(rows), TERMS)
        basis = table.T @ np.random.default_rng(0).standard_normal((len(rows), rank + 8)).astype(np.float32)
        for _ in range(4):  # subspace iteration on the labelled table
            basis, _ = np.linalg.qr(basis)
            basis = table.T @ (table @ basis)
        basis, _ = np.linalg.qr(basis)
        _, _, turn = np.linalg.svd(table @ basis, full_matrices=False)
        self.project = np.ascontiguousarray((basis @ turn.T)[:, :rank].astype(np.float32))
        self.known = self._unit(table @ self.project)
        self.labels = np.array([x for _, _, x in rows], np.float32)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def scores(self, column: pa.Array) -> np.ndarray:
        row, term, count = features(column)
        weight = ((1 + np.log(count)) * self.idf[term]).astype(np.float32)
        first = np.searchsorted(row, np.arange(len(column)))
        vectors = self._unit(np.add.reduceat(self.project[term] * weight[:, None], first, axis=0))
        out = np.zeros(len(column))
        for lo in range(0, len(vectors), 256):
            cosine = vectors[lo : lo + 256] @ self.known.T
            best = np.argpartition(-cosine, self.neighbours - 1, axis=1)[:, : self.neighbours]
            vote = np.maximum(np.take_along_axis(cosine, best, axis=1), 1e-6).astype(np.float64)
            out[lo : lo + 256] = (vote * self.labels[best]).sum(axis=1) / vote.sum(axis=1)
        return np.clip(out, 0, 1)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, neighbours: int = NEIGHBOURS) -> Model | None:
    """Fit on at most ``sample`` labelled documents, those with the smallest hashes of their ids.

    ``docs``: id, text; ``labels``: id, label (0 or 1).  Rows with a null id or
    label teach nothing; of an id that repeats, the text with the smallest hash
    does.  None where nothing is labelled.
    """
    chosen = labels.where("id IS NOT NULL AND label IS NOT NULL").groupBy("id").agg(F.max("label").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(sample)

    def describe(batches):
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                row, term, count = features(part.column("text"))
                ends = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (term, count)]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), part.column("text_hash"), *lists], ["id", "label", "text_hash", "terms", "counts"])

    found = docs.select("id", "text").join(F.broadcast(chosen), "id").select("id", "label", "text", F.xxhash64("text").alias("text_hash"))  # at most ``sample`` rows
    told = found.mapInArrow(describe, "id long, label int, text_hash long, terms array<int>, counts array<int>")
    table = told.groupBy("id").agg(F.min_by(F.struct("label", "terms", "counts"), "text_hash").alias("x")).select("id", "x.*").toArrow().sort_by("id")
    rows = [(t.values.to_numpy(), c.values.to_numpy(), float(x)) for t, c, x in zip(table.column("terms"), table.column("counts"), table.column("label").to_pylist(), strict=True)]
    return Model(rows, neighbours) if rows else None


def held_out(id_column: Column) -> Column:
    """Rows that no label is learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_quality(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``score`` (0 to 1, higher is better) of every whole text; replaces an input column of the name.

    The text alone decides, so repeated rows score alike.  Null texts count as
    empty; these score by their length's terms like any other.  Without a model
    (nothing labelled) every score is 0.5.  An empty table stays empty.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    carried = docs.select(*[c for c in docs.columns if c != "score"])
    columns = carried.columns

    def score(batches):
        for batch in batches:
            for part in pieces(batch, text_col, 1 << 20):
                column = part.column(part.schema.get_field_index(text_col))
                values = held.value.scores(column) if held.value else np.full(part.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values)], [*columns, "score"])

    return carried.mapInArrow(score, StructType([*carried.schema.fields, *StructType.fromDDL("score double").fields]))
