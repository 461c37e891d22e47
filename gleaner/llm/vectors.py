"""Exact top-k search by inner product: tiled matrix products, partial selection, tree merging.

Queries are cut into blocks and candidates into tiles, by hashes of their ids;
one exchange brings each block to each tile.  A task holds one block at a time,
streams a tile past it, keeps the best ``k`` of every query as it goes and hands
on one short list a query; the lists are merged in two levels.  Nothing passes
the driver but two counts.  Scores are sums of integer products held in doubles,
which is exact below 2**53.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Queries in a block, candidates multiplied at once, and tiles: so many candidates each, and at most so many.
BLOCK, TILE, TILE_ROWS, TILES = 1 << 14, 1 << 11, 1 << 13, 1 << 12


def quantised(vector: Column) -> Column:
    """``floor(256 x)`` of each component, as doubles."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("double"))


def usable(vector: Column) -> Column:
    """Not null, and no component null or non-finite."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


class _Best:
    """The best ``k`` candidates of each query so far: by score, then by smaller id."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.score = np.full((queries, k), -np.inf)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, score: np.ndarray, ids: np.ndarray, low: int = 0) -> None:
        """score: [queries from ``low`` on, tile]; -inf takes no part."""
        k = min(self.k, score.shape[1])
        bar = np.maximum(np.partition(score, -k, axis=1)[:, -k], self.score[low : low + len(score), -1])
        q, at = np.nonzero((score >= bar[:, None]) & (score > -np.inf))
        if not len(q):
            return
        rows = np.unique(q) + low
        s = np.concatenate([score[q, at], self.score[rows].ravel()])
        q = np.concatenate([q + low, np.repeat(rows, self.k)])
        i = np.concatenate([ids[at], self.id[rows].ravel()])
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        top = place < self.k
        self.score[q[top], place[top]], self.id[q[top], place[top]] = s[top], i[top]


def _by_size(batches: list[pa.RecordBatch]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of rows, by the vectors' length."""
    out: dict[int, list] = {}
    for batch in batches:
        column, names = batch.column("vector"), batch.column("id").to_numpy()
        offsets, flat = column.offsets.to_numpy(), column.flatten().to_numpy(zero_copy_only=False)
        size, starts = np.diff(offsets), offsets[:-1] - offsets[0]
        for d in np.unique(size):
            take = np.flatnonzero(size == d)
            out.setdefault(int(d), []).append((names[take], flat[starts[take][:, None] + np.arange(d)]))
    return {d: tuple(map(np.concatenate, zip(*found, strict=True))) for d, found in out.items()}


def _lists(best: dict, tile: int):
    """The lists of a cell, one row an entry."""
    for ids, _, top in best.values():
        q, place = np.nonzero(top.score > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(np.full(len(q), tile % 64, np.int32)), pa.array(top.id[q, place]), pa.array(top.score[q, place].astype(np.int64))], ["query_id", "part", "id", "score"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` best candidates of each query, over all vectors but the query's own.

    Both tables have ``id`` (long) and ``vector`` (array of doubles with integer
    values, of one length).  Returns ``query_id``, ``rank`` (from 1), ``id`` and
    ``score`` (long): ties go to the smaller id, and fewer candidates than ``k``
    give fewer rows.  Rows whose id or vector is null, or whose length differs
    from the query's, take no part.  Rows with the query's id are its own; an id
    that repeats among the queries is answered once, and repeated candidate rows
    are candidates each.  Empty tables give an empty result.
    """
    vectors = vectors.where("id IS NOT NULL AND vector IS NOT NULL").select("id", "vector")
    queries = queries.where("id IS NOT NULL AND vector IS NOT NULL").select("id", "vector").dropDuplicates(["id"])
    blocks = max(1, -(-queries.count() // BLOCK))
    tiles = min(TILES, max(1, -(-vectors.count() // TILE_ROWS)))  # larger ones beyond that: a tile is streamed, never held
    cell = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    asked = queries.select(part(blocks).alias("block"), cell(tiles).alias("tile"), F.lit(0).alias("side"), "id", "vector")
    tiled = vectors.select(cell(blocks).alias("block"), part(tiles).alias("tile"), F.lit(1).alias("side"), "id", "vector")
    met = asked.unionByName(tiled).repartition("block", "tile").sortWithinPartitions("block", "tile", "side", F.size("vector"))

    def scan(batches):
        """Cells one after another: first the queries of the block, then the tile's candidates."""
        at, asking, best, tile = None, [], {}, 0
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("block", "tile", "side")])
            edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for lo, hi in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if lo == hi:
                    continue
                rows, key = batch.slice(lo, hi - lo), tuple(keys[:2, lo])
                if key != at:
                    yield from _lists(best, tile)
                    at, asking, best, tile = key, [], {}, int(key[1])
                if keys[2, lo] == 0:
                    asking.append(rows)
                    continue
                if asking:
                    best = {d: (ids, found, _Best(len(ids), k)) for d, (ids, found) in _by_size(asking).items()}
                    asking = []
                for first in range(0, rows.num_rows, TILE):
                    for d, (names, candidates) in _by_size([rows.slice(first, TILE)]).items():
                        if d in best:
                            ids, found, top = best[d]
                            for low in range(0, len(ids), TILE):
                                score = found[low : low + TILE] @ candidates.T
                                score[ids[low : low + TILE, None] == names[None, :]] = -np.inf
                                top.add(score, names, low)
        yield from _lists(best, tile)

    found = met.mapInArrow(scan, "query_id long, part int, id long, score long")
    listed = found.select("query_id", "part", F.struct((-F.col("score")).alias("order"), "id").alias("x"))
    cut = lambda c: F.slice(F.array_sort(c), 1, k)
    merged = listed.groupBy("query_id", "part").agg(cut(F.collect_list("x")).alias("x"))
    merged = merged.groupBy("query_id").agg(cut(F.flatten(F.collect_list("x"))).alias("x"))
    return merged.select("query_id", F.posexplode("x").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("id"), (-F.col("x.order")).alias("score"))
