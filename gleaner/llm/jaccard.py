"""Exact Jaccard self-join on word shingles, as connected groups.

T-occurrence search.  Two sets of sizes m and n with Jaccard p % or more share
at least T(m, n) = ceil(p (m + n) / (100 + p)) shingles.  Shingles have one global
order, rare ones first.  With the T - l longest lists set aside, a pair must meet
l times on the others: the lists of a document's rarest n - ceil(p n / 100) + l
shingles are short and merged by one sorted exchange; the long ones are never
written out, DivideSkip probes them for the candidates that are left.

* A counter of fixed size, filled from every document, gives the order.  It may
  confuse shingles, which costs time but never a pair: any fixed order is right.
* Texts with equal shingle sets are one node, so exact copies are never compared.
* Where a node meets a partner for the l-th time or earlier, at place i of its order,
  they share at most n - i + l - 1 shingles, so an entry bounds its partner's size
  to m <= f.  Lists are split by ranges of sizes, and a node asks only the ranges
  that it may meet.  Nodes with shingles of their own bring these before the
  frequent ones, so a passage that many documents share joins nobody by itself.
* Each node is first searched against a few hubs: in each range of a list the node
  with the fewest rare shingles for its size, and one drawn by hash.  Verified links
  make components; then only pairs across components are listed, the smaller ones
  of a list asking.  A group of N near copies costs N searches, not N * N.  No link
  between different texts is lost: every pair that can meet is verified, connected
  already, or ruled out by its sizes.
* Lists that the counter calls long are salted, so no task holds such a list.
"""

from __future__ import annotations

from heapq import merge
from itertools import groupby
from math import log, log2

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gleaner.llm.tables import Scratch, components, maybe_in, value_filter
from gleaner.llm.words import U, Words, mix, pieces

COUNTER_BITS, SLICES, FILTER_BITS = 19, 32, 26
#: Lists of more documents are salted; bytes and members of sets in one search.
LONG_LIST, SEARCH_BYTES, SEARCH_MEMBERS = 1 << 12, 8 << 20, 128
#: Meetings asked of a pair on the short lists (fewer of sets too small for so many), and of a hub.
MEETINGS, HUB_MEETINGS = 2, 2
#: Hubs that a node is searched against; ranges of sizes per factor 100 / percent.
HUBS, RANGES = 2, 1


def _sets(part: pa.RecordBatch, k: int):
    """Rows of a piece with words: row index, node and shingles."""
    shingles, offsets = Words(part.column("text"), lower=True).shingle_sets(k)
    if not len(shingles):
        return
    sums = np.zeros(len(shingles) + 1, U)
    np.cumsum(mix(shingles ^ U(0xA24BAED4963EE407)), out=sums[1:])
    sizes = np.diff(offsets)
    nodes = mix((sums[offsets[1:]] - sums[offsets[:-1]]) ^ (sizes.astype(U) * U(0x9FB21C651E98DF25))).view(np.int64)
    for i in np.flatnonzero(sizes):
        yield int(i), int(nodes[i]), shingles[offsets[i] : offsets[i + 1]]


def required(m: int, n: int, percent: int) -> int:
    """Least overlap of sets of m and n elements with a Jaccard of ``percent`` / 100 or more."""
    return -(-percent * (m + n) // (100 + percent))


def divide_skip(query: np.ndarray, members: list[np.ndarray], percent: int) -> list[int]:
    """Members whose Jaccard with ``query`` reaches ``percent``; all arrays sorted and distinct.

    Lists of the query's elements over the members; the shorter lists are merged
    by a heap, members that can still reach their T are probed in the longer ones.
    """
    sizes = np.array([len(x) for x in members])
    need = -(-percent * (sizes + len(query)) // (100 + percent))
    values, owner = np.concatenate(members), np.repeat(np.arange(len(members)), sizes)
    at = np.searchsorted(query, values)
    at[at == len(query)] = 0
    hit = query[at] == values
    at, owner = at[hit], owner[hit]
    order = np.argsort(at, kind="stable")
    owner, bounds = owner[order], np.searchsorted(at[order], np.arange(len(query) + 1))
    length = np.diff(bounds)
    least = int(need.min())
    long = min(least - 1, int(least / (0.0085 * log2(max(2, length.max())) + 1)))
    by_length = np.argsort(-length, kind="stable")
    counts = np.zeros(len(members), np.int64)
    for member, group in groupby(merge(*(owner[bounds[i] : bounds[i + 1]].tolist() for i in by_length[long:] if length[i]))):
        counts[member] = sum(1 for _ in group)
    alive = np.flatnonzero(counts >= need - long)
    probed = np.sort(by_length[:long])
    if len(alive) < len(probed):  # a list's probe for one member is a probe of its element in the member
        for i in alive:
            own = members[i]
            spot = np.searchsorted(own, query[probed])
            spot[spot == len(own)] = 0
            counts[i] += int((own[spot] == query[probed]).sum())
    else:
        for left, i in zip(range(len(probed), 0, -1), probed, strict=True):
            alive = alive[counts[alive] + left >= need[alive]]
            own = owner[bounds[i] : bounds[i + 1]]
            if not len(alive):
                break
            if len(own):
                spot = np.minimum(np.searchsorted(own, alive), len(own) - 1)
                counts[alive] += own[spot] == alive
    return [int(i) for i in alive if counts[i] >= need[i]]


class _Join:
    def __init__(self, docs: DataFrame, shingle: int, percent: int) -> None:
        self.spark, self.docs, self.k, self.percent = docs.sparkSession, docs, shingle, percent
        self.scratch = Scratch(self.spark)

    def count(self) -> tuple[DataFrame, np.ndarray]:
        """Facts of each row (id, text_hash, node, n) and the counter, in one pass."""
        k = self.k
        names = ["id", "text_hash", "node", "n", "slice", "part", "counts"]

        def scan(batches):
            counter = np.zeros(1 << COUNTER_BITS, np.uint32)
            for batch in batches:
                for part in pieces(batch, "text"):
                    rows = part.num_rows
                    node, size = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
                    for i, name, shingles in _sets(part, k):
                        node[i], size[i] = name, len(shingles)
                        np.add.at(counter, (shingles >> U(64 - COUNTER_BITS)).astype(np.int64), 1)
                    facts = [part.column("id"), part.column("text_hash"), pa.array(node, mask=size == 0), pa.array(size)]
                    yield pa.RecordBatch.from_arrays([*facts, pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names)
            task = TaskContext.get().partitionId() % 512
            counts = pa.array([x.tobytes() for x in np.split(counter, SLICES)], pa.binary())
            yield pa.RecordBatch.from_arrays([*[pa.nulls(SLICES, pa.int64())] * 4, pa.array(range(SLICES), pa.int32()), pa.array([task] * SLICES, pa.int32()), counts], names)

        kind = "id long, text_hash long, node long, n long, slice int, part int, counts binary"
        both = self.scratch.save(self.docs.mapInArrow(scan, kind), "facts")

        def add(group: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x.as_buffer(), np.uint32).astype(np.uint64) for x in group.column("counts"))
            counts = pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())
            return pa.table({"slice": group.column("slice")[:1], "part": pa.array([0], pa.int32()), "counts": counts})

        slices = both.where("slice IS NOT NULL").select("slice", "part", "counts")
        for keys in (["slice", "part"], ["slice"]):
            slices = slices.groupBy(*keys).applyInArrow(add, "slice int, part int, counts binary")
        found = {r["slice"]: r["counts"] for r in slices.toArrow().to_pylist()}
        empty = bytes((4 << COUNTER_BITS) // SLICES)
        counter = np.concatenate([np.frombuffer(found.get(i, empty), np.uint32) for i in range(SLICES)])
        return both.where("slice IS NULL").select("id", "text_hash", "node", "n"), counter

    def lists(self, counter: np.ndarray) -> DataFrame:
        """Merged short lists with two nodes or more: (token, share, node, n, f).

        ``f`` is the largest size that a node met here, in one of the first meetings,
        can have to link; ``share`` is the number of salts of the list.
        """
        k, percent = self.k, self.percent
        shared = self.spark.sparkContext.broadcast(counter)
        long_list = max(LONG_LIST, 8 * int(counter.mean()))
        names = ["token", "lane", "size", "node"]

        def prefixes(batches):
            seen: set[int] = set()
            for batch in batches:
                for part in pieces(batch, "text"):
                    rows = []
                    for _, node, shingles in _sets(part, k):
                        if node in seen:
                            continue
                        seen.add(node)
                        weight = shared.value[(shingles >> U(64 - COUNTER_BITS)).astype(np.int64)]
                        n = len(shingles)
                        least = -(-percent * n // 100)
                        meetings = min(MEETINGS, least)
                        short = n - least + meetings
                        take = np.lexsort((shingles, weight))[:short]
                        most = (n + meetings - 1 - np.arange(short, dtype=np.int64)) * (100 + percent) // percent - n
                        share = -(-weight[take].astype(np.int64) // long_list)
                        salt = np.where(share > 1, 1 + node % np.maximum(share, 1), 0)
                        rows.append((shingles[take].view(np.int64), share << 32 | salt, n << 32 | most, np.full(short, node)))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows, strict=True)], names)

        def runs(batches):
            """Rows sorted by token, lane, size and node, without repeated ones and lists of one; the state is one row."""
            last = None  # token, lane, size, node, told
            for batch in batches:
                table = np.stack([batch.column(c).to_numpy() for c in names])
                fresh = np.ones(table.shape[1], bool)
                fresh[1:] = (table[:, 1:] != table[:, :-1]).any(axis=0)
                if last is not None and len(fresh):
                    fresh[0] = (table[:, 0] != last[0]).any()
                table = table[:, fresh]
                if not table.shape[1]:
                    continue
                same = (table[:2, 1:] == table[:2, :-1]).all(axis=0)
                tell = table[1] & 0xFFFFFFFF > 0
                tell[1:] |= same
                tell[:-1] |= same
                out = table[:, tell]
                if last is not None and (table[:2, 0] == last[0][:2]).all():
                    if not tell[0]:
                        out = np.concatenate([table[:, :1], out], axis=1)
                        tell[0] = True
                    if not last[1]:
                        out = np.concatenate([last[0][:, None], out], axis=1)
                token, lane, size, node = out
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (token, lane >> 32, node, size >> 32, size & 0xFFFFFFFF)], ["token", "share", "node", "n", "f"])
                last = table[:, -1].copy(), bool(tell[-1])

        single = self.docs.select("text").mapInArrow(prefixes, "token long, lane long, size long, node long")
        ordered = single.repartition("token", "lane").sortWithinPartitions(*names)
        return self.scratch.save(ordered.mapInArrow(runs, "token long, share long, node long, n long, f long"), "lists")

    def range_of(self, size: Column) -> Column:
        """The range of sizes that a size falls in."""
        return F.floor(F.log(size) * (RANGES / log(100 / self.percent))) if self.percent < 100 else size

    def needed(self, meetings: int) -> Column:
        """Meetings that a pair of sets of sizes n and m must have, of ``meetings`` asked."""
        return F.least(F.lit(meetings), *[F.ceil(F.col(c) * self.percent / F.lit(100.0)) for c in ("n", "m")])

    def asking(self, lists: DataFrame) -> DataFrame:
        """Entries once for each range of sizes that they may meet: with low, high and range."""
        bounds = lists.withColumn("low", F.ceil(F.col("n") * self.percent / F.lit(100.0))).withColumn("high", F.least("f", F.floor(F.col("n") * 100.0 / F.lit(self.percent))))
        return bounds.where("low <= high").withColumn("range", F.explode(F.sequence(self.range_of(F.col("low")), self.range_of(F.col("high")))))

    def verify(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, hub, n) that link, as edges (a, b)."""
        k, percent, scratch = self.k, self.percent, self.scratch
        wanted = self.spark.sparkContext.broadcast(value_filter(pairs.select(F.explode(F.array("a", "hub")).alias("node")), "node", FILTER_BITS))

        def sets(batches):
            seen: set[int] = set()
            for batch in batches:
                for part in pieces(batch, "text"):
                    rows = [(node, shingles) for _, node, shingles in _sets(part, k)]
                    ok = maybe_in(wanted.value, np.array([x for x, _ in rows], np.int64), FILTER_BITS) if rows else []
                    rows = [x for x, good in zip(rows, ok, strict=True) if good and not (x[0] in seen or seen.add(x[0]))]
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([s.tobytes() for _, s in rows], pa.binary())], ["node", "elements"])

        found = self.docs.select("text").mapInArrow(sets, "node long, elements binary").dropDuplicates(["node"])
        fill = F.ceil(F.greatest(F.sum("n") * 8 / SEARCH_BYTES, F.count("*") / SEARCH_MEMBERS)).cast("int")
        parts = scratch.save(pairs.groupBy("hub").agg(fill.alias("parts")), f"{name}-parts")
        members = pairs.join(parts, "hub").select("hub", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), F.col("a").alias("node"))
        hubs = parts.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("hub").alias("node"))
        asked = scratch.save(members.unionByName(hubs), f"{name}-asked")

        def search(group: pa.Table) -> pa.Table:
            hub = group.column("hub")[0].as_py()
            nodes = group.column("node").to_pylist()
            elements = [np.frombuffer(x.as_buffer(), U) for x in group.column("elements")]
            query = elements[nodes.index(hub)]
            rest = [i for i, node in enumerate(nodes) if node != hub]
            hits = [nodes[rest[i]] for i in divide_skip(query, [elements[i] for i in rest], percent)] if rest else []
            return pa.table({"a": pa.array(hits, pa.int64()), "b": pa.array([hub] * len(hits), pa.int64())})

        grouped = asked.join(found, "node").select("hub", "part", "node", "elements").groupBy("hub", "part")
        edges = scratch.save(grouped.applyInArrow(search, "a long, b long"), f"{name}-edges")
        scratch.drop(f"{name}-parts", f"{name}-asked")
        return edges

    def hubs(self, lists: DataFrame) -> DataFrame:
        """Pairs (a, hub, n): for each node the few hubs that most of its lists offer.

        A range of a list offers two hubs at most, whatever its length.
        """
        entry, drawn = F.struct(F.col("node").alias("hub"), F.col("n").alias("m"), F.col("f").alias("g"), "share"), F.xxhash64("node")
        offers = lists.groupBy("token", self.range_of(F.col("n")).alias("range")).agg(F.max_by(entry, F.struct(F.col("f") / F.col("n"), drawn)).alias("x"), F.max_by(entry, drawn).alias("y"))
        offers = offers.select("token", "range", F.explode(F.array_distinct(F.array("x", "y"))).alias("x")).select("token", "range", "x.hub", "x.m", "x.g", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest("x.share", F.lit(1)) - 1)).alias("salt"))
        asks = self.asking(lists).withColumn("salt", salt_of("node"))
        pairs = asks.join(offers, ["token", "range", "salt"]).where("node != hub AND m BETWEEN low AND high AND n <= g")
        pairs = pairs.groupBy("node", "hub").agg(F.count("*").alias("met"), F.first("n").alias("n"), F.first("m").alias("m"))
        pairs = pairs.where(F.col("met") >= self.needed(HUB_MEETINGS))
        best = pairs.groupBy("node").agg(F.first("n").alias("n"), F.slice(F.array_sort(F.collect_list(F.struct((-F.col("met")).alias("met"), "hub"))), 1, HUBS).alias("best"))
        return best.select(F.col("node").alias("a"), F.explode("best").alias("x"), "n").select("a", "x.hub", "n")

    def across(self, lists: DataFrame, groups: DataFrame) -> DataFrame:
        """Pairs (a, hub, n) of different components that a list brings together.

        In each list the entries outside its most frequent component ask; the
        entries in it are only asked.
        """
        rooted = self.scratch.save(lists.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
        mains = rooted.groupBy("token", "root").agg(F.count("*").alias("c"), F.max("share").alias("share"))
        mains = mains.groupBy("token").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.min("root").alias("least"), F.max("root").alias("most"), F.max("share").alias("share"))
        mains = self.scratch.save(mains.where("least != most").select("token", "main", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest("share", F.lit(1)) - 1)).alias("salt")), "mains")
        listed = self.scratch.save(rooted.withColumn("salt", salt_of("node")).join(mains, ["token", "salt"]), "listed")
        few = self.asking(listed.where("root != main").drop("salt")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest("share", F.lit(1)) - 1)))
        asked = listed.select("token", "salt", self.range_of(F.col("n")).alias("range"), F.col("node").alias("a"), F.col("n").alias("m"), F.col("f").alias("g"), F.col("root").alias("root2"))
        meet = "root != root2 AND (root2 = main OR node < a) AND m BETWEEN low AND high AND n <= g"
        pairs = few.join(asked, ["token", "range", "salt"]).where(meet)
        pairs = pairs.groupBy(F.least("a", "node").alias("hub"), F.greatest("a", "node").alias("a")).agg(F.count("*").alias("met"), F.max("n").alias("n"), F.max("m").alias("m"))
        pairs = pairs.where(F.col("met") >= self.needed(MEETINGS)).select("a", "hub", F.greatest("n", "m").alias("n"))
        pairs = self.scratch.save(pairs, "pairs")
        self.scratch.drop("rooted", "mains", "listed")
        return pairs

    def run(self) -> DataFrame:
        scratch = self.scratch
        facts, counter = self.count()
        lists = self.lists(counter)
        edges = self.verify(scratch.save(self.hubs(lists), "hubs"), "hub")
        groups = components(edges, scratch, "group")
        pairs = self.across(lists, groups)
        if not pairs.isEmpty():
            more = self.verify(pairs, "pair")
            if not more.isEmpty():
                groups = components(edges.unionByName(more), scratch, "all")
        owned = scratch.save(facts.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node")), "owned")
        own = F.struct(F.isnull("id").alias("none"), "id", "node", "text_hash")
        least = owned.where("root IS NOT NULL").groupBy("root").agg(F.min(own).alias("least"), F.min("id").alias("low"))
        least = scratch.save(least, "least")  # by itself, so that the join that follows can be split where a group is large
        first = F.col("node").isNull() | own.eqNullSafe(F.col("least"))
        done = owned.join(least, "root", "left").select("id", "node", F.col("n").alias("n_shingles"), F.coalesce("low", "id").alias("component_id"), first.alias("first"), "text_hash")
        done = scratch.save(done, "done")
        scratch.drop("facts", "lists", "hubs", "hub-edges", "group", "pairs", "pair-edges", "all", "owned", "least")
        return done


def salt_of(node: str) -> Column:
    """The salt of a node's entry in a list of ``share`` salts."""
    return F.pmod(F.xxhash64(node), F.greatest("share", F.lit(1)))


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents linked by a Jaccard of ``percent`` / 100 or more on ``shingle``-word shingles.

    Words are those of the text with A-Z lower-cased.  Returns one row per input
    row: ``id``, ``node`` (name of its shingle set; null without words),
    ``n_shingles``, ``component_id`` (smallest id reachable by links, its own
    included), ``first`` (whether the row stands for its group) and ``text_hash``.  Null, empty
    and blank texts have no shingles and link with nothing, each other included.
    A row with a null id links like any other and takes its group's id (null if
    none has one).  Repeated rows share a group.  An empty table gives an empty
    table.  Groups only: pairs that are connected already aren't verified, so links
    are neither listed nor counted.  Only the two named columns are read, so others may have any name.
    """
    text = F.col(text_col)
    return _Join(docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("text_hash")), shingle, percent).run()


def drop_near_copies(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``documents`` with one row of each group: that of the smallest doc_id.  Rows without words all stay.

    A row is known by its doc_id and the 64-bit hash of its text.  Only rows that
    go, and repeated ones of which one stays, are joined back.
    """
    rows = jaccard_groups(docs, shingle=shingle, percent=percent).where("node IS NOT NULL")
    marks = rows.groupBy(F.col("id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.bool_or("first").alias("__stays"), F.count("*").alias("__rows")).where("NOT __stays OR __rows > 1")
    known, names = docs.withColumn("__text_hash", F.xxhash64("text")), docs.columns
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash"))
    repeated = known.join(marks.where("__stays"), same).dropDuplicates(["__id", "__hash"])
    return known.join(marks, same, "left_anti").select(names).unionByName(repeated.select(names))
