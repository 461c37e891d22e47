"""Document fingerprints by locally consistent parsing.

Each level cuts a sequence of symbols into phrases of a few symbols and names
every phrase by a hash of its content; the names are the next level's symbols.
Cuts come from deterministic coin tossing: runs of one symbol are folded first,
so neighbours differ; a symbol's label is then twice the lowest bit in which it
differs from its left neighbour, plus that bit.  A few rounds leave six labels,
and every local maximum of the labels begins a phrase.  A cut depends on a
constant number of neighbours only, so equal substrings are cut alike inside,
wherever they stand.

The fingerprint of a text is its multiset of phrase names from the second level
up (texts too short for it: their topmost name), thinned to the ``keep`` smallest
hashes.  The likeness of two fingerprints is the Dice coefficient of the multisets
as that sketch shows it: 1 for equal texts, near 0 for unrelated ones.  Texts of up
to ``keep`` names (some 600 characters for 64) compare exactly; for longer ones it
is an estimate whose standard error is at most 0.5 / sqrt(keep), 0.06 for 64.
The parse works on whole texts, some 80 bytes of working memory a character.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.tables import count_passed, padded
from gleaner.llm.words import U, mix

KEEP, BATCH = 64, 1 << 18


def _reduce(labels: int) -> np.ndarray:
    """Table from (left label, own label) to the next round's label."""
    left, own = np.meshgrid(np.arange(labels), np.arange(labels), indexing="ij")
    differ = left ^ own
    bit = np.where(differ, np.log2(np.maximum(differ & -differ, 1)).astype(int), 0)
    return (2 * bit + (own >> bit & 1)).astype(np.uint8)


_ROUNDS = [_reduce(128), _reduce(16), _reduce(8)]  # at most 128 labels -> 14 -> 8 -> 6
_PLACES = mix(np.arange(1, 4097, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def _cuts(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether each symbol begins a phrase; ``starts``: first symbols of the sequences."""
    differ = symbols[1:] ^ symbols[:-1]
    low = differ & (~differ + U(1))
    bit = np.bitwise_count(low - U(1))
    bit[low == 0] = 0  # only across two sequences
    label = np.empty(len(symbols), np.uint8)
    label[1:] = 2 * bit + ((symbols[1:] >> bit.astype(U)) & U(1)).astype(np.uint8)
    label[starts] = (symbols[starts] & U(1)).astype(np.uint8)
    for table in _ROUNDS:
        new = np.empty_like(label)
        new[1:] = table[label[:-1], label[1:]]
        new[starts] = label[starts] & 1
        label = new
    cut = np.zeros(len(label), bool)
    cut[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    ends = starts[1:] - 1
    cut[ends] = False
    cut[starts] = True
    return cut


def _named(symbols: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Hash of each phrase's content, order and length."""
    length = np.diff(np.append(firsts, len(symbols)))
    place = np.arange(len(symbols)) - np.repeat(firsts, length)
    return mix(np.add.reduceat(mix(symbols) * _PLACES[place % 4096], firsts) + length.astype(U))


def _folded(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of one symbol become a symbol of their own; also the new starts."""
    begin = np.ones(len(symbols), bool)
    np.not_equal(symbols[1:], symbols[:-1], out=begin[1:])
    begin[starts] = True
    if begin.all():
        return symbols, starts
    at = np.flatnonzero(begin)
    run = np.diff(np.append(at, len(symbols)))
    out = symbols[at].copy()
    long = run > 1
    out[long] = mix(out[long] + run[long].astype(U) * U(0xC2B2AE3D27D4EB4F))
    return out, np.searchsorted(at, starts)


def sketches(texts: list[str], keep: int = KEEP) -> list[np.ndarray]:
    """Sorted ``keep`` smallest 32-bit names of each text; an empty text has none."""
    out = [np.zeros(0, np.uint32)] * len(texts)
    full = [i for i, t in enumerate(texts) if t]
    if not full:
        return out
    symbols = np.frombuffer("".join(texts[i] for i in full).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U) + U(1)
    starts = np.cumsum([0] + [len(texts[i]) for i in full[:-1]])
    owner, found, level = np.arange(len(full)), [], 0
    while len(symbols):
        if level >= 2:
            found.append((owner.repeat(np.diff(np.append(starts, len(symbols)))), symbols))
        single = np.diff(np.append(starts, len(symbols))) == 1
        if single.any():  # parsed to the top
            if level < 2:
                found.append((owner[single], symbols[starts[single]]))
            rest = np.ones(len(symbols), bool)
            rest[starts[single]] = False
            kept = np.cumsum(rest) - rest
            owner, starts, symbols = owner[~single], kept[starts[~single]], symbols[rest]
            if not len(symbols):
                break
        symbols, starts = _folded(symbols, starts)
        cut = _cuts(symbols, starts)
        firsts = np.flatnonzero(cut)
        starts = np.searchsorted(firsts, starts)
        symbols = _named(symbols, firsts)
        level += 1
    # a name's k-th occurrence is an element of its own, so that lengths count
    key = np.sort(np.concatenate([o.astype(U) << U(40) | s >> U(24) for o, s in found]))
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    nth = np.arange(len(key)) - np.repeat(begin, np.diff(np.append(begin, len(key))))
    key = np.unique((key >> U(40)) << U(32) | mix((key & U(0xFFFFFFFFFF)) + (nth.astype(U) << U(40))) >> U(32))
    text = (key >> U(32)).astype(np.int64)
    bounds = np.searchsorted(text, np.arange(len(full) + 1))
    low = (key & U(0xFFFFFFFF)).astype(np.uint32)
    for k, i in enumerate(full):
        out[i] = low[bounds[k] : min(bounds[k + 1], bounds[k] + keep)]
    return out


def likeness(a: np.ndarray, b: np.ndarray, keep: int = KEEP) -> float:
    """Dice coefficient of two name sets, from their ``keep`` smallest names."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    twice = np.zeros(len(both), bool)
    np.equal(both[1:], both[:-1], out=twice[1:])
    distinct = np.cumsum(~twice)
    use = min(keep, int(distinct[-1])) if max(len(a), len(b)) >= keep else int(distinct[-1])
    j = int(twice[distinct <= use].sum()) / use
    return 2 * j / (1 + j)


def written(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last floor(n / 2) characters replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, ranges: int) -> DataFrame:
    """Rows (part, last, id, text), in an order by (part, last, id, text) where each row but a part's last is followed by the next document.

    Ids are cut into ranges at quantiles that are ids themselves; the first id
    of a range goes to the range before it as well, and the very first to the
    last, so that neighbours meet in one exchange and no sort is global.
    """
    known = docs.agg(F.percentile_approx("id", [i / ranges for i in range(1, ranges)], 10 * ranges).alias("cuts"), F.min("id").alias("low"), F.count(F.when(F.isnull("id"), 1)).alias("nulls")).first()
    low = None if known.nulls else known.low
    cuts = sorted({x for x in known.cuts or [] if x != low})
    n = len(cuts)
    steps = padded(cuts, (1 << 63) - 1)
    ladder = F.array(*[F.lit(c).cast("long") for c in steps])
    place = F.least(count_passed(lambda at: F.element_at(ladder, at), len(steps), lambda c: c <= F.col("id")), F.lit(n))
    placed = docs.select("id", "text", F.coalesce(place, F.lit(0)).alias("__part"))
    part = F.col("__part")
    first = F.isnull("id") if known.nulls else F.col("id") == F.lit(low)
    copies = F.array(F.struct(part.alias("part"), F.lit(0).alias("last")), F.struct((part - 1).alias("part"), F.lit(1).alias("last")), F.struct(F.lit(n).alias("part"), F.lit(1).alias("last")))
    wanted = F.filter(copies, lambda c: (c["last"] == 0) | ((c["part"] == part - 1) & F.col("id").isin(cuts or [None]) & ~first) | ((c["part"] == n) & first))
    return placed.select("id", "text", F.explode(wanted).alias("to")).select("to.part", "to.last", "id", "text").repartition("part").sortWithinPartitions("part", "last", F.col("id").asc_nulls_first(), "text")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: int = KEEP, ranges: int | None = None) -> DataFrame:
    """Fingerprint every whole text, and its text edited with the next document's.

    Returns ``id``, ``n_chars``, ``fingerprint``, ``edited_text_sha256``,
    ``edited_fingerprint``, ``near_edited`` and ``near_next``.  The next document
    is that with the next id (after the last: the first; alone: itself).  Null
    texts count as empty; empty texts have the empty fingerprint, which is like
    itself (1) and unlike any other (0).  Null ids come first.  Rows that share an
    id follow one another by text, so a repeated row's next may be its copy.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def scan(batches):
        def told(rows):
            """All rows but the last have their next document in ``rows``."""
            texts = [r[3] for r in rows]
            ask = [edited(t, u) if rows[i][0] == rows[i + 1][0] else "" for i, (t, u) in enumerate(zip(texts, texts[1:], strict=False))]
            own = sketches(texts, keep)
            new = sketches(ask, keep)
            for i, text in enumerate(ask):
                part, last, name, whole = rows[i]
                if not last and rows[i + 1][0] == part:
                    yield name, len(whole), written(own[i]), hashlib.sha256(text.encode()).hexdigest(), written(new[i]), likeness(own[i], new[i], keep), likeness(own[i], own[i + 1], keep)

        waiting, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("part", "last", "id", "text")), strict=True):
                if waiting and waiting[-1][0] == row[0] and waiting[-1][1] == 1:
                    continue  # one following row is enough where ids repeat
                waiting.append(row)
                size += len(row[3])
                if size > BATCH and len(waiting) > 1:
                    yield _table(told(waiting))
                    waiting, size = waiting[-1:], len(row[3])
        if len(waiting) > 1:
            yield _table(told(waiting))

    return with_next(base, ranges).mapInArrow(scan, "id long, n_chars long, fingerprint string, edited_text_sha256 string, edited_fingerprint string, near_edited double, near_next double")


def _table(rows) -> pa.RecordBatch:
    names = ["id", "n_chars", "fingerprint", "edited_text_sha256", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
