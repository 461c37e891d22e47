"""Byte-level BPE encoding and decoding of whole texts.

Two tiers.  A pre-token that is itself in the vocabulary is resolved by a
minimal perfect hash over the vocabulary.  Every other pre-token is merged by a
heap of candidate pairs over a doubly linked list of its bytes, in
O(n log n) for n bytes, so a text without any break stays affordable.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from hashlib import sha256
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType
from xxhash import xxh3_64_intdigest

from gleaner.llm.words import U, mix, pieces

#: White_Space as the reference libraries' ``\s`` has it (Python's also counts U+001C to U+001F).
_SPACE = r"\t\n\x0B\f\r \x85\xA0  -     　"
#: Pre-tokens remembered by a worker, and the longest of them in bytes (about 100 MB together).
_MEMO = 400_000
_MEMO_BYTES = 64


def split_pattern(pattern: str) -> regex.Pattern:
    r"""The pre-token pattern with ``\s`` and ``\S`` spelled out."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            two = pattern[i : i + 2]
            out.append({r"\s": _SPACE if inside else f"[{_SPACE}]", r"\S": f"[^{_SPACE}]"}.get(two, two))
            i += 2
            continue
        inside = (inside or c == "[") and c != "]"
        out.append(c)
        i += 1
    return regex.compile("".join(out))


class PerfectHash:
    """Minimal perfect hash of byte strings by hash and displace.

    Buckets are placed from the largest to the smallest; each gets the first
    displacement that sends its keys to free slots.  A bucket of one key takes
    a free slot outright.
    """

    def __init__(self, keys: list[bytes]) -> None:
        self.keys, self.n, self.buckets = keys, len(keys), max(1, len(keys) // 3)
        codes = np.fromiter(map(xxh3_64_intdigest, keys), U, self.n)
        if len(np.unique(codes)) < self.n:
            raise ValueError("the vocabulary repeats a token")
        bucket = (codes % U(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        sizes = np.diff(bounds)
        slots, shifts = np.full(self.n, -1, np.int64), np.zeros(self.buckets, np.int64)
        tries = np.arange(64, dtype=U)
        for b in np.argsort(-sizes, kind="stable")[: int((sizes > 1).sum())]:
            mine, base = order[bounds[b] : bounds[b + 1]], 0
            while True:
                at = (mix(codes[mine][:, None] + (tries + U(base))) % U(self.n)).astype(np.int64)
                spread = np.sort(at, axis=0)
                good = np.flatnonzero((slots[at] < 0).all(axis=0) & (spread[1:] != spread[:-1]).all(axis=0))
                if len(good):
                    slots[at[:, good[0]]], shifts[b] = mine, base + good[0]
                    break
                base += len(tries)
        alone = np.flatnonzero(sizes == 1)
        free = np.flatnonzero(slots < 0)
        slots[free], shifts[alone] = order[bounds[alone]], -1 - free
        self.shifts, self.slots = shifts.tolist(), slots.tolist()

    def get(self, key: bytes) -> int:
        """Index of the key, or -1."""
        code = xxh3_64_intdigest(key)
        shift = self.shifts[code % self.buckets]
        if shift < 0:
            at = self.slots[-1 - shift]
        else:
            x = code + shift & 0xFFFFFFFFFFFFFFFF
            x ^= x >> 31
            x = x * 0x7FB5D329728EA185 & 0xFFFFFFFFFFFFFFFF
            x ^= x >> 27
            x = x * 0x81DADEF4BC2DD44D & 0xFFFFFFFFFFFFFFFF
            x ^= x >> 33
            at = self.slots[x % self.n]
        return at if self.keys[at] == key else -1


class Codec:
    """Encoder and decoder of one vocabulary (token bytes to rank)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.split = ranks, split_pattern(pattern)
        self.hash = PerfectHash(list(ranks))
        self.ids = list(ranks.values())
        self.token = {i: t for t, i in ranks.items()}
        self.decimal = {i: str(i) for i in self.ids}
        self.memo: dict[str, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}}

    def piece(self, piece: str) -> tuple[int, ...]:
        found = self.memo.get(piece)
        if found is None:
            raw = piece.encode()
            at = self.hash.get(raw)
            found = (self.ids[at],) if at >= 0 else tuple(self.merge(raw))
            if len(raw) <= _MEMO_BYTES:
                if len(self.memo) >= _MEMO:  # the oldest entries are the commonest pre-tokens
                    self.memo = dict(islice(self.memo.items(), _MEMO // 2))
                self.memo[piece] = found
        return found

    def merge(self, raw: bytes) -> list[int]:
        """Lowest rank first, leftmost first, over linked parts.

        Part i is ``raw[i:end[i]]``, so ``end`` links forward and ``before``
        back; a swallowed part ends at 0.  A heap entry packs rank, start and
        stop; it holds as long as two parts of today span start to stop.
        """
        n, rank = len(raw), self.ranks.get
        end, before = list(range(1, n + 1)), list(range(-1, n))
        bits = n.bit_length()
        mask = (1 << bits) - 1
        heap = [(r << bits | i) << bits | i + 2 for i in range(n - 1) if (r := rank(raw[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            top = heappop(heap)
            stop, i = top & mask, top >> bits & mask
            middle = end[i]
            if not 0 < middle < stop or end[middle] != stop:
                continue
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                after = end[stop]
                if (r := rank(raw[i:after])) is not None:
                    heappush(heap, (r << bits | i) << bits | after)
            j = before[i]
            if j >= 0 and (r := rank(raw[j:stop])) is not None:
                heappush(heap, (r << bits | j) << bits | stop)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[raw[i : end[i]]])
            i = end[i]
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        piece = self.piece
        for match in self.split.findall(text):
            out += self.memo.get(match) or piece(match)
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def read_ranks(lines) -> dict[bytes, int]:
    """Vocabulary of a ``.tiktoken`` file: base64 token and rank a line."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


@lru_cache(maxsize=2)
def load_codec(path: str, pattern: str) -> Codec:
    """Read a vocabulary on the driver; the tables are then broadcast (their size is the vocabulary's)."""
    with open(path, "rb") as f:
        return Codec(read_ranks(f), pattern)


def bpe_encode(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", keep_ids: bool = True, digests: bool = False) -> DataFrame:
    """Encode each whole text, then decode the ids.

    Returns the input's columns plus ``n_tokens`` (long), ``ids`` (array of
    int, if ``keep_ids``), ``ids_text`` (decimal ids joined by one space) and
    ``decoded`` (binary), or with ``digests`` the lowercase hex SHA-256 of these
    two, ``ids_sha256`` and ``decoded_sha256``, made where they are; input columns
    of these names are replaced.  A null
    text counts as empty: no tokens, empty ids, empty bytes.  Rows are
    independent, so repeated rows and an empty table need no care.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_codec(vocabulary, pattern))
    more = "n_tokens long, " + "ids array<int>, " * keep_ids + ("ids_sha256 string, decoded_sha256 string" if digests else "ids_text string, decoded binary")
    own = [f.name for f in StructType.fromDDL(more).fields]
    carried = docs.select(*[c for c in docs.columns if c not in own])
    columns = carried.columns

    def encode(batches):
        codec = shared.value
        for batch in batches:
            for part in pieces(batch, text_col, 1 << 20):
                rows = [codec.encode(t or "") for t in part.column(text_col).to_pylist()]
                arrays = [part.column(part.schema.get_field_index(c)) for c in columns]
                arrays.append(pa.array([len(x) for x in rows], pa.int64()))
                if keep_ids:
                    arrays.append(pa.array(rows, pa.list_(pa.int32())))
                written, decoded = (" ".join(map(codec.decimal.__getitem__, x)) for x in rows), (codec.decode(x) for x in rows)
                if digests:
                    arrays += [pa.array([sha256(x.encode()).hexdigest() for x in written], pa.string()), pa.array([sha256(x).hexdigest() for x in decoded], pa.string())]
                else:
                    arrays += [pa.array(list(written), pa.string()), pa.array(list(decoded), pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, [*columns, *own])

    return carried.mapInArrow(encode, StructType([*carried.schema.fields, *StructType.fromDDL(more).fields]))
