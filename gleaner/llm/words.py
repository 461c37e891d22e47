"""Vectorised words, shingles and windows over Arrow string columns.

A word is a maximal run of bytes other than space and ``\\x09``-``\\x0D`` (the
same as ``[^\\x20\\x09-\\x0D]+`` on code points, since UTF-8 never uses these
bytes inside another character).  Everything works on the column's own byte
buffer, so no Python object is made per word.  Words, shingles, windows and
whole sequences are named by 64-bit hashes: polynomials over the ring of
integers modulo 2**64 with an odd base (invertible, so a prefix sum gives the
hash of any slice) followed by a mixing step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (xor-shift-multiply rounds)."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x ^= x >> U(27)
    x *= U(0x81DADEF4BC2DD44D)
    x ^= x >> U(33)
    return x


def _byte_values(lower: bool) -> np.ndarray:
    v = np.arange(256, dtype=U)
    if lower:
        v[65:91] += U(32)
    return mix((v + U(1)) * U(0xD6E8FEB86659FD93))


_VALUES = {low: _byte_values(low) for low in (False, True)}
_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False


class _Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, U)
        self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
                steps = np.full(n, U(base))
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


_POWERS = _Powers()


def slices_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of ``values[s:e]`` for each (s, e); equal slices have equal hashes."""
    up, down = _POWERS.get(len(values) + 1)
    sums = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


class Words:
    """Words of every row of a string column.

    ``starts``/``ends``: byte positions in ``data``; ``first``: index of each
    row's first word (one more entry than rows); ``hashes``: 64-bit names.
    """

    def __init__(self, column: pa.Array, lower: bool = False) -> None:
        self.data, self.offsets = column_bytes(column)
        n = len(self.data)
        inside = _IS_WORD[self.data]
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        edge = self.offsets[:-1][self.offsets[:-1] < n]
        opens[edge] = inside[edge]
        edge = edge[edge > 0] - 1
        closes[edge] = inside[edge]
        self.starts, self.ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.starts, self.offsets, side="left")
        self.hashes = np.empty(len(self.starts), U)
        table = _VALUES[lower]
        at = 0
        while at < len(self.starts):  # pieces keep the working arrays in cache and bounded
            to = max(at + 1, int(np.searchsorted(self.ends, self.starts[at] + _PIECE, side="right")))
            low = self.starts[at]
            self.hashes[at:to] = slices_hash(table[self.data[low : self.ends[to - 1]]], self.starts[at:to] - low, self.ends[at:to] - low)
            at = to

    def __len__(self) -> int:
        return len(self.first) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of ``k`` words inside one row, and the index of its first word."""
        n = len(self.hashes)
        if n < k:
            return np.zeros(0, U), np.zeros(0, np.int64)
        row_end = np.repeat(self.first[1:], np.diff(self.first))
        at = np.flatnonzero(np.arange(n) + k <= row_end)
        return slices_hash(self.hashes, at, at + k), at

    def sequences(self) -> np.ndarray:
        """Hash of each row's whole word sequence."""
        return slices_hash(self.hashes, self.first[:-1], self.first[1:])

    def shingle_sets(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct ``k``-word shingles of each row, one after another, and the rows' offsets.

        A row of one to ``k - 1`` words has its whole sequence as its only
        shingle; a row without words has none.
        """
        hashes, at = self.windows(k)
        n = self.counts()
        row = np.searchsorted(self.first[1:], at, side="right")
        short = np.flatnonzero((n > 0) & (n < k))
        bounds = np.searchsorted(row, np.arange(len(self) + 1))
        whole = self.sequences() if len(short) else None
        out, sizes = [], np.zeros(len(self) + 1, np.int64)
        for i in np.flatnonzero(n >= k):
            part = np.sort(hashes[bounds[i] : bounds[i + 1]])
            keep = np.empty(len(part), bool)
            keep[0] = True
            np.not_equal(part[1:], part[:-1], out=keep[1:])
            part = part[keep]
            out.append((i, part))
            sizes[i + 1] = len(part)
        for i in short:
            out.append((i, mix(whole[i : i + 1] + U(n[i]))))
            sizes[i + 1] = 1
        out.sort(key=lambda x: x[0])
        return (np.concatenate([x for _, x in out]) if out else np.zeros(0, U)), np.cumsum(sizes)


def pieces(batch: pa.RecordBatch, column: str, limit: int = 1 << 20):
    """Slices of a batch whose ``column`` holds about ``limit`` bytes (one row at least)."""
    at = batch.schema.get_field_index(column)
    if not batch.num_rows:
        return
    _, offsets = column_bytes(batch.column(at))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi
