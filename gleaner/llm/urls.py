"""URL rules as one bit-parallel wildcard automaton.

Every rule becomes globs; all globs together form one Shift-And automaton, a bit
for each position of each glob, packed into 64-bit words.  A byte of the URL
moves all of them at once: ``D = ((D << 1) | starts) & accepts[byte] | D & loops[byte]``,
and the same step runs for a whole batch of URLs as array operations.

Globs match the whole canonical URL (host, then path).  ``*`` is any run within
the host or a path segment (no ``/``), ``**`` any run at all, ``?`` one byte.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleaner.llm.words import U, column_bytes

_BLOCK = 4096


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def globs(self) -> list[str]:
        """The host itself and every subdomain, with paths that start with the rule's."""
        return [f"{self.text}**", f"*.{self.text}**"]


class Automaton:
    """All globs at once; :meth:`matches` tells which globs match which strings."""

    def __init__(self, globs: list[str]) -> None:
        accepts, loops, starts, self.ends = [], [], [], []
        every, segment = np.ones(256, bool), np.ones(256, bool)
        segment[ord("/")] = False
        # a state is entered by reading its byte; stars loop on the state before them, so each glob has a state for its beginning
        for glob in globs:
            raw, i = glob.encode(), 0
            starts.append(len(accepts))
            accepts.append(np.zeros(256, bool))
            loops.append(np.zeros(256, bool))
            while i < len(raw):
                c = raw[i : i + 1]
                if c == b"*":
                    wide = raw[i + 1 : i + 2] == b"*"
                    loops[-1] = loops[-1] | (every if wide else segment)
                    i += 1 + wide
                    continue
                byte = every.copy() if c == b"?" else np.arange(256) == c[0]
                accepts.append(byte)
                loops.append(np.zeros(256, bool))
                i += 1
            self.ends.append(len(accepts) - 1)
        self.size = len(accepts)
        self.words = -(-self.size // 64) or 1
        self.accepts, self.loops = self._pack(accepts), self._pack(loops)
        #: Ends that nothing leads away from: a string that holds no other states is decided.
        settled = np.zeros((256, self.size), bool)
        settled[0, [e for e in self.ends if loops[e].all()]] = True
        self.open = ~self._pack(list(settled.T))[0]
        begin = np.zeros((256, self.size), bool)
        begin[0, starts] = True
        self.begin = self._pack(list(begin.T))[0]

    def _pack(self, rows: list[np.ndarray]) -> np.ndarray:
        """Masks by byte: [256, words] from one boolean row a state."""
        table = np.zeros((256, self.words * 64), np.uint8)
        if rows:
            table[:, : self.size] = np.array(rows).T
        return np.packbits(table, axis=1, bitorder="little").view(U)

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """[strings, globs]: whether the glob matches all of the string."""
        out = np.zeros((len(offsets) - 1, len(self.ends)), bool)
        word, bit = np.array(self.ends, int) // 64, U(1) << (np.array(self.ends, int) % 64).astype(U)
        order = np.argsort(-np.diff(offsets), kind="stable")
        for lo in range(0, len(order), _BLOCK):
            rows = order[lo : lo + _BLOCK]  # longest first: those still being read are a prefix
            length, first = np.diff(offsets)[rows], offsets[:-1][rows]
            state = np.broadcast_to(self.begin, (len(rows), self.words)).copy()
            for at in range(int(length[0]) if len(rows) else 0):
                n = int(np.searchsorted(-length, -at, side="left"))
                if at % 64 == 0 and not (state[:n] & self.open).any():
                    break  # whatever is left to read changes nothing
                byte, now = data[first[:n] + at], state[:n]
                moved = now << U(1)
                if self.words > 1:
                    moved[:, 1:] |= now[:, :-1] >> U(63)
                state[:n] = moved & self.accepts[byte] | now & self.loops[byte]
            out[rows] = (state[:, word] & bit) != 0
        return out


def canonical(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    has = F.coalesce(url, F.lit("")).contains("://")
    rest = F.substring_index(F.substring(url, F.locate("://", url) + 3, F.length(url)), "?", 1)
    rest = F.substring_index(rest, "#", 1)
    host = F.substring_index(rest, "/", 1)
    path = F.substring(rest, F.length(host) + 1, F.length(rest))
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(has, lowered).otherwise(""), F.when(has, path).otherwise("")


def judge_urls(pages: DataFrame, rules: list[Rule], url_col: str = "url", default: str = "allow") -> DataFrame:
    """Apply URL rules; the longest matching rule decides, ``default`` where none matches.

    Returns the input's columns plus ``host``, ``path``, ``rule`` (its text, null
    where none matches) and ``verdict``; input columns of these names are
    replaced.  A null URL, or one without ``://``, has an empty host and path,
    which no rule with a host fits.  Rows are independent: repeated rows get
    equal verdicts, an empty table stays empty.  Of two rules of one length the
    first listed decides.
    """
    ranked = sorted(rules, key=lambda r: -len(r.text))
    held = pages.sparkSession.sparkContext.broadcast(Automaton([g for r in ranked for g in r.globs()]))
    texts, verdicts = [r.text for r in ranked] + [None], [r.verdict for r in ranked] + [default]
    names = ["host", "path", "rule", "verdict"]
    host, path = canonical(F.col(url_col))
    carried = pages.select(*[c for c in pages.columns if c not in names], host.alias("host"), path.alias("path"))
    kept = carried.columns

    def judge(batches):
        automaton = held.value
        for batch in batches:
            hosts, paths = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("host", "path"))
            data, offsets = column_bytes(pa.array([h + p for h, p in zip(hosts, paths, strict=True)], pa.large_string()))
            hit = automaton.matches(data, offsets).reshape(len(hosts), -1, 2).any(axis=2)
            first = np.where(hit.any(axis=1), hit.argmax(axis=1), len(ranked)) if ranked else np.zeros(len(hosts), int)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([texts[i] for i in first], pa.string()), pa.array([verdicts[i] for i in first], pa.string())], [*kept, "rule", "verdict"])

    return carried.mapInArrow(judge, StructType([*carried.schema.fields, *StructType.fromDDL("rule string, verdict string").fields]))
