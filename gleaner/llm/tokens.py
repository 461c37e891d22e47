"""Token counts of whole texts with a published tokenizer, huge texts in overlapping chunks.

A text over ``chunk`` characters is encoded in chunks that overlap.  Two
neighbours are spliced at a position p that both hold as the start of a
pre-token, away from either edge.  Such a p is proven stable: pre-tokens are
matched left to right and never look back, the left chunk sees the character
that ends the pre-token before p, and whatever the right chunk does from p on
depends on the text from p on alone; merges never cross pre-tokens.  ``margin``
characters keep special strings (shorter than that) from being cut at an edge.
Where no such p exists, the left chunk starts anew at the last proven boundary
and grows to twice its length, and the search goes on: the overlap widens as far
as it must, and a text without any break is encoded a few times at most.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from gleaner.llm.bpe import split_pattern
from gleaner.llm.words import pieces

CHUNK, OVERLAP, MEMO = 1 << 15, 1 << 9, 400_000
#: Pre-tokens of a byte-level tokenizer file.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class TokenizerCounter:
    """Counts with a ``tokenizers`` file, given as its text.

    Where the file's pre-tokens are those of a plain byte-level pattern, each
    distinct pre-token is given to the library once and its count remembered.
    """

    def __init__(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(text)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.chunk, self.overlap = chunk, overlap
        made = json.loads(text)
        special = [t["content"] for t in made.get("added_tokens") or []]
        self.margin = 2 + max(map(len, special), default=0)
        before = made.get("pre_tokenizer") or {}
        plain = all(t["special"] and not (t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]) for t in made.get("added_tokens") or [])
        known = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        self.split = split_pattern(BYTE_LEVEL) if known and plain and not made.get("normalizer") else None
        self.special = special
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.memo: dict[str, int] = {}

    def _learn(self, found: set[str]) -> None:
        if len(self.memo) >= MEMO:  # the oldest are the commonest
            self.memo = dict(islice(self.memo.items(), MEMO // 2))
        new = list(found)
        self.memo.update(zip(new, map(len, self.tok.encode_batch_fast(new, add_special_tokens=False)), strict=True))

    def _parts(self, text: str) -> list[str]:
        """Pre-tokens and special strings, which together are the text."""
        if self.at_special and any(x in text for x in self.special):
            return [p for i, part in enumerate(self.at_special.split(text)) for p in ([part] if i % 2 else self.split.findall(part))]
        return self.split.findall(text)

    def counts(self, texts: list[str]) -> list[int]:
        short = [t for t in texts if len(t) <= self.chunk]
        if self.split:
            parts = [self._parts(t) for t in short]
            memo = self.memo
            missing = {p for row in parts for p in row if p not in memo}
            self._learn(missing)
            # texts without anything to learn are the rule; a memo cut back meanwhile is learnt again
            found = iter([self._sum(row) for row in parts])
        else:
            found = iter([len(e) for e in self.tok.encode_batch_fast(short, add_special_tokens=False)])
        return [next(found) if len(t) <= self.chunk else self.long(t) for t in texts]

    def _sum(self, row: list[str]) -> int:
        try:
            return sum(map(self.memo.__getitem__, row))
        except KeyError:
            self._learn({p for p in row if p not in self.memo})
            return sum(len(self.tok.encode(p, add_special_tokens=False)) if p not in self.memo else self.memo[p] for p in row)

    def encode(self, text: str) -> tuple[dict[int, int], int]:
        """Starts of pre-tokens in the text, each with the tokens before it, and all tokens."""
        if self.split:
            row = self._parts(text)
            self._learn({p for p in row if p not in self.memo})
            starts, at, n = {}, 0, 0
            for p in row:
                if p not in self.special:
                    starts[at] = n
                at += len(p)
                n += self.memo.get(p) or self._sum([p])
            return starts, n
        encoding = self.tok.encode(text, add_special_tokens=False)
        words, offsets = encoding.word_ids, encoding.offsets
        # special tokens have no word; a new word, or one after a special token, is a new pre-token
        starts = {offsets[k][0]: k for k in range(1, len(words)) if words[k] is not None and words[k] != words[k - 1] and offsets[k - 1][1] <= offsets[k][0]}
        return starts, len(words)

    def long(self, text: str) -> int:
        base, end = 0, min(self.chunk, len(text))
        starts, n = self.encode(text[base:end])
        total, cut, first = 0, 0, 0  # from ``cut`` on, tokens of this chunk from ``first`` on are right
        while end < len(text):
            a, b = end - self.overlap, min(end - self.overlap + self.chunk, len(text))
            right, m = self.encode(text[a:b])
            low, high = max(a + self.margin, cut), end - self.margin
            p = next((p for p in range(high, low - 1, -1) if p - base in starts and p - a in right), None)
            if p is not None:
                total += starts[p - base] - first
                base, end, cut, starts, n, first = a, b, p, right, m, right[p - a]
            else:  # twice as far from the last proven boundary, so that all trials together cost no more than a few passes
                base, end, first = cut, min(len(text), max(b, 2 * end - cut)), 0
                starts, n = self.encode(text[base:end])
        return total + n - first


class PieceCounter:
    """Counts with a ``sentencepiece`` model, given as its bytes; texts go in whole."""

    def __init__(self, data: bytes) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]


@lru_cache(maxsize=2)
def _counter(key: str, holder):
    data = holder.value
    return TokenizerCounter(data.decode()) if key.endswith(".json") else PieceCounter(data)


def count_tokens(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """Count every whole text's tokens with the file at the driver's ``path`` (.json or .model).

    Returns the input's columns plus ``n_bytes`` and ``n_tokens`` (long), which
    replace input columns of these names.  No special tokens are added; special
    strings inside texts count as the library's default has it.  A null text
    counts as empty (0 bytes, 0 tokens).  Rows are independent: repeated rows
    get equal counts, an empty table stays empty.
    """
    with open(path, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())
    carried = docs.select(*[c for c in docs.columns if c not in ("n_bytes", "n_tokens")])
    columns = carried.columns

    def count(batches):
        counter = _counter(path, held)
        for batch in batches:
            for part in pieces(batch, text_col, 1 << 20):
                texts = [t or "" for t in part.column(text_col).to_pylist()]
                arrays = [part.column(part.schema.get_field_index(c)) for c in columns]
                arrays += [pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counter.counts(texts), pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, [*columns, "n_bytes", "n_tokens"])

    return carried.mapInArrow(count, StructType([*carried.schema.fields, *StructType.fromDDL("n_bytes long, n_tokens long").fields]))
