"""Fingerprints, token counts, byte-level BPE, quality: against brute force and on odd rows."""

import hashlib
import random

import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.llm import bpe, fingerprints, quality, tokens
from gleaner.llm.words import Words

ODD = ["", None, "a", "aa", " \t\n", "the the the the", "x" * 50_000, "ab " * 20_000, "文字🙂é", "a b c", "a b c", "\x00\x1c\x85 　", "<|endoftext|> a<|endoftext|>"]


def frame(spark, texts, first=1):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts, first)], "doc_id long, text string")


# --- words -------------------------------------------------------------------------


@given(st.lists(st.text(alphabet="aA bé\t\n文", max_size=30), max_size=6), st.integers(1, 4))
@settings(max_examples=150, deadline=None)
def test_words_and_windows_name_equal_things_equally(texts, k):
    w = Words(pa.array(texts, pa.string()), lower=True)
    split = [t.encode().lower().split() for t in texts]
    assert w.counts().tolist() == [len(s) for s in split]
    named = {}
    for h, word in zip(w.hashes.tolist(), [x for s in split for x in s], strict=True):
        assert named.setdefault(word, h) == h
    assert len(set(named.values())) == len(named)
    hashes, at = w.windows(k)
    expected = [tuple(s[i : i + k]) for s in split for i in range(len(s) - k + 1)]
    assert len(hashes) == len(expected)
    assert len(set(hashes.tolist())) == len(set(expected))


# --- fingerprints --------------------------------------------------------------------


def test_fingerprints_against_single_texts(spark):
    texts = [t or "" for t in ODD] + ["one two three four five six seven " * 9, "eight nine ten " * 30]
    rows = {r.id: r for r in fingerprints.fingerprints(frame(spark, texts), ranges=3).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        new = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, b, c = fingerprints.sketches([t])[0], fingerprints.sketches([new])[0], fingerprints.sketches([after])[0]
        r = rows[i + 1]
        assert r.n_chars == len(t) and r.fingerprint == fingerprints.written(a) and r.edited_fingerprint == fingerprints.written(b)
        assert r.edited_text_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert r.near_edited == fingerprints.likeness(a, b) and r.near_next == fingerprints.likeness(a, c)
        assert 0 <= r.near_edited <= 1


def test_fingerprints_of_odd_tables(spark):
    assert fingerprints.fingerprints(frame(spark, [])).count() == 0
    alone = fingerprints.fingerprints(frame(spark, ["only one here"])).first()
    assert alone.near_next == 1.0
    rows = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (None, "b", "z"), (None, None, "z"), (2, None, "q")], "doc_id long, text string, fingerprint string")
    assert fingerprints.fingerprints(rows).count() == 5


def slow_sketch(text, keep):
    """The parse again, one symbol at a time, on Python's integers."""
    m = (1 << 64) - 1

    def mix(v):
        v ^= v >> 31
        v = v * 0x7FB5D329728EA185 & m
        v ^= v >> 27
        v = v * 0x81DADEF4BC2DD44D & m
        return v ^ v >> 33

    def toss(left, own):
        bit = 0
        while left != own and (left >> bit & 1) == (own >> bit & 1):
            bit += 1
        return 2 * bit + (own >> bit & 1)

    symbols, level, names = [ord(c) + 1 for c in text], 0, []
    while symbols:
        if level >= 2 or len(symbols) == 1:
            names += symbols
        if len(symbols) == 1:
            break
        folded, i = [], 0
        while i < len(symbols):
            j = i
            while j < len(symbols) and symbols[j] == symbols[i]:
                j += 1
            folded.append(symbols[i] if j == i + 1 else mix((symbols[i] + (j - i) * 0xC2B2AE3D27D4EB4F) & m))
            i = j
        labels = folded
        for _ in range(4):
            labels = [labels[0] & 1] + [toss(a, b) for a, b in zip(labels, labels[1:])]
        firsts = [i for i in range(len(folded)) if i == 0 or i < len(folded) - 1 and labels[i] > labels[i - 1] and labels[i] > labels[i + 1]]
        symbols = []
        for lo, hi in zip(firsts, [*firsts[1:], len(folded)]):
            total = sum(mix(s) * (mix((p % 4096 + 1) * 0x9E3779B97F4A7C15 & m) | 1) for p, s in enumerate(folded[lo:hi]))
            symbols.append(mix((total + hi - lo) & m))
        level += 1
    times, out = {}, set()
    for name in (s >> 24 for s in names):
        out.add(mix((name + (times.get(name, 0) << 40)) & m) >> 32)
        times[name] = times.get(name, 0) + 1
    return sorted(out)[:keep]


def test_sketches_equal_a_slow_parse():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdeé文 ") for _ in range(rng.randint(1, 8))) for _ in range(50)]
    texts = [t or "" for t in ODD if len(t or "") < 1000] + ["z" * 700, "ab" * 300] + [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 2, 3, 5, 9, 30, 200, 900)]
    for keep in (8, 64, 100_000):
        for text, sketch in zip(texts, fingerprints.sketches(texts, keep), strict=True):
            assert sketch.tolist() == slow_sketch(text, keep), repr(text[:50])


def test_equal_substrings_share_signatures():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    body, other = " ".join(words[:2000]), " ".join(words[2000:])
    a, b, c = fingerprints.sketches([body, "zzz qq " + body + " tail", other])
    assert fingerprints.likeness(a, b) > 0.9 and fingerprints.likeness(a, c) < 0.1
    half = fingerprints.sketches([body[: len(body) // 2] + other[: len(body) // 2]])[0]
    assert 0.3 < fingerprints.likeness(a, half) < 0.7


# --- token counts and BPE ---------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def test_counts_are_the_librarys(spark, library):
    rows = tokens.count_tokens(frame(spark, ODD), P.path("byte_bpe_50k.json")).orderBy("doc_id").collect()
    for r, t in zip(rows, ODD, strict=True):
        assert r.n_tokens == len(library.encode(t or "", add_special_tokens=False).ids)
        assert r.n_bytes == len((t or "").encode())
    assert tokens.count_tokens(frame(spark, []), P.path("byte_bpe_50k.json")).count() == 0
    clash = spark.createDataFrame([(1, "a b", 99)], "doc_id long, text string, n_tokens int")
    assert tokens.count_tokens(clash, P.path("byte_bpe_50k.json")).first().n_tokens == 2


@pytest.mark.parametrize("slow", [False, True])
def test_small_chunks_splice_exactly(library, slow):
    counter = tokens.TokenizerCounter(library.to_str(), chunk=64, overlap=24)
    if slow:
        counter.split = None
    rng = random.Random(1)
    parts = ["a", "b ", "the", " of", "   ", "\n", "é", "文", "<|endoftext|>", "<|endo", "🙂", "'s", "'", "123", " $$", "\t", "xyzxyz", "\x1c", "\x85"]
    for i in range(300):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 250)))
        t = t.replace(" ", "x") if i % 5 == 0 else t
        assert counter.counts([t]) == [len(library.encode(t, add_special_tokens=False).ids)], repr(t)


@pytest.mark.parametrize("slow", [False, True])
def test_a_text_without_breaks_costs_a_few_passes(library, slow, monkeypatch):
    counter = tokens.TokenizerCounter(library.to_str(), chunk=64, overlap=16)
    if slow:
        counter.split = None
    seen, encode = [], counter.encode
    monkeypatch.setattr(counter, "encode", lambda text: seen.append(len(text)) or encode(text))
    text = "x" * 20_000
    assert counter.counts([text]) == [len(library.encode(text, add_special_tokens=False).ids)]
    assert sum(seen) < 5 * len(text)
    del seen[:]
    text = "some words " * 300 + "y" * 5000 + " and more words" * 300
    assert counter.counts([text]) == [len(library.encode(text, add_special_tokens=False).ids)]
    assert sum(seen) < 6 * len(text)


@pytest.fixture(scope="module")
def codec():
    return bpe.load_codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


@pytest.fixture(scope="module")
def reference(codec):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_perfect_hash_is_minimal_and_exact(codec):
    found = [codec.hash.get(k) for k in codec.hash.keys]
    assert found == list(range(len(found)))
    assert codec.hash.get(b"no such token at all") == -1


@given(st.text(alphabet="abcdeé 文🙂\n\t\x1c\x85　'sREl190%$<|>", max_size=60))
@settings(max_examples=300, deadline=None)
def test_bpe_round_trip(codec, reference, text):
    ids = codec.encode(text)
    assert ids == reference.encode_ordinary(text) and codec.decode(ids) == text.encode()


def test_bpe_rows(spark, codec, reference):
    rows = bpe.bpe_encode(frame(spark, ODD), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).orderBy("doc_id").collect()
    for r, t in zip(rows, ODD, strict=True):
        assert r.ids == reference.encode_ordinary(t or "") and bytes(r.decoded) == (t or "").encode() and r.n_tokens == len(r.ids)
        assert r.ids_text == " ".join(map(str, r.ids))
    told = bpe.bpe_encode(frame(spark, ODD).selectExpr("*", "'x' AS ids", "0 AS n_tokens", "1 AS ids_text", "2 AS decoded", "3 AS ids_sha256"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, digests=True).orderBy("doc_id").collect()
    for r, t, d in zip(rows, ODD, told, strict=True):
        assert (d.n_tokens, d.ids) == (r.n_tokens, r.ids) and d.ids_sha256 == hashlib.sha256(r.ids_text.encode()).hexdigest() and d.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.bpe_encode(frame(spark, []), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


# --- quality --------------------------------------------------------------------------------


def test_quality_on_held_out_documents(spark, sf):
    from pyspark.sql import functions as F

    from gleaner.llm.queries import op2_quality

    big = sf.replace("0.001", "0.01")
    scored = op2_quality(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").where("held_out")
    right, kept, clean = scored.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.avg(F.when(F.col("quality") == 1, F.col("predicted"))), F.count("*")).first()
    assert right > 0.93 and kept > 0.97 and clean > 30


def test_scores_equal_plain_cosines(spark, sf):
    """Every cosine by a plain loop over a document's terms, every vote by sorting."""
    import math

    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id AS id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet").selectExpr("doc_id AS id", "CAST(quality AS INT) AS label")
    model = quality.learn(docs, labels, neighbours=7)
    scored = {r.id: r.score for r in quality.score_quality(docs, model).collect()}
    close = 0
    for r in docs.collect():
        row, term, count = quality.features(pa.array([r.text], pa.string()))
        vector = [0.0] * model.project.shape[1]
        for t, n in zip(term.tolist(), count.tolist(), strict=True):
            weight = (1 + math.log(n)) * float(model.idf[t])
            vector = [v + weight * float(p) for v, p in zip(vector, model.project[t], strict=True)]
        norm = math.sqrt(sum(v * v for v in vector)) or 1.0
        cosines = [sum(v * float(w) for v, w in zip(vector, known, strict=True)) / norm for known in model.known]
        order = sorted(range(len(cosines)), key=lambda i: -cosines[i])
        if cosines[order[6]] - cosines[order[7]] < 1e-5:
            continue  # a tie for the last vote, which single precision may settle either way
        votes = [(max(cosines[i], 1e-6), float(model.labels[i])) for i in order[:7]]
        assert abs(scored[r.id] - sum(v * x for v, x in votes) / sum(v for v, _ in votes)) < 1e-4
        close += 1
    assert close > 100


def test_a_repeated_id_teaches_one_text(spark):
    docs = spark.createDataFrame([(1, "Some plain words."), (1, "!!! 123 ###"), (2, "Other words here."), (3, "@@ 99 @@")], "id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "id long, label int")
    a, b = (quality.learn(d, labels) for d in (docs.repartition(3), docs.orderBy("text").coalesce(1)))
    assert len(a.labels) == 3 and (a.known == b.known).all()


def test_quality_of_odd_tables(spark):
    docs = frame(spark, ODD).selectExpr("doc_id", "text", "doc_id AS score")
    named = docs.selectExpr("doc_id AS id", "text")
    nothing = quality.learn(named, spark.createDataFrame([], "id long, label int"))
    assert nothing is None
    assert {r.score for r in quality.score_quality(docs, nothing).collect()} == {0.5}
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 9)] + [(None, 1), (3, None)], "id long, label int")
    model = quality.learn(named, labels)
    rows = quality.score_quality(docs, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r.text, r.score) == r.score
    assert quality.score_quality(docs.limit(0), model).count() == 0
