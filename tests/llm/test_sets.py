"""Jaccard groups, repeated passages, shards, mixing, vectors, URL rules: against brute force and on odd rows."""

import collections
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import jaccard, mixing, queries, repeats, shards, tables, urls, vectors


def frame(spark, rows, kind="doc_id long, text string"):
    return spark.createDataFrame(rows, kind)


# --- Jaccard --------------------------------------------------------------------------------


def brute_groups(rows, k, percent):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    low = {}
    for i, (name, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), name), name)
    return {(name, len(sets[i])): low[find(i)] for i, (name, _) in enumerate(rows)}


def noisy(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
    return words


def test_a_passage_in_many_documents_joins_nobody(spark, monkeypatch):
    """Three quarters of each text are one passage: no links, and no pairs either."""
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(90)]
    rows = [(i, " ".join(passage + [f"x{i}y{j}" for j in range(30)])) for i in range(500)]
    rows += [(1000 + i, " ".join(noisy(rng, passage, i % 2))) for i in range(300)]  # near copies of one text
    rng.shuffle(rows)
    counts = collections.Counter()

    def counting(name):
        plain = getattr(jaccard._Join, name)

        def run(self, *given):
            found = plain(self, *given)
            counts[name] += found.count()
            return found

        monkeypatch.setattr(jaccard._Join, name, run)

    counting("hubs")
    counting("across")
    got = {(r.id, r.n_shingles): r.component_id for r in jaccard.jaccard_groups(frame(spark, rows).repartition(6)).collect()}
    assert got == brute_groups(rows, 5, 80)
    assert 0 < counts["hubs"] <= jaccard.HUBS * 800 and counts["across"] < 800


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_groups_equal_brute_force(spark, k, percent):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for _ in range(6):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 200))]
        rows += [" ".join(noisy(rng, base, rng.randint(0, 4))) for _ in range(rng.randint(2, 14))]
    rows += [" ".join([rng.choice(vocabulary) for _ in range(40)] + passage) for _ in range(15)]
    rows += ["", None, "one", "ONE", "two words", "Two  Words", "a b c", "a b c", " \n ", rows[0].upper(), "x" * 5000]
    rng.shuffle(rows)
    rows = [(i * 3, t) for i, t in enumerate(rows)]
    docs = frame(spark, rows).withColumn("node", F.lit("clash")).repartition(5)
    got = {(r.id, r.n_shingles): r.component_id for r in jaccard.jaccard_groups(docs, shingle=k, percent=percent).collect()}
    assert got == brute_groups(rows, k, percent)


def test_one_document_of_each_group_stays(spark):
    words = [f"w{i}" for i in range(100)]
    near = [*words[:99], "end"]
    rows = [(5, " ".join(words), "a"), (3, " ".join(near), "b"), (3, " ".join(near), "b"), (9, None, "c"), (8, "", "d"), (None, "alone here", "e"), (7, " ".join(reversed(words)), "f")]
    docs = frame(spark, rows, "doc_id long, text string, source string")
    kept = jaccard.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.source) for r in kept.collect()) == sorted([("3", "b"), ("9", "c"), ("8", "d"), ("None", "e"), ("7", "f")])
    assert jaccard.drop_near_copies(docs.limit(0)).count() == 0


def test_divide_skip_equals_counting():
    rng = np.random.default_rng(3)
    for _ in range(60):
        query = np.unique(rng.integers(0, 400, rng.integers(1, 120)).astype(np.uint64))
        members = []
        for _ in range(rng.integers(1, 30)):
            drop = rng.random(len(query)) < rng.choice([0, 0.02, 0.1, 0.5])
            members.append(np.unique(np.concatenate([query[~drop], rng.integers(400, 900, rng.integers(0, 12)).astype(np.uint64)])) if (~drop).any() else query)
        for percent in (50, 80, 90, 100):
            want = [i for i, m in enumerate(members) if 100 * len(np.intersect1d(query, m)) >= percent * len(np.union1d(query, m))]
            assert sorted(jaccard.divide_skip(query, members, percent)) == want


# --- repeated passages -------------------------------------------------------------------------


def brute_repeats(rows, window):
    first = {}
    for name, text in rows:
        w = (text or "").encode().split()
        for i in range(len(w) - window + 1):
            if name is not None:
                key = tuple(w[i : i + window])
                first[key] = min(first.get(key, name), name)
    out = []
    for name, text in rows:
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if name is not None and first[tuple(w[i : i + window])] < name:
                gone[i : i + window] = [True] * window
        out.append((name, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("window", "bits"), [(8, 20), (5, 10), (50, 20)])
def test_repeats_equal_brute_force(spark, window, bits):
    rng = random.Random(window)
    passages = [[f"p{j}x{i}" for i in range(rng.randint(window, 3 * window))] for j in range(4)]
    rows = []
    for i in range(40):
        words = [f"w{rng.randrange(50)}" for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            cut = rng.randrange(max(1, len(p) - window + 1))
            at = rng.randrange(len(words) + 1)
            words[at:at] = p[cut:]
        rows.append((rng.randrange(25) if i % 4 else i + 100, " ".join(words)))
    rows += [(7, rows[0][1]), (7, rows[0][1]), (None, rows[1][1]), (500, None), (501, ""), (502, " ".join(["same"] * 200)), (503, " ".join(["same"] * 120))]
    docs = frame(spark, rows).withColumn("n_words", F.lit(1)).withColumn("spot", F.lit("x")).repartition(4)
    got = repeats.remove_repeats(docs, window=window, filter_bits=bits)
    assert set(got.columns) == {"doc_id", "text", "spot", "n_words", "n_removed", "kept"}
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()), key=str) == brute_repeats(rows, window)
    assert repeats.remove_repeats(docs.limit(0), window=window, filter_bits=bits).count() == 0


# --- shards ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("part_bytes", [1 << 27, 9000])
def test_shards_are_even_gapless_and_whole(spark, part_bytes):
    rng = random.Random(2)
    rows = [(i, "x" * rng.randint(0, 400)) for i in range(900)] + [(2000 + i, "hot text " * 20) for i in range(500)] + [(5, "again"), (5, "again"), (None, "null id"), (3000, None), (3001, "")]
    docs = frame(spark, rows).withColumn("slot", F.lit("clash")).withColumn("h", F.lit(1))
    placed = shards.shard(docs, 6, part_bytes=part_bytes).collect()
    assert len(placed) == len(rows)
    total, slots, size = collections.Counter(), collections.defaultdict(list), 0
    for r in placed:
        raw = (r.text or "").encode()
        assert r["size"] == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw)
        total[r["shard"]] += r["size"]
        slots[r["shard"]].append(r.slot)
        size += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    home = collections.defaultdict(set)
    for r in placed:
        home[r.text or ""].add(r["shard"])
    # equal texts stay together; the hot group holds over a tenth of a shard, so it may be split
    assert all(len(v) == 1 for t, v in home.items() if not t.startswith("hot")) and len(home["hot text " * 20]) > 1
    assert max(abs(total[i] - size / 6) for i in range(6)) < 0.06 * size / 6
    assert shards.shard(docs.limit(0), 6).count() == 0
    one = shards.shard(docs.where("doc_id = 3000"), 6).collect()
    assert len(one) == 1 and one[0].slot == 0


def test_shards_keep_small_groups_and_split_large_ones(spark):
    rows = [(100 * i + j, f"text {i} " * 6) for i in range(150) for j in range(8)]
    placed = shards.shard(frame(spark, rows).repartition(3), 10, whole=0.1).collect()
    home = collections.defaultdict(set)
    for r in placed:
        home[r.text].add(r["shard"])
    assert len(placed) == 1200 and all(len(v) == 1 for v in home.values())
    bytes_of = collections.Counter()
    for r in placed:
        bytes_of[r["shard"]] += r["size"]
    group = max(len(t) + 8 for t in home) * 8
    assert len(bytes_of) == 10 and max(bytes_of.values()) - min(bytes_of.values()) <= 2 * group + 0.01 * sum(bytes_of.values())
    again = {(r.doc_id): (r["shard"], r.slot) for r in shards.shard(frame(spark, rows), 10, whole=0.1).collect()}
    assert again == {r.doc_id: (r["shard"], r.slot) for r in placed}


# --- mixing ----------------------------------------------------------------------------------------


def test_poisson_inversion_is_exact(spark):
    from math import exp

    rows = [(float(rate), u / 997) for rate in (0.0, 0.1, 1.0, 7.5, 31.9) for u in range(997)]
    df = frame(spark, rows, "rate double, u double").withColumn("chances", mixing.cumulative(F.col("rate")))
    for r in df.withColumn("k", tables.count_passed(lambda place: F.col("chances")[place - 1], 128, lambda c: c <= F.col("u"))).collect():
        p = c = exp(-r.rate)
        k = 0
        while c <= r.u:
            k += 1
            p *= r.rate / k
            c += p
        assert r.k == k


def test_a_search_by_steps_stays_small(spark):
    steps = tables.padded(list(range(0, 5000, 10)), 1 << 40)
    ladder = F.array(*[F.lit(c).cast("long") for c in steps])
    found = spark.range(0, 6000, 7).withColumn("k", tables.count_passed(lambda place: F.element_at(ladder, place), len(steps), lambda c: c <= F.col("id")))
    assert all(r.k == min(500, r.id // 10 + 1) for r in found.collect())
    docs = spark.createDataFrame([(i, f"text {i}", "s") for i in range(50)], "doc_id long, text string, source string")
    for df in (shards.shard(docs, 24), mixing.mix_sources(docs)):  # filters on what was searched are pushed down, and hold it once
        assert df._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") < 12


def test_large_rates_are_sums_of_draws(spark):
    docs = frame(spark, [(i, "a") for i in range(400)] + [(400, "b")], "doc_id long, source string")
    drawn = {r.doc_id: r.copies for r in mixing.mix_sources(docs, {"a": 9, "b": 1}, size=10.0).select("doc_id", "copies").distinct().collect()}
    import hashlib

    def uniform(i, j):
        return int(hashlib.md5(f"1:{i}:{j}".encode()).hexdigest()[:13], 16) / 2**52

    def count(rate, u):
        from math import exp

        p = c = exp(-rate)
        k = 0
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        return k

    rate = 4010 * 0.1  # of the only document of b: thirteen draws of equal rates
    assert drawn[400] == sum(count(rate / 13, uniform(400, j)) for j in range(1, 14))
    rate = 4010 * 0.9 / 400
    assert all(drawn.get(i, 0) == count(rate, uniform(i, 1)) for i in range(400))


def test_mix_reaches_its_targets(spark):
    rows = [(i, "a" if i % 3 else "b", "t") for i in range(6000)] + [(i, None, "t") for i in range(6000, 6300)]
    docs = frame(spark, rows, "doc_id long, source string, copy string")
    even = {r.source: r["n"] for r in mixing.mix_sources(docs).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert set(even) == {"a", "b", None} and all(abs(n - 2100) < 260 for n in even.values())
    mixed = mixing.mix_sources(docs, {"a": 1, "b": 3}, size=2.0)
    got = {r.source: r["n"] for r in mixed.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert set(got) == {"a", "b"} and abs(got["b"] / got["a"] - 3) < 0.3 and abs(sum(got.values()) - 12600) < 600
    keys = [r.order_key for r in mixed.select("order_key").collect()]
    assert keys == sorted(keys)
    assert all(1 <= r["copy"] <= r.copies for r in mixed.collect())
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    again = mixing.mix_sources(frame(spark, [(1, "a", "x")] * 3, "doc_id long, source string, copy string"), size=40.0)
    assert again.count() % 3 == 0


# --- vectors ----------------------------------------------------------------------------------------


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 4)
    monkeypatch.setattr(vectors, "TILE", 16)
    monkeypatch.setattr(vectors, "TILE_ROWS", 60)
    rng = np.random.default_rng(1)
    rows = [(int(i), rng.integers(-4, 5, 6).astype(float).tolist()) for i in range(300)] + [(1000 + i, [1.0] * 6) for i in range(40)]
    rows += [(2000, None), (None, [1.0] * 6), (2001, [1.0, 2.0]), (2050, [2.0, 1.0]), (0, [4.0] * 6)]
    data = frame(spark, rows, "id long, vector array<double>")
    got = [(r.query_id, r["rank"], r.id, r.score) for r in vectors.top_k(data.repartition(5), data.where("id % 50 = 0"), 5).collect()]
    want, asked = [], {}
    for q, v in rows:
        if q is not None and v is not None and q % 50 == 0:
            asked.setdefault(q, v)
    for q, v in asked.items():
        if q == 0:
            continue  # an id with two vectors: either is the query
        found = sorted((-int(np.dot(v, w)), i) for i, w in rows if i is not None and w is not None and i != q and len(w) == len(v))[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(found)]
    assert sorted(x for x in got if x[0] != 0) == sorted(want)
    assert vectors.top_k(data.limit(0), data.limit(0)).count() == 0 and vectors.top_k(data, data.limit(0)).count() == 0
    clash = data.selectExpr("id", "vector", "id AS block", "'x' AS tile", "1.5 AS score", "0 AS query_id")
    found = vectors.top_k(clash, clash.where("id % 50 = 0"), 5)
    assert found.columns == ["query_id", "rank", "id", "score"] and sorted((r.query_id, r["rank"], r.id, r.score) for r in found.collect() if r.query_id) == sorted(want)
    odd = frame(spark, [([1.0, float("nan")],), ([None, 1.0],), (None,), ([0.5, -0.25],)], "v array<float>")
    assert [bool(r[0]) for r in odd.select(vectors.usable(F.col("v"))).collect()] == [False, False, False, True]
    assert odd.where(vectors.usable(F.col("v"))).select(vectors.quantised(F.col("v"))).first()[0] == [128.0, -64.0]


# --- URL rules --------------------------------------------------------------------------------------


def test_automaton_equals_regexes():
    import re

    rng = random.Random(4)
    globs = ["a", "a*", "*a", "a**b", "*.a/b**", "?b", "**", "", "a*b*c", "é*", *["".join(rng.choice("ab/*?.") for _ in range(rng.randint(1, 12))) for _ in range(60)]]
    machine = urls.Automaton(globs)
    assert machine.words > 1
    from gleaner.llm.words import column_bytes
    import pyarrow as pa

    texts = ["", "a", "ab", "x.a/b", "x/y.a/b", "éa", *["".join(rng.choice("ab/.") for _ in range(rng.randint(0, 14))) for _ in range(400)]]
    hit = machine.matches(*column_bytes(pa.array(texts)))
    for j, g in enumerate(globs):
        pattern, i = "", 0
        raw = g.encode().decode("latin-1")
        while i < len(raw):
            if raw.startswith("**", i):
                pattern, i = pattern + "(?s:.*)", i + 2
            elif raw[i] == "*":
                pattern, i = pattern + "[^/]*", i + 1
            else:
                pattern, i = pattern + ("(?s:.)" if raw[i] == "?" else re.escape(raw[i])), i + 1
        for k, t in enumerate(texts):
            assert hit[k, j] == bool(re.fullmatch(pattern, t.encode().decode("latin-1"))), (g, t)


def test_long_urls_stop_once_they_are_decided(monkeypatch):
    import time

    from gleaner.llm.words import column_bytes
    import pyarrow as pa

    machine = urls.Automaton(["net/**", "*.net/**", "org/*"])
    began = time.time()
    hit = machine.matches(*column_bytes(pa.array(["a.net/" + "x" * 3_000_000, "a.com/" + "y" * 3_000_000])))
    assert hit.tolist() == [[False, True, False], [False, False, False]] and time.time() - began < 5


def test_url_rules(spark):
    rules = [urls.Rule("block", "net", "/"), urls.Rule("allow", "example.net", "/en/"), urls.Rule("block", "example.com", "/de/"), urls.Rule("allow", "org", "/fr/")]
    cases = {
        "https://X.Example.NET/en/a?q#f": ("x.example.net", "/en/a", "example.net/en/", "allow"), "http://a.net/x": ("a.net", "/x", "net/", "block"), "http://a.net": ("a.net", "", None, "allow"),
        "http://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"), "http://badexample.com/de/": ("badexample.com", "/de/", None, "allow"), "http://example.com/x.net/y": ("example.com", "/x.net/y", None, "allow"),
        None: ("", "", None, "allow"), "": ("", "", None, "allow"), "no scheme": ("", "", None, "allow"), "a://b.org/fr/é": ("b.org", "/fr/é", "org/fr/", "allow"), "x://y://net/": ("y:", "//net/", None, "allow"),
        "http://a.net?x": ("a.net", "", None, "allow"), "http://É.net/": ("É.net", "/", "net/", "block"), "http://" + "a" * 20000 + ".net/x": ("a" * 20000 + ".net", "/x", "net/", "block"),
    }
    rows = urls.judge_urls(frame(spark, [(u, "clash") for u in cases] * 2, "url string, rule string"), rules).collect()
    assert len(rows) == 2 * len(cases)
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == cases[r.url]
    assert urls.judge_urls(frame(spark, [], "url string"), rules).count() == 0


def test_op5_mixes_whole_documents(spark, sf, monkeypatch):
    saved, save = {}, tables.Scratch.save
    monkeypatch.setattr(tables.Scratch, "save", lambda self, df, name: saved.setdefault(name, save(self, df, name)))
    told = queries.op5_mixing(spark, sf).collect()
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    whole = {r.doc_id: r for r in documents.collect()}
    mixed = saved["mixed"].collect()
    assert sorted((r.doc_id, r["copy"], r.order_key) for r in mixed) == sorted((r.doc_id, r["copy"], r.order_key) for r in told)
    assert all(r[c] == whole[r.doc_id][c] for r in mixed for c in documents.columns)
    assert [r.order_key for r in told] == sorted(r.order_key for r in told) and len(told) > 100
