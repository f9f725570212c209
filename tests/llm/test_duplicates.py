import hashlib
import random
from itertools import combinations

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from quarry.llm import common, fingerprint, ngram_join, substring, windows

WORDS = [f"w{i}" for i in range(400)]


def corpus(seed, n=60):
    r = random.Random(seed)
    passage = r.choices(WORDS, k=40)
    docs = []
    for i in range(n):
        kind = r.random()
        words = r.choices(WORDS, k=r.randint(0, 120))
        if kind < 0.2:
            words = words[:30] + passage[r.randint(0, 10) :] + words[30:]
        elif kind < 0.6 and docs:
            words = r.choice(docs)[1].split()
            for _ in range(r.randint(0, 3)):
                if words:
                    words[r.randrange(len(words))] = r.choice(WORDS)
        docs.append((i * 3, r.choice([" ", "  ", "\n"]).join(words)))
    return docs + [(1, "Aa bB c"), (2, "aa Bb C"), (4, "alone"), (5, None), (7, ""), (8, "a b c d e f g h i j k l m")]


def brute_removed(docs, k=13):
    first = {}
    split = {i: (t or "").split() for i, t in docs}
    for i in sorted(split):
        for j in range(len(split[i]) - k + 1):
            first.setdefault(tuple(split[i][j : j + k]), i)
    out = {}
    for i, w in split.items():
        gone = set()
        for j in range(len(w) - k + 1):
            if first[tuple(w[j : j + k])] < i:
                gone.update(range(j, j + k))
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_substring_dedup_is_brute_force(spark, batches):
    docs = corpus(1)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).withColumn("Kept", F.lit(1)).withColumn("_key", F.lit("clash"))
    out = substring.dedup(spark, df, batches=batches)
    assert out.columns == ["doc_id", "text", "_key", "n_words", "n_removed", "kept", "removed"]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in out.collect()}
    assert got == brute_removed(docs)
    assert any(n for _, n, _ in got.values())
    for r in out.collect():
        words = (r.text or "").split()
        gone = {j for s in r.removed for j in range(s.start, s.stop)}
        assert len(gone) == r.n_removed and " ".join(w for j, w in enumerate(words) if j not in gone) == r.kept


def test_substring_dedup_of_odd_rows(spark):
    long = " ".join(WORDS[:20])
    df = spark.createDataFrame([(1, long), (1, long), (None, long), (9, long), (9, "x " + long), (10, None)], "doc_id long, text string")
    assert rows(substring.dedup(spark, df).select("doc_id", "n_removed")) == sorted([(1, 0), (1, 0), (None, 0), (9, 20), (9, 20), (10, 0)], key=repr)
    assert substring.dedup(spark, df.limit(0)).count() == 0


@pytest.mark.parametrize("pieces", [1, 3])
def test_index_is_incremental_and_compacts(spark, pieces):
    docs = corpus(2)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    index = substring.WindowIndex(spark, common.shared_dir(spark, "t"), 3, pieces=pieces)
    got = {}
    for low, high in ((0, 40), (40, 90), (90, 130), (130, 10**6)):
        got |= {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in index.add(df.where(f"doc_id >= {low} and doc_id < {high}")).collect()}
        assert len(index.runs) < substring.TIER
    assert got == brute_removed(docs)


@pytest.mark.parametrize("bits", [1, 6])
def test_windows_of_one_hash_are_told_apart_by_their_words(spark, bits):
    """With so few bits nearly all hits are collisions: a hit that is no repeat removes nothing."""
    docs = corpus(4)
    want = brute_removed(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for r in substring.dedup(spark, df, bits=bits).collect():
        n, removed, kept = want[r.doc_id]
        words = (dict(docs)[r.doc_id] or "").split()
        left = [w for j, w in enumerate(words) if not any(s.start <= j < s.stop for s in r.removed)]
        assert r.n_words == n and r.n_removed <= removed
        it = iter(left)
        assert all(w in it for w in kept.split())  # what is kept stays, in its order
    one = [(i, " ".join(f"d{i}w{j}" for j in range(60))) for i in range(20)]
    assert {r.n_removed for r in substring.dedup(spark, spark.createDataFrame(one, "doc_id long, text string").repartition(3), bits=bits).collect()} == {0}


def test_words_of_a_span_are_compared_one_by_one():
    a, b = list(b"abcdefgh"), list(b"abcdXfgh")
    assert substring.equal_windows(a, a, 3).tolist() == [True] * 6
    assert substring.equal_windows(a, b, 3).tolist() == [True, True, False, False, False, True]


def test_squeeze_round_trip():
    for x in ([], [5], [3, 3, 1 << 40, (1 << 64) - 1]):
        a = np.array(x, dtype=np.uint64)
        assert (windows.expand_sorted(windows.squeeze_sorted(a)) == a).all()
        assert (windows.expand(windows.squeeze(a), np.uint64) == a).all()


def shingle_set(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(docs):
    s = {i: shingle_set(t) for i, t in docs}
    parent = {i: i for i in s}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(s), 2):
        both = len(s[a] & s[b])
        if s[a] and s[b] and 100 * both >= 80 * (len(s[a]) + len(s[b]) - both):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (len(s[i]), find(i)) for i in s}


@pytest.mark.parametrize("frequent", [64, 2])
def test_ngram_join_is_brute_force(spark, frequent):
    docs = corpus(3, 90)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).withColumn("class", F.lit("clash"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(spark, df, frequent=frequent).collect()}
    assert got == brute_components(docs)
    kept = {r.doc_id for r in ngram_join.component_filter(spark, df).collect()}
    assert kept == {i for i, (_, c) in got.items() if c == i}


@pytest.mark.parametrize("small", [1000, 1 << 30])
def test_ngram_join_of_many_blocks_and_pieces(spark, monkeypatch, tmp_path, small):
    """A third of the rows are copies and another part shares a passage; ranges are cut into pieces, as for large tables."""
    r = random.Random(8)
    docs = [(i, t) for i, t in corpus(9, 60) if t is not None]
    docs = [(3 * i, t) for i, (_, t) in enumerate(docs)] + [(3 * i + 1, docs[5][1]) for i in range(40)] + [(3 * i + 2, docs[7][1] + " " + r.choice(WORDS)) for i in range(30)]
    monkeypatch.setattr(ngram_join, "PIECE_BYTES", small)
    spark.createDataFrame(docs, "doc_id long, text string").repartition(12).write.parquet(str(tmp_path / "docs"))
    df = spark.read.parquet(str(tmp_path / "docs")).repartition(12)
    assert common.size_of(df) > 4 * 1000
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.join(spark, df, frequent=2).collect()}
    assert got == brute_components(docs)


@pytest.mark.parametrize("seed", range(3))
def test_similar_sets_share_a_signature(seed):
    r = np.random.default_rng(seed)
    for _ in range(200):
        n = int(r.integers(1, 60))
        pool = r.permutation(200)[: n + 30].astype(np.uint64)
        a = set(pool[:n].tolist())
        b = set(a)
        for x in list(a)[: int(r.integers(0, 1 + n // 8))]:
            b.discard(x)
        b |= set(pool[n : n + int(r.integers(0, 1 + n // 10))].tolist())
        both = len(a & b)
        if a == b or not b or 100 * both < 80 * len(a | b):
            continue
        count = {x: int(r.integers(2, 9)) for x in a | b}
        count |= {x: 1 for x in a ^ b if r.random() < 0.7}
        found = []
        for s in (a, b):
            t = sorted((x for x in s if count[x] > 1), key=lambda x: (count[x], x))
            sigs, left = ngram_join.signatures(len(s), np.array(t, dtype=np.uint64), np.array([count[x] for x in t], dtype=np.int64), frequent=4)
            found.append(dict(zip(sigs.tolist(), left.tolist(), strict=True)))
        shared = found[0].keys() & found[1].keys()
        assert any(180 * min(found[0][x], found[1][x]) >= 80 * (len(a) + len(b)) for x in shared)


def test_join_of_odd_rows(spark):
    t = " ".join(WORDS[:30])
    df = spark.createDataFrame([(4, t), (4, t), (None, t), (9, t), (10, None)], "doc_id long, text string")
    assert rows(ngram_join.join(spark, df).select("doc_id", "component_id")) == sorted([(4, 4), (4, 4), (None, 4), (9, 4), (10, 10)], key=repr)
    assert ngram_join.join(spark, df.limit(0)).count() == 0


def exact_likeness(a, b):
    def weights(t):
        out = {}
        for w in t.lower().split():
            out[w] = out.get(w, 0) + len(w)
        return out

    x, y = weights(a), weights(b)
    keys = x.keys() | y.keys()
    return sum(min(x.get(k, 0), y.get(k, 0)) for k in keys) / max(1, sum(max(x.get(k, 0), y.get(k, 0)) for k in keys))


def test_fingerprints_estimate_generalised_jaccard():
    r = random.Random(5)
    error = []
    for _ in range(60):
        a = r.choices(WORDS, k=150)
        b = a[: r.randint(0, 150)] + r.choices(WORDS, k=60)
        p = fingerprint.fingerprints([" ".join(a).encode(), " ".join(b).encode()])
        error.append(float(fingerprint.likeness(p[:1], p[1:])[0]) - exact_likeness(" ".join(a), " ".join(b)))
    assert abs(np.mean(error)) < 0.03 and np.std(error) < 0.09


def test_fingerprints_of_very_long_texts(monkeypatch, spark):
    texts = [" ".join(f"w{i % 700} x{i}" for i in range(n)).encode() for n in (0, 3, 400, 2000)]
    want = fingerprint.fingerprints(texts)
    monkeypatch.setattr(fingerprint, "MANY", 37)
    assert (fingerprint.fingerprints(texts) == want).all()
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string").withColumn("FINGERPRINT", F.lit(1))
    assert fingerprint.fingerprint(df).columns == ["doc_id", "text", "fingerprint"]


def test_edited_texts_and_order(spark):
    docs = [(i * 5, t) for i, (_, t) in enumerate(corpus(6, 30))] + [(2000, "é" * 7), (-4, "first one")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4).withColumn("key", F.lit("clash"))
    got = {r.doc_id: r for r in fingerprint.compare_edited(spark, df).collect()}
    docs = sorted((i, t or "") for i, t in docs)
    assert len(got) == len(docs)
    for (i, a), (_, b) in zip(docs, [*docs[1:], docs[0]], strict=True):
        half = len(a) // 2
        edit = a[: len(a) - half] + b[:half]
        p = fingerprint.fingerprints([a.encode(), edit.encode(), b.encode()])
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(a), hashlib.sha256(edit.encode()).hexdigest())
        assert [r.fingerprint, r.edited_fingerprint] == fingerprint.shown(p[:2])
        assert r.near_edited == fingerprint.likeness(p[:1], p[1:2])[0] and r.near_next == fingerprint.likeness(p[:1], p[2:])[0]
    assert rows(fingerprint.fingerprint(df.select("text")).where("text = 'alone'").select("fingerprint")) == [(got[[i for i, t in docs if t == "alone"][0]].fingerprint,)]


def test_one_and_no_document(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert fingerprint.compare_edited(spark, df).first().near_next == 1.0
    assert fingerprint.compare_edited(spark, df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, None), (1, "x y"), (1, "x y")], "doc_id long, text string")
    assert fingerprint.compare_edited(spark, odd).count() == 3


def test_bitmaps_bound_what_two_sets_share():
    rng = np.random.default_rng(11)
    for size in (1, 5, 60, 400, 5000):
        for kept in (0, 1, size // 2, size):
            pool = rng.integers(0, 1 << 63, 2 * size, dtype=np.uint64)
            a, b = pool[:size], np.concatenate((pool[:kept], pool[size : 2 * size - kept]))
            x, y = ngram_join.bitmap(a).view(np.uint64), ngram_join.bitmap(b).view(np.uint64)
            assert len(x) == ngram_join.BITS // 64
            bound = min(len(a) - int(np.bitwise_count(x & ~y).sum()), len(b) - int(np.bitwise_count(y & ~x).sum()))
            assert bound >= len(np.intersect1d(a, b))
            assert size > 60 or kept or bound < size


def test_rows_of_a_repeated_id_stay_unless_linked(spark):
    one, two, three = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    data = [(1, one), (2, one), (2, two), (3, three), (3, three), (3, "x " + three), (4, None), (None, two), (None, two)]
    kept = ngram_join.component_filter(spark, spark.createDataFrame(data, "doc_id long, text string"))
    got = sorted((r.doc_id or 0, r.text or "") for r in kept.collect())
    assert [x for x in got if x[0] != 3] == [(0, two), (0, two), (1, one), (2, two), (4, "")]
    assert [x[1] in (three, "x " + three) for x in got if x[0] == 3] == [True]


def test_similar_sets_share_a_signature_at_half():
    groups = {}
    for x in np.arange(1, 1000, dtype=np.uint64):
        groups.setdefault(int(ngram_join.mix(np.array([x]))[0] % np.uint64(8)), []).append(x)
    shared = np.sort(np.array([g[0] for g in groups.values()], dtype=np.uint64))
    others = np.sort(np.array([g[1] for g in groups.values()], dtype=np.uint64))
    few, many = np.full(8, 65), np.full(8, 66)
    small, _ = ngram_join.signatures(8, shared, many, 50)
    large, _ = ngram_join.signatures(16, np.concatenate((others, shared)), np.concatenate((few, many)), 50)
    assert len(np.intersect1d(small, large))
    assert ngram_join.small_size() == ngram_join.SMALL


def test_signatures_grow_with_the_prefix():
    r = np.random.default_rng(1)
    for n in (300, 5_000, 40_000):
        tokens = np.sort(r.integers(1, 1 << 63, n, dtype=np.uint64))
        found, _ = ngram_join.signatures(n, tokens, np.full(n, 1000))
        assert 0 < len(found) < 100_000 and len(found) < 8 * n


@pytest.mark.parametrize("seed", range(4))
def test_large_similar_sets_share_a_signature(seed):
    r = np.random.default_rng(seed)
    for n in (310, 330, 640, 1300, 2600, 5200):
        pool = r.integers(1, 1 << 63, 2 * n, dtype=np.uint64)
        for more in (0.0, 0.1, 0.2, 0.24):  # one set inside the other, up to the least similarity
            m = int(n * (1 + more))
            a, b = (np.sort(pool[:k]) for k in (n, m))
            if 100 * n < 80 * m:
                continue
            one, left = ngram_join.signatures(n, a, np.full(n, 1000))
            two, left2 = ngram_join.signatures(m, b, np.full(m, 1000))
            both, i, j = np.intersect1d(one, two, return_indices=True)
            assert any(180 * min(x, y) >= 80 * (n + m) for x, y in zip(left[i], left2[j], strict=True)), (n, m)


def test_sets_that_share_a_name_are_told_apart(spark, monkeypatch):
    docs = corpus(5, 40)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    names = ngram_join.Sets(spark, df, common.shared_dir(spark, "t")).members.where("class is not null").select("class").distinct().limit(12).collect()
    monkeypatch.setattr(ngram_join, "shared_names", lambda of: frozenset(r["class"] for r in names))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(spark, df, frequent=2).collect()}
    assert got == brute_components(docs)
    kept = {r.doc_id for r in ngram_join.component_filter(spark, df).collect()}
    assert kept == {i for i, (_, c) in got.items() if c == i}
    monkeypatch.undo()
    of = spark.createDataFrame([(1, 1, 7, 5), (2, 1, 7, 6), (3, 1, 8, 5), (4, 1, 8, 5), (5, 0, None, None)], "key long, n_shingles long, class long, check long")
    assert ngram_join.shared_names(of) == {7}
