import pathlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from quarry.llm import common, media, packing, shard, toxicity


def texts(n, seed=1):
    r = random.Random(seed)
    block = " ".join(r.choices(["alpha", "beta", "gamma", "delta", "épsilon"], k=900))
    out = []
    for i in range(n):
        t = "".join(r.choices("abc déf\n", k=r.randint(0, 3000)))
        out.append((i, t + block + t[:50] if i % 3 == 0 else t))
    return out + [(n, None), (n + 1, ""), (n + 2, out[3][1]), (None, "no id"), (5, "again")]


def test_jump_moves_rows_only_into_new_shards():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 20_000).astype(np.uint64)
    last = shard.jump(keys, 1)
    assert not last.any()
    for n in range(2, 20):
        now = shard.jump(keys, n)
        moved = now != last
        assert (now[moved] == n - 1).all() and abs(moved.mean() - 1 / n) < 0.02
        last = now


def slow_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_is_the_scalar_algorithm():
    keys = np.random.default_rng(2).integers(0, 1 << 63, 300).astype(np.uint64)
    for n in (1, 2, 8, 9, 1000):
        assert shard.jump(keys, n).tolist() == [slow_jump(int(k), n) for k in keys]


def test_shards_and_slots(spark):
    data = texts(200)
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4).withColumn("slot", F.lit("clash")).withColumn("kept", F.lit(1))
    got = shard.assign(spark, df, 8).collect()
    assert len(got) == len(data)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8) and r.law == "key" and r.kept == 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in data)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    for s in slots:
        own = [r.doc_id for r in sorted((r for r in got if r.shard == s and r.doc_id is not None), key=lambda r: r.slot)]
        assert own == sorted(own)
    assert shard.assign(spark, df.limit(0), 8).count() == 0


def test_ranked_and_ranges(spark):
    df = spark.createDataFrame([(i % 2, i) for i in range(1000)] + [(0, None)], "g int, k long")
    got = common.ranked(df, "g", "k", 7, "n").collect()
    assert {(r.g, r.k, r.n) for r in got} == {(0, None, 0)} | {(i % 2, i, i // 2 + (i % 2 == 0)) for i in range(1000)}
    bounds = common.range_bounds(df, "k", 7)
    assert bounds[0] == 0 and len(bounds) == 7 and bounds == sorted(set(bounds))


def test_gear_hash_and_cuts():
    data = np.random.default_rng(3).integers(0, 256, 60_000, dtype=np.uint8)
    h, state = media.gear(data), 0
    for i, b in enumerate(data[:5000].tolist()):
        state = ((state << 1) + int(media._GEAR[b])) & 0xFFFFFFFF
        if i >= 31:
            assert h[i] == state
    payloads = [data.tobytes(), b" " * 192, data[1000:].tobytes(), b"z" * 20_000]
    ends = media.cuts(payloads)
    for p, e in zip(payloads, ends, strict=True):
        sizes = np.diff([0, *e])
        assert e[-1] == len(p) and max(sizes) <= media.MOST and all(s >= media.LEAST for s in sizes[:-1])
    chunks = lambda k: {payloads[k][a:b] for a, b in zip([0, *ends[k]], ends[k], strict=False)}
    assert chunks(0) & chunks(2)
    assert media.cuts([payloads[2]])[0] == ends[2]


def test_media_round_trip_and_sharing(spark):
    data = texts(60)
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3).withColumn("key", F.lit("clash"))
    folder = media.folder(spark)
    stored, places = media.write(spark, df, folder)
    assert places.count() < stored.selectExpr("explode(chunks)").count()
    want = Counter((i, media.payload((t or "").encode())) for i, t in data)
    assert Counter((r.key, bytes(r.payload)) for r in media.read(spark, stored, places, folder).collect()) == want
    packs = lambda: {p.name: p.stat().st_size for p in pathlib.Path(folder).glob("*.pack")}
    old = packs()
    some = media.compact(spark, stored, places, folder, dead=0.9)
    assert packs() == old and sorted(map(tuple, some.collect())) == sorted(map(tuple, places.collect()))
    again = media.compact(spark, stored, places, folder, dead=0.0)
    assert sum(packs().values()) == again.groupBy().sum("size").first()[0] < sum(old.values())
    assert again.select("digest").distinct().count() == again.count()
    described = media.read(spark, stored, again, folder, described=True).collect()
    assert Counter((r.key, r.tail_crc32) for r in described) == Counter((i, zlib.crc32(media.payload((t or "").encode())[-16:])) for i, t in data)
    by_text = defaultdict(set)
    for r in described:
        by_text[r.payload_sha256].add((r.media_sha256, r.media_bytes, r.feature, r.payload_bytes))
        assert r.payload_bytes % 192 == 0 and r.payload_bytes > 0
    assert all(len(v) == 1 for v in by_text.values())
    stored, places = media.write(spark, df.limit(0), media.folder(spark))
    assert media.read(spark, stored, places, folder).count() == 0


def padding(histogram, ends):
    return sum(n * (min(e for e in ends if e >= x) - x) for x, n in histogram.items())


@pytest.mark.parametrize("seed", range(8))
def test_boundaries_are_optimal(seed):
    r = random.Random(seed)
    histogram = {x: r.randint(1, 9) for x in r.sample(range(0, 60), r.randint(1, 11))}
    for buckets in (1, 2, 3, 4):
        got = packing.boundaries(histogram, buckets)
        assert got[-1] == max(histogram) and len(got) <= buckets
        lengths = sorted(histogram)
        best = min(padding(histogram, [*c, lengths[-1]]) for k in range(min(buckets, len(lengths))) for c in combinations(lengths[:-1], k))
        assert padding(histogram, got) == best


def test_boundaries_of_many_lengths_are_those_of_the_plain_recurrence():
    r = random.Random(3)
    for n, top in ((60, 5000), (200, 100_000), (40, 45)):
        histogram = {x: r.choice([1, 2, 1000, 10**7]) for x in r.sample(range(top), n)}
        lengths = sorted(histogram)
        best = [{0: 0} if j == 0 else {} for j in range(n + 1)]
        for j in range(1, n + 1):
            cost = 0
            for i in range(j - 1, -1, -1):  # a bucket over i+1..j
                cost += histogram[lengths[i]] * (lengths[j - 1] - lengths[i])
                for k, v in best[i].items():
                    if k < 7:
                        best[j][k + 1] = min(best[j].get(k + 1, 1 << 70), v + cost)
        for buckets in (1, 3, 7):
            got = packing.boundaries(histogram, buckets)
            assert padding(histogram, got) == min(v for k, v in best[n].items() if k <= buckets)


def test_packing(spark):
    data = texts(150) + [(1000, "w " * 6000)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3).withColumn("bucket", F.lit("clash"))
    got = packing.pack(spark, df, buckets=4, budget=1000).collect()
    assert len(got) == len(data)
    lengths = Counter((i, len((t or "").encode().split())) for i, t in data)
    assert Counter((r.doc_id, r.n_tokens) for r in got) == lengths
    batches = defaultdict(list)
    for r in got:
        assert r.n_tokens <= r.bucket_length and r.padding == r.bucket_length - r.n_tokens
        batches[r.bucket, r.batch].append(r)
    for own in batches.values():
        assert len(own) * own[0].bucket_length <= 1000 or len(own) == 1
        assert sorted(r.place for r in own) == list(range(len(own)))
    longest = defaultdict(int)
    for r in got:
        longest[r.bucket] = max(longest[r.bucket], r.n_tokens)
    assert all(r.bucket_length == longest[r.bucket] for r in got) and 6000 in longest.values()
    histogram = Counter(n for (_, n), k in lengths.items() for _ in range(k))
    assert sum(r.padding for r in got) == padding(histogram, packing.boundaries(histogram, 4))
    given = packing.pack(spark, df.withColumn("count", F.when(F.col("doc_id") > 3, F.col("doc_id"))), buckets=3, budget=500, tokens="count").collect()
    assert Counter((r.doc_id, r.n_tokens) for r in given) == Counter((i, i if i and i > 3 else 0) for i, _ in data)
    assert packing.pack(spark, df.limit(0)).count() == 0


def toxic_corpus(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        words = ["".join(r.choices(["an", "er", "ti", "on", "le"], k=r.randint(1, 4))) for _ in range(r.randint(5, 80))]
        toxic, junk = r.random() < 0.2, r.random() < 0.15
        if toxic:
            for _ in range(2):
                words[r.randrange(len(words))] = "gruff" + r.choice(["an", "er", "ti"]) + r.choice(["le", "on"])
        if junk:
            words = [w + "%%%" for w in words]
        out.append((i, " ".join(words), 0 if junk else 1, int(toxic)))
    return out


def test_chain_on_held_out_texts(spark):
    train, test = toxic_corpus(500, 1), toxic_corpus(300, 2)
    frame = lambda d: spark.createDataFrame(d, "doc_id long, text string, quality int, toxic int")
    df = frame(train)
    model = toxicity.train(spark, df.select("doc_id", "text"), df.select("doc_id", "quality", "toxic"), {"low": "1 - quality", "toxic": "toxic"})
    got = toxicity.score(frame(test).withColumn("p_toxic", F.lit("clash")), model).collect()
    assert len(model.earlier[0]) == 0 and len(model.earlier[1]) == 1
    for name, label in (("is_toxic", [r.toxic for r in got]), ("is_low", [1 - r.quality for r in got])):
        said = [int(r[name]) for r in got]
        hit = sum(a and b for a, b in zip(said, label, strict=True))
        assert hit >= 0.95 * sum(label) and hit >= 0.95 * sum(said)


def test_chain_without_labels_or_texts(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(spark, docs, labels, {"toxic": "toxic"})
    assert [(r.doc_id, r.is_toxic) for r in toxicity.score(docs, model).collect()] == [(1, False), (2, False), (3, False)]
    assert toxicity.score(docs.limit(0), model).count() == 0
    one = toxicity.train(spark, docs, spark.createDataFrame([(1, 0), (2, 0), (2, 0)], "doc_id long, toxic int"), {"toxic": "toxic"})
    assert not any(r.is_toxic for r in toxicity.score(docs, one).collect())
    assert rows(toxicity.score(docs, model).select("doc_id")) == [(1,), (2,), (3,)]


def test_ties_do_not_depend_on_the_order_of_rows(spark):
    data = [(1, f"text {i} " * (i % 5)) for i in range(40)] + [(2, None), (2, ""), (None, "x"), (None, "y")]
    one = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    two = spark.createDataFrame(data[::-1], "doc_id long, text string").repartition(2)
    for apply in (lambda df: shard.assign(spark, df, 3), lambda df: packing.pack(spark, df, 3, 50).withColumn("text", F.lit(0))):
        a, b = (rows(apply(df).drop("text")) for df in (one, two))
        assert a == b


def plain_fit(x, y):
    """The minimum of the penalised loss by Newton's method on dense rows."""
    rate = y.mean() if len(y) else 0.0
    w = np.append(np.zeros(x.shape[1]), np.log(max(rate, 1e-9) / max(1 - rate, 1e-9)))
    if rate in (0.0, 1.0):
        return w
    x = np.column_stack((x, np.ones(len(x))))
    ridge = np.append(np.full(x.shape[1] - 1, toxicity.PENALTY), 0.0)
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) / len(x) + np.diag(ridge), x.T @ (p - y) / len(x) + ridge * w)
    return w


@pytest.mark.parametrize("seed", range(3))
def test_chain_is_that_of_a_plain_version(spark, seed):
    r = np.random.default_rng(seed)
    n, width = 150, 12
    x = (r.random((n, width)) < 0.3).astype(float)
    first = (x[:, 0] + x[:, 1] + r.random(n) > 1.4).astype(int)
    second = (first + x[:, 2] + r.random(n) > 1.8).astype(int)
    labels, folds = np.column_stack((first, second, np.zeros(n, dtype=int))), r.permutation(n) % toxicity.FOLDS
    rows_ = [np.flatnonzero(row).tolist() for row in x]
    features, names = {f"w{i}@1": i for i in range(width)}, ["a", "b", "c"]
    model = toxicity.train_chain(rows_, labels, features, names, folds, toxicity.fits_in_tasks(spark) if seed == 0 else toxicity.fits_here)
    dense, said = x, np.zeros((n, 0))
    for k in range(3):
        y = labels[:, k].astype(float)
        w = plain_fit(dense, y)
        assert np.allclose(np.append(model.weights[k], model.earlier[k]), w[:-1], atol=1e-3) and abs(model.bias[k] - w[-1]) < 1e-3
        out = np.zeros(n)
        for f in range(toxicity.FOLDS):
            wf = plain_fit(dense[folds != f], y[folds != f])
            out[folds == f] = 1 / (1 + np.exp(-(dense[folds == f] @ wf[:-1] + wf[-1])))
        final = 1 / (1 + np.exp(-(np.column_stack((x, said)) @ w[:-1] + w[-1])))
        assert np.allclose([model.probabilities(p)[k] for p in rows_], final, atol=1e-3)
        dense, said = np.column_stack((dense, out)), np.column_stack((said, final))


def test_model_does_not_depend_on_the_order_of_rows(spark):
    data = [(i, t, q, x) for i, t, q, x in toxic_corpus(120, 3)]
    data += [(i + 1000, t, 1 - q, x) for i, t, q, x in data[:40]]  # equal texts with other labels
    frame = lambda d, n: spark.createDataFrame(d, "doc_id long, text string, quality int, toxic int").repartition(n)
    models = []
    for df in (frame(data, 2), frame(data[::-1], 5)):
        models.append(toxicity.train(spark, df.select("doc_id", "text"), df.select("doc_id", "quality", "toxic"), {"low": "1 - quality", "toxic": "toxic"}))
    a, b = models
    assert a.features == b.features and a.threshold == b.threshold and a.bias == b.bias
    assert all((v == w).all() for v, w in zip(a.weights + a.earlier, b.weights + b.earlier, strict=True))
    out = toxicity.score(frame(data, 2).withColumn("P_Toxic", F.lit(1)), a)
    assert out.columns == ["doc_id", "text", "quality", "toxic", "p_low", "p_toxic", "is_low", "is_toxic"]
    features = lambda t: sorted(a.features[f] for f in toxicity.text_features((t or "").encode()) if f in a.features)
    for r in out.collect():
        assert a.probabilities(features(r.text)) == [r.p_low, r.p_toxic]
