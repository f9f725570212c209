import itertools
import math
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from quarry.operators import baskets as bk
from quarry.operators import bfr, cf, minhash, profiles
from quarry.operators import kmeans as km
from quarry.operators import pairs as pr


def sets(df):
    return {tuple(r["items"]): r["support"] for r in df.collect()}


def test_frequent_sets_golden(spark):
    pairs = bk.baskets(spark.createDataFrame([(i, x) for i, b in enumerate(["ab", "abc", "ac", "b"]) for x in b], "b int, x string"), "b", "x")
    want = {("a",): 3, ("b",): 3, ("c",): 2, ("a", "b"): 2, ("a", "c"): 2}
    assert sets(bk.apriori(pairs, 2)) == want
    assert sets(bk.son(pairs, 2, F.pmod("basket", F.lit(2)))) == want
    assert sets(bk.fp_growth(pairs, 2)) == want
    assert sets(bk.son(pairs, 4, F.pmod("basket", F.lit(2)))) == {}


def test_son_is_brute_force(spark):
    r = random.Random(5)
    data = [set(r.sample("abcdef", r.randint(1, 4))) for _ in range(40)]
    pairs = bk.baskets(spark.createDataFrame([(i, x) for i, b in enumerate(data) for x in b], "b int, x string"), "b", "x")
    want = {}
    for k in range(1, 5):
        for c in itertools.combinations("abcdef", k):
            n = sum(set(c) <= b for b in data)
            if n >= 6:
                want[c] = n
    assert sets(bk.son(pairs, 6, F.pmod("basket", F.lit(3)))) == want


def test_sets_of_four_and_more(spark):
    r = random.Random(6)
    data = [set(r.sample("abcdefgh", r.randint(3, 7))) for _ in range(60)]
    pairs = bk.baskets(spark.createDataFrame([(i, x) for i, b in enumerate(data) for x in b], "b int, x string"), "b", "x")
    want = {}
    for k in range(1, 8):
        for c in itertools.combinations("abcdefgh", k):
            n = sum(set(c) <= b for b in data)
            if n >= 9:
                want[c] = n
    assert max(map(len, want)) >= 4
    assert sets(bk.apriori(pairs, 9)) == sets(bk.fp_growth(pairs, 9)) == sets(bk.son(pairs, 9, F.pmod("basket", F.lit(4)))) == want
    assert sets(bk.apriori(pairs, 9, 2)) == {c: n for c, n in want.items() if len(c) < 3}
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_wide_hashes_find_similar_sets_of_any_key(spark):
    r = random.Random(3)
    base = [[f"m{r.randrange(5000)}" for _ in range(60)] for _ in range(40)]
    data = [(f"k{2 * i}", m) for i, b in enumerate(base) for m in b] + [(f"k{2 * i + 1}", m) for i, b in enumerate(base) for m in b[:45] + [f"n{i}-{j}" for j in range(10)]]
    df = spark.createDataFrame(data, "k string, m string")
    exact = set(rows(minhash.similar(df, "k", "m", 0.4, n=None)))
    found = set(rows(minhash.similar(df, "k", "m", 0.4, n=60, rows=3, wide=True)))
    assert found <= exact and len(found) >= 0.9 * len(exact) >= 36
    made = minhash.candidate_pairs(minhash.bands(minhash.signatures(df, 60, "k", "m", wide=True), 3, "k"), "k").count()
    assert made < 0.2 * 80 * 79 / 2


def test_user_model_is_brute_force(spark):
    r = random.Random(4)
    train = {(u, i): float(r.randint(1, 5)) for u in range(25) for i in r.sample(range(30), r.randint(1, 12))}
    df = spark.createDataFrame([(*k, v) for k, v in train.items()], "user_id long, item_id long, stars double")
    items = {u: {i for v, i in train if v == u} for u in range(25)}
    of = minhash.parameters(30)
    sigs = {u: {(h, min((a * i + b) % m for i in items[u])) for h, a, b, m in of} for u in items}
    want = {}
    for u, v in itertools.combinations(items, 2):
        both = items[u] & items[v]
        if min(len(items[u]), len(items[v])) < 3 or len(both) < 3 or not sigs[u] & sigs[v] or len(both) < 0.01 * len(items[u] | items[v]):
            continue
        x, y = [train[u, i] for i in both], [train[v, i] for i in both]
        mx, my = sum(x) / len(x), sum(y) / len(y)
        over = sum((a - mx) * (b - my) for a, b in zip(x, y, strict=True))
        spread = sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y)
        if over > 1e-9 and spread > 1e-9:
            want[u, v] = over / math.sqrt(spread)
    got = {(a, b): s for a, b, s in rows(cf.user_model(df))}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)


def test_jaccard_bounds(spark):
    data = [(1, x) for x in (1, 2, 3)] + [(2, x) for x in (2, 3, 4)] + [(3, 100)] + [(4, x) for x in range(100, 120)]
    df = spark.createDataFrame(data, "k int, m int")
    assert rows(minhash.similar(df, "k", "m", 0.05, n=None)) == [(1, 2, 0.5), (3, 4, 0.05)]
    assert set(rows(minhash.similar(df, "k", "m", 0.05))) <= {(1, 2, 0.5), (3, 4, 0.05)}


def test_item_model_and_predictions(spark):
    train = cf.ratings(spark.createDataFrame([(u, i, s) for u, (a, b) in enumerate([(5, 4), (3, 2), (1, 1)]) for i, s in (("x", a), ("y", b))], "user_id int, item_id string, stars int"))
    (b1, b2, sim), = rows(cf.item_model(train))
    assert (b1, b2) == ("x", "y") and sim == pytest.approx(6 / (math.sqrt(8) * math.sqrt(42 / 9)), abs=1e-8)
    model = spark.createDataFrame([("p", "t", 0.5), ("q", "t", 0.25)], "b1 string, b2 string, sim double")
    mine = spark.createDataFrame([("u", "p", 4.0), ("u", "q", 2.0)], "user_id string, item_id string, stars double")
    want = spark.createDataFrame([("u", "t"), ("u", "z"), ("cold", "t")], "user_id string, item_id string")
    assert rows(cf.item_predict(mine, want, model)) == [("u", "t", pytest.approx(10 / 3, abs=1e-8))]


def test_constant_ratings_have_no_similarity(spark):
    train = cf.ratings(spark.createDataFrame([(u, i, 3) for u in range(4) for i in "xy"], "user_id int, item_id string, stars int"))
    assert rows(cf.item_model(train)) == []


def test_user_prediction_with_one_rater(spark):
    train = spark.createDataFrame([("t", "a", 3.0), ("n", "a", 4.0), ("n", "goal", 5.0)], "user_id string, item_id string, stars double")
    model = spark.createDataFrame([("n", "t", 0.5)], "u1 string, u2 string, sim double")
    want = spark.createDataFrame([("t", "goal"), ("cold", "goal")], "user_id string, item_id string")
    assert rows(cf.user_predict(train, want, model)) == [("t", "goal", 4.0)]


def test_duplicate_ratings(spark):
    df = spark.createDataFrame([(1, 1, 2.0, 1), (1, 1, 5.0, 2), (None, 1, 1.0, 1)], "user_id int, item_id int, stars double, date int")
    assert rows(cf.ratings(df)) == [(1, 1, 3.5)]
    assert rows(cf.ratings(df, dup="last")) == [(1, 1, 5.0)]


def test_tf_idf_and_cosine(spark):
    counts = spark.createDataFrame([(1, "w", 2), (1, "x", 4), (2, "x", 1), (3, "x", 1), (4, "x", 1)], "k int, word string, f int")
    got = {(r.k, r.word): r.score for r in profiles.tf_idf(counts, "k").collect()}
    assert got[1, "w"] == 1.0 and got[1, "x"] == 0.0
    users = spark.createDataFrame([("u", w) for w in "abcd"], "u string, word string")
    items = spark.createDataFrame([("i", w) for w in "abcefghij"], "k string, word string")
    assert rows(profiles.content_predict(users, items, "u", "k")) == [("u", "i", 0.5)]


def test_kmeans_golden(spark):
    points = spark.createDataFrame([(i, [float(x)]) for i, x in enumerate((0, 1, 10, 11))], "id long, vec array<double>")
    done = km.kmeans(points, 2, {0: [0.0], 1: [10.0]})
    assert rows(done.select("id", "cluster")) == [(0, 0), (1, 0), (2, 1), (3, 1)]
    assert km.objective(done).first()[0] == 2.0
    tie = spark.createDataFrame([(9, [5.0])], "id long, vec array<double>")
    assert rows(km.assign(tie, {0: [0.0], 1: [10.0]}).select("cluster")) == [(0,)]


def test_cluster_statistics(spark):
    s = bfr.Stats(4, [4.0, 8.0], [8.0, 24.0])
    assert s.mean() == [1.0, 2.0] and s.variance() == [1.0, 2.0]
    assert s.distance([2.0, 4.0]) == pytest.approx(math.sqrt(3))
    flat = bfr.Stats(2, [2.0], [2.0])
    assert flat.distance([1.0]) == 0.0 and flat.distance([1.5]) == math.inf
    one, goes = bfr.merged(spark, {3: flat, 7: bfr.Stats(1, [1.0], [1.0])})
    assert goes == {3: 3, 7: 3} and one[3].n == 3
    assert bfr.merged(spark, {}) == ({}, {})


def test_pairs_of_sets_are_those_of_a_plain_loop(spark, monkeypatch):
    r = random.Random(9)
    stats = {}
    for c in range(60):
        x = [[r.gauss(c % 12 * 9, 1), r.choice([0.0, 5.0])] for _ in range(4)]
        stats[3 * c] = bfr.Stats(4, [sum(p[i] for p in x) for i in (0, 1)], [sum(p[i] ** 2 for p in x) for i in (0, 1)])
    limit = 2 * math.sqrt(2)
    want = [(a, b) for a, b in itertools.combinations(sorted(stats), 2) if stats[a].distance(stats[b].mean()) <= limit or stats[b].distance(stats[a].mean()) <= limit]
    monkeypatch.setattr(bfr, "CELLS", 5000)  # two blocks
    assert rows(bfr.merge_pairs(spark, stats)) == sorted(want, key=repr)
    assert 0 < bfr.merge_pairs(spark, stats, forest=True).count() < len(want)
    groups = bfr.Groups()
    for a, b in want:
        groups.join(a, b)
    merged, goes = bfr.merged(spark, stats)
    assert goes == {c: groups.root(c) for c in stats} and sum(s.n for s in merged.values()) == 240
    points = spark.createDataFrame([(i, [r.uniform(-5, 110), r.choice([0.0, 5.0, 2.0])]) for i in range(80)], "id long, vec array<double>")
    assert rows(bfr.assign_within_many(points, stats).select("id", "cluster")) == rows(bfr.assign_within(points, stats).select("id", "cluster"))


def test_bfr_keeps_every_point(spark, tmp_path):
    r = random.Random(2)
    data = [(i, [r.gauss(20 * (i % 2), 1), r.gauss(0, 1)]) for i in range(120)] + [(900, [500.0, 500.0])]
    run = bfr.BFR(spark, str(tmp_path), 2, rounds=5)
    df = spark.createDataFrame(data, "id long, vec array<double>")
    for k in range(2):
        run.feed(df.where(F.col("id") % 2 == k) if k else df.where(F.col("id") % 3 == 0))
    seen = sum(1 for i, _ in data if i % 3 == 0) + sum(1 for i, _ in data if i % 2 == 1)
    assert all(len(x) == 6 for x in run.report)
    last = run.report[-1]
    assert last[2] + last[4] + last[5] == seen
    assert run.finalise().count() == seen
    again = bfr.BFR.resumed(spark, str(tmp_path), 2, rounds=5)
    assert (again.ds, again.cs, again.report, again.retained, again.members, again.fed) == (run.ds, run.cs, run.report, run.retained, run.members, 1)
    assert rows(again.finalise()) == rows(run.finalise())
    assert bfr.BFR.resumed(spark, str(tmp_path / "new"), 2).report == []


@pytest.mark.parametrize("kind", ["long", "string"])
def test_shared_groups_are_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(pr, "TILE", 8)  # groups of 1 to 30 members: up to four sides
    monkeypatch.setattr(pr, "HELD", 50)
    monkeypatch.setattr(pr, "PART", 40)
    r = random.Random(8)
    name = (lambda k: k) if kind == "long" else (lambda k: f"k{k:02}")
    data = {(name(k), g): float(r.randint(1, 5)) for g in range(12) for k in r.sample(range(30), r.randint(1, 30))}
    df = spark.createDataFrame([(*k, v) for k, v in data.items()], f"k {kind}, g int, v double")
    of = {k: {g for x, g in data if x == k} for k, _ in data}
    want = {}
    for a, b in itertools.combinations(sorted(of), 2):
        both = of[a] & of[b]
        x, y = [data[a, g] for g in both], [data[b, g] for g in both]
        if len(both) >= 3:
            want[a, b] = (len(both), sum(x), sum(y), sum(v * v for v in x), sum(v * v for v in y), sum(v * w for v, w in zip(x, y, strict=True)))
    assert {(a, b): tuple(more) for a, b, *more in rows(pr.shared(df, "k", "g", "v", 3))} == want
    least = {p: n for p, (n, *_) in want.items() if n / (len(of[p[0]]) + len(of[p[1]]) - n) >= 0.5}
    some = {(a, b): n for a, b, n in rows(pr.shared(df, "k", "g", least=3, jaccard=0.5))}
    assert least.items() <= some.items() <= {p: n for p, (n, *_) in want.items()}.items() and least


def test_plain_hashes_make_no_candidates(spark, monkeypatch):
    """They agree for most pairs by chance: similar pairs are found first, and then their hashes compared."""
    monkeypatch.setattr(minhash, "candidate_pairs", lambda *a: pytest.fail("candidates of plain hashes"))
    r = random.Random(7)
    data = {k: set(r.sample(range(60), r.randint(1, 20))) for k in range(40)}
    df = spark.createDataFrame([(k, m) for k, v in data.items() for m in v] * 2, "k long, m long")
    of = minhash.parameters(4)
    sigs = {k: [min((a * m + b) % c for m in v) for _, a, b, c in of] for k, v in data.items()}
    for size in (1, 2):
        near = {(a, b) for a, b in itertools.combinations(data, 2) if any(sigs[a][i : i + size] == sigs[b][i : i + size] for i in range(0, 4, size))}
        want = {(a, b) for a, b in near if len(data[a] & data[b]) / len(data[a] | data[b]) >= 0.2}
        assert {(a, b) for a, b, _ in rows(minhash.similar(df, "k", "m", 0.2, n=4, rows=size))} == want and want


def test_predictions_join_the_way_of_fewer_rows(spark, monkeypatch):
    r = random.Random(10)
    train = {(u, i): float(r.randint(1, 5)) for u in range(12) for i in r.sample(range(10), r.randint(1, 8))}
    df = spark.createDataFrame([(*k, v) for k, v in train.items()], "user_id long, item_id long, stars double")
    model = [(a, b, round(r.uniform(0.1, 1), 3)) for a, b in itertools.combinations(range(10), 2) if r.random() < 0.5]
    near = {(a, b): s for x, y, s in model for a, b in ((x, y), (y, x))}
    want = {}
    for u, t in train:
        top = sorted((-near[t, i], i) for v, i in train if v == u and (t, i) in near)[:5]
        if top:
            want[u, t] = pytest.approx(sum(-s * train[u, i] for s, i in top) / sum(-s for s, _ in top), abs=1e-8)
    table = spark.createDataFrame(model, "b1 long, b2 long, sim double")
    users = [(a, b, round(r.uniform(0.1, 1), 3)) for a, b in itertools.combinations(range(12), 2)]
    of_users = spark.createDataFrame(users, "u1 long, u2 long, sim double")
    found, rows_ = [], cf._rows
    for way in (1, -1):
        monkeypatch.setattr(cf, "_rows", lambda *a, n=itertools.count(0, way): next(n))  # one way of the two, then the other
        assert {(u, t): s for u, t, s in rows(cf.item_predict(df, df, table))} == want
        found.append(rows(cf.user_predict(df, df, of_users)))
    assert found[0] == found[1] and found[0]
    assert rows_(df.select(F.col("item_id").alias("_x")), table.select(F.col("b1").alias("_x")), "_x") == sum(b1 == i for _, i in train for b1, _, _ in model)


def test_content_in_blocks_of_users(spark, monkeypatch):
    r = random.Random(11)
    of = {f"u{k}": set(r.sample("abcdefghijkl", r.randint(1, 9))) for k in range(9)}
    items = {k: set(r.sample("abcdefghijkl", r.randint(1, 9))) for k in range(20)}
    u = spark.createDataFrame([(k, w) for k, v in of.items() for w in v], "u string, word string")
    i = spark.createDataFrame([(k, w) for k, v in items.items() for w in v], "k long, word string")
    want = {(a, b): pytest.approx(len(v & w) / math.sqrt(len(v) * len(w)), abs=1e-8) for a, v in of.items() for b, w in items.items() if v & w}
    monkeypatch.setattr(profiles, "BLOCK", 10)
    assert {(a, b): s for a, b, s in rows(profiles.content_predict(u, i, "u", "k"))} == want
    some = r.sample([(a, b) for a in of for b in items], 60)
    pairs = spark.createDataFrame(some, "u string, k long")
    assert {(a, b): s for a, b, s in rows(profiles.content_predict(u, i, "u", "k", pairs=pairs))} == {p: want[p] for p in some if p in want}


def test_words_dropped_before_an_apostrophe(spark):
    """As the plain pattern drops them, also where a word begins right behind a dropped sign."""
    from quarry.functions.text import normal_words

    texts = ["i don't know", "don't.isn't won't", "don'txisn't y", "n't a", "an't n'tn't b", "x_1n't, é9n't c", "can't 12$$3 a1b2 \n z", "$5.00 isn't"]
    out = F.translate(F.translate(F.lower("t"), "([,.!?:;])\\", " " * 12), "\n", "")
    out = F.replace(F.replace(out, F.lit("can't"), F.lit("can not")), F.lit("won't"), F.lit("will not"))
    for c in ("'m", "'re", "'ve", "'s", "'ll", "'d"):
        out = F.replace(out, F.lit(c), F.lit(" "))
    for old, new in ((r"[\p{L}\p{N}_]+n't.", ""), (r"\$*\p{Nd}+", ""), (r"\p{Nd}+.", " "), (r"^\s+|\s+$", "")):
        out = F.regexp_replace(out, old, new)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(F.split(out, " ").alias("want"), normal_words(F.col("t")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_equal_baskets_are_one_row(spark):
    data = ["ab", "ba", "abc", "ab", "c", "abd"] * 20
    pairs = bk.baskets(spark.createDataFrame([(i, x) for i, b in enumerate(data) for x in b], "b int, x string"), "b", "x")
    held = bk.lists(pairs.withColumn("part", F.pmod("basket", F.lit(2))), ["part"])
    assert {(r.part, "".join(r.held)): r.weight for r in held.collect()} == {(0, "ab"): 20, (0, "abc"): 20, (0, "c"): 20, (1, "ab"): 40, (1, "abd"): 20}
    assert bk.number(held) == 120 and bk.lists(held) is held
    want = {("a",): 100, ("b",): 100, ("c",): 40, ("a", "b"): 100}
    assert sets(bk.son(held, 30, F.col("part"))) == sets(bk.apriori(held, 30)) == sets(bk.apriori(pairs, 30)) == want


def test_values_are_made_where_the_key_is(spark):
    """No task holds values of all keys: members come together by key before they are aggregated."""
    df = spark.range(20).select((F.col("id") % 3).alias("k"), F.col("id").alias("m"))
    plan = minhash.signatures(df, 2, "k", "m")._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("HashAggregate") < plan.index("Exchange")


@pytest.mark.parametrize("kind", ["long", "string"])
def test_candidates_are_made_once(spark, monkeypatch, kind):
    monkeypatch.setattr(pr, "WIDE_TILE", 8)
    monkeypatch.setattr(pr, "HELD", 64)
    monkeypatch.setattr(pr, "COMPARED", 10)
    r = random.Random(12)
    data = [(k if kind == "long" else f"k{k:02}", m) for k in range(40) for m in r.sample(range(50), r.randint(1, 12))]
    df = spark.createDataFrame(data * 2, f"k {kind}, m long")
    for size, wide in ((1, False), (2, False), (2, True)):
        got = rows(minhash.candidates(df, 5, "k", "m", size, wide))  # the last band has one value
        assert got == rows(minhash.candidate_pairs(minhash.bands(minhash.signatures(df, 5, "k", "m", wide), size, "k"), "k")) and got


def test_words_are_counted_once_for_each_text(spark, monkeypatch):
    monkeypatch.setattr(profiles, "READ", 3)
    stop = spark.createDataFrame([("the",)], "word string")
    one = spark.createDataFrame([(1, "the b a b"), (2, "a"), (3, None), (4, "")], "k long, text string")
    assert rows(profiles.word_counts(one, stop, "k")) == [(1, "a", 1), (1, "b", 2), (2, "a", 1)]
    more = spark.createDataFrame([("x", "a b"), ("x", "a b"), ("x", "b  c"), (None, "d d")], "k string, text string")
    assert {tuple(r) for r in profiles.word_counts(more, stop, "k").collect()} == {("x", "a", 1), ("x", "b", 2), ("x", "c", 1), (None, "d", 2)}
