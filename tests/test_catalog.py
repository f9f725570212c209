from itertools import combinations

from quarry.operators import bfr
from quarry.operators import kmeans as km
from quarry.plans import catalog


def test_registered_clusterings_have_the_default_rounds(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(km, "kmeans", lambda points, k, **more: asked.append(more) or km.assign(points, {0: [0.0] * 64}))
    monkeypatch.setattr(bfr.BFR, "feed", lambda self, points: None)
    catalog.QUERIES["kmeans_full"](spark, "/root/testdata/sf0.001")
    assert asked == [{}]
    assert catalog._bfr(spark, "/root/testdata/sf0.001").rounds == 200


def test_registered_item_sets_have_no_largest_size(spark, tmp_path):
    baskets = ["ABCDE", "ABCD", "AB", "E"]
    spark.createDataFrame([(i, "ABCDE".index(x)) for i, b in enumerate(baskets) for x in b], "l_orderkey long, l_partkey long").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame(list(enumerate("ABCDE")), "p_partkey long, p_brand string").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    want = {",".join(c): sum(set(c) <= set(b) for b in baskets) for k in range(1, 6) for c in combinations("ABCDE", k)}
    assert {r["items"] for r in catalog.QUERIES["son_candidates"](spark, str(tmp_path)).collect()} == set(want)
    assert {r["items"]: r["support"] for r in catalog.QUERIES["son_frequent"](spark, str(tmp_path)).collect()} == want
    assert {r["size"] for r in catalog.QUERIES["itemset_report"](spark, str(tmp_path)).collect()} == set(range(6))
