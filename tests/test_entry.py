import importlib
import warnings

import pytest

import __spark_entry__ as E


def test_names_agree():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert "category_avg_stars" in E.queries()


def test_flagship(spark):
    assert E.entry(spark).columns == ["category", "avg_stars"]


@pytest.mark.parametrize("missing", ["quarry.llm", "corpus_pipeline", "ahocorasick"])
def test_library_does_not_need_the_subpackage(monkeypatch, missing):
    real = importlib.import_module

    def gone(name, *a):
        if name == missing or name == "quarry.llm.queries" and missing != "corpus_pipeline":
            raise ModuleNotFoundError(missing, name=missing)
        return real(name, *a)

    monkeypatch.setattr(importlib, "import_module", gone)
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        entry = {}
        exec(compile(open(E.__file__).read(), E.__file__, "exec"), entry)
    assert "pipeline" not in entry["queries"]() and "top_users" in entry["queries"]()
    assert missing == "corpus_pipeline" or not any(n.startswith("op") for n in entry["queries"]())
    assert any("ahocorasick" in str(w.message) for w in said) == (missing == "ahocorasick")


def test_faults_inside_the_subpackage_are_not_hidden(monkeypatch):
    def broken(name, *a):
        raise ModuleNotFoundError("quarry.llm.nothing", name="quarry.llm.nothing")

    monkeypatch.setattr(importlib, "import_module", broken)
    with pytest.raises(ModuleNotFoundError):
        exec(compile(open(E.__file__).read(), E.__file__, "exec"), {})


@pytest.mark.parametrize("name", ["top_users", "category_avg_stars", "heavy_items", "state_user_item", "son_frequent", "itemset_report", "ratings_last", "user_cf_predict", "kmeans_full", "review_file", "point_files", "report_file", "profile_files", "similar_file", "bfr_round_file"])
def test_queries_give_the_rows_of_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in "nation supplier part orders lineitem documents embeddings".split():
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = E.queries()[name](spark, folder)
    columns = sorted(got.columns)
    want = db.sql(E.oracle_sql()[name]).select(", ".join(columns)).fetchall()
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(want)
