import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from quarry.llm import ngram_join, packing, substring, toxicity  # noqa: E402
from test_duplicates import brute_components, brute_removed  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        out = stage(spark, docs, FOLDER)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert out.columns == docs.columns
        after = {r["doc_id"]: r for r in out.collect()}
        if name == "toxicity":
            assert set(after) < {i for i, _ in before}
            labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
            gone = {i for i, _ in before} - set(after)
            known = [labels[i] for i in gone if i in labels]
            assert sum(known) >= 0.9 * len(known)
        elif name == "near_copies":
            assert set(after) == {i for i, (_, c) in brute_components(before).items() if c == i}
        elif name == "repeated_passages":
            texts = dict(before)
            for i, (_, gone, kept) in brute_removed(before).items():
                assert after[i].text == (kept if gone else texts[i])
        else:
            assert {i: r.n_tokens for i, r in after.items()} == {i: len((t or "").encode().split()) for i, t in before}
        docs = out


def test_each_stage_calls_its_operator(monkeypatch):
    called = []
    monkeypatch.setattr(toxicity, "train", lambda *a, **k: None)
    monkeypatch.setattr(corpus_pipeline, "plain", lambda docs: docs)
    for module, name in ((toxicity, "rejected"), (ngram_join, "component_filter"), (substring, "dedup"), (packing, "pack")):
        def stop(*a, _n=name, **k):
            called.append(_n)
            raise StopIteration

        monkeypatch.setattr(module, name, stop)

    class Anything:
        columns = []

        def __getattr__(self, name):
            return Anything()

        def __call__(self, *a, **k):
            return Anything()

    for _, stage in corpus_pipeline.STAGES:
        with pytest.raises(StopIteration):
            stage(Anything(), Anything(), "")
    assert called == ["rejected", "component_filter", "dedup", "pack"]


def test_stages_with_odd_rows(spark):
    """Nulls in any column, empty texts, repeated rows and ids, very long texts, and further columns with clashing names."""
    long = " ".join(f"w{i}" for i in range(30_000))
    one, two = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    data = [(1, one, "en", "s", 9), (1, one, "en", "s", 9), (2, one, None, None, None), (3, None, "en", "s", 0), (4, "", "en", "s", 0), (None, two, "en", "s", 5), (None, None, None, None, None), (5, two, "en", "s", 5), (6, long, "en", "s", 1), (7, long, "en", "s", 1), (8, "x " + two, "en", "s", 7), (9, "short", "en", "s", 5)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    extra = docs.selectExpr("*", "1 as kept", "2 as is_toxic", "3 as Text", "4 as class", "5 as n_tokens", "6 as _key")
    want = {"toxicity": len(data), "near_copies": 8, "repeated_passages": len(data), "packing": len(data)}
    for name, stage in corpus_pipeline.STAGES:
        for df in (docs, extra):
            out = stage(spark, df, FOLDER)
            got = out.collect()
            assert len(got) == want[name], (name, sorted((r.doc_id or -1, (r.text or "")[:9]) for r in got))
            assert name == "packing" or out.columns == corpus_pipeline.COLUMNS and out.schema == docs.schema
            if name == "repeated_passages":
                texts = sorted(((r.doc_id or 0, (r.text or "")[:3]) for r in got))
                assert texts == sorted([(1, "a0 "), (1, "a0 "), (2, ""), (3, ""), (4, ""), (0, "b0 "), (0, ""), (5, "b0 "), (6, "w0 "), (7, ""), (8, "x"), (9, "sho")])
        assert stage(spark, extra.limit(0), FOLDER).count() == 0
