import pytest
from conftest import rows
from pyspark.errors import StreamingQueryException

from quarry.operators.bfr import BFR
from quarry.sources import readers, writers
from quarry.streaming import bfr_stream


def test_json_lines_with_mark_and_bad_lines(spark, tmp_path):
    p = tmp_path / "r.json"
    p.write_bytes(b'\xef\xbb\xbf{"review_id":"a","stars":4.0,"date":"2020-01-02 03:04:05"}\n{"review_id":"b","date":"no"}\nnonsense\n')
    got = [(r.review_id, r.stars, r.date and r.date.year) for r in readers.reviews(spark, str(p)).collect()]
    assert got == [("a", 4.0, 2020), ("b", None, None)]


def test_csv_and_stopwords(spark, tmp_path):
    df = spark.createDataFrame([("u", "b")], "user_id string, business_id string")
    writers.csv_table(df, str(tmp_path / "c"))
    assert rows(readers.csv_rows(spark, str(tmp_path / "c"))) == [("u", "b")]
    (tmp_path / "s.txt").write_text("the\nof\n")
    assert rows(readers.stopwords(spark, str(tmp_path / "s.txt"), "")) == [("",), ("of",), ("the",)]


def test_points_are_numbered_by_file(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1,0.5,1\n")
    (tmp_path / "b.txt").write_text("2,1,2\n")
    (tmp_path / "c.csv").write_text("3,1,2\n")
    assert rows(readers.points(spark, str(tmp_path))) == [(1, [0.5, 1.0], 0), (2, [1.0, 2.0], 1)]


def test_itemset_report(spark, tmp_path):
    sets = spark.createDataFrame([(["b"],), (["a"],), (["a", "b"],)], "items array<string>")
    writers.write_itemset_report(sets, sets.where("size(items) = 1"), str(tmp_path / "o"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "o").glob("part-*")))
    assert text.splitlines() == ["Candidates:", "('a'),('b')", "('a', 'b')", "Frequent Itemsets:", "('a'),('b')"]


def test_json_document(spark, tmp_path):
    writers.json_document(spark.createDataFrame([(1, None)], "A int, B string"), str(tmp_path / "d"))
    assert "".join(p.read_text() for p in (tmp_path / "d").glob("part-*")).strip() == '{"A":1,"B":null}'


def test_stream_feeds_rounds(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for k in range(2):
        (src / f"{k}.txt").write_text("".join(f"{100 * k + i},{i % 2 * 9 + i / 100},{k}\n" for i in range(30)))

    class Fed:
        def __init__(self):
            self.report, self.fed = [], -1

        def feed(self, batch, number):
            self.report.append(batch.count())
            self.fed = number

    fed = Fed()
    bfr_stream.run(readers.point_stream(spark, str(src)), fed, str(tmp_path / "check")).awaitTermination(60)
    assert fed.report == [30, 30] and fed.fed == 1


def test_stream_goes_on_after_a_failure(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    write = lambda k: (src / f"{k}.txt").write_text("".join(f"{100 * k + i},{i % 2 * 9 + i / 100},{i % 3}\n" for i in range(30)))
    write(0)
    run = lambda b: bfr_stream.run(readers.point_stream(spark, str(src)), b, str(tmp_path / "check")).awaitTermination(120)
    first = BFR(spark, str(tmp_path / "work"), 2, rounds=5)
    run(first)
    write(1)

    class Fails(BFR):
        def _commit(self):
            raise RuntimeError("lost")

    broken = Fails.resumed(spark, str(tmp_path / "work"), 2, rounds=5)
    with pytest.raises(StreamingQueryException):
        run(broken)
    again = BFR.resumed(spark, str(tmp_path / "work"), 2, rounds=5)
    assert again.report == first.report
    run(again)
    write(2)
    last = BFR.resumed(spark, str(tmp_path / "work"), 2, rounds=5)
    run(last)
    assert [r[2] + r[4] + r[5] for r in last.report] == [30, 60, 90]
    assert sorted(r.id for r in last.finalise().collect()) == sorted(100 * k + i for k in range(3) for i in range(30))
