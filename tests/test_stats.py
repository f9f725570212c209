from conftest import rows
from pyspark.sql import functions as F

from quarry.functions.text import normal_words, simple_words
from quarry.operators import stats


def test_category_averages_drop_nulls_and_break_ties_by_name(spark):
    reviews = spark.createDataFrame([("b1", 5.0), ("b1", 3.0), ("b2", 4.0), ("b3", 5.0), ("b4", None)], "business_id string, stars double")
    business = spark.createDataFrame([("b1", "Food, Bar"), ("b2", "Bar"), ("b3", None), ("b4", "Food"), ("b2", "Bar")], "business_id string, categories string")
    got = [tuple(r) for r in stats.category_averages(reviews, business, 5).collect()]
    assert got == [("Bar", 4.0), ("Food", 4.0)]


def test_words(spark):
    df = spark.createDataFrame([("Hello, (World)! it's 5 can't",)], "text string")
    first, second = df.select(simple_words(F.col("text")), normal_words(F.col("text"))).first()
    assert first == ["hello", "world", "it's", "5", "can't"]
    assert [w for w in second if w] == ["hello", "world", "it", "can", "not"]


def test_counts_and_tops(spark):
    rows_ = [("u1", "2020-01-02 03:04:05"), ("u1", "2021-01-01 00:00:00"), ("u2", None), ("u3", "2020-05-05 00:00:00")]
    df = spark.createDataFrame(rows_, "user_id string, date string").withColumn("date", F.try_to_timestamp("date"))
    assert stats.count_reviews(df).first()[0] == 4
    assert stats.count_in_year(df, 2020).first()[0] == 2
    assert stats.count_users(df).first()[0] == 3
    assert [tuple(r) for r in stats.top_users(df, 2).collect()] == [("u1", 2), ("u2", 1)]


def test_top_words_ties_and_stopwords(spark):
    df = spark.createDataFrame([("b a the",), ("a b c",), (None,)], "text string")
    stop = spark.createDataFrame([("the",), ("",)], "word string")
    assert [tuple(r) for r in stats.top_words(df, 2, stop).collect()] == [("a", 2), ("b", 2)]


def test_heavy_items_and_partitions(spark):
    df = spark.createDataFrame([(i % 3,) for i in range(10)], "item int")
    assert rows(stats.heavy_items(df, 3, "item")) == [(0, 4)]
    assert rows(stats.partition_profile(df, 2, F.col("item"))) == [(0, 7), (1, 3)]
    assert rows(stats.dealt(df, 2, F.col("item")).select(F.spark_partition_id().alias("p")).groupBy("p").count()) == [(0, 7), (1, 3)]


def test_state(spark):
    r = spark.createDataFrame([("u", "x"), ("u", "x"), ("v", "y")], "user_id string, business_id string")
    b = spark.createDataFrame([("x", "NV"), ("y", "CA")], "business_id string, state string")
    assert rows(stats.reviews_in_state(r, b, "NV")) == [("u", "x"), ("u", "x")]


def test_report_has_one_row(spark):
    df = spark.createDataFrame([("u1", "2020-01-02 03:04:05", "good food"), ("u2", None, "good")], "user_id string, date string, text string").withColumn("date", F.try_to_timestamp("date"))
    r = stats.report(df, spark.createDataFrame([("food",)], "word string"), 2020, 5, 5).first()
    assert (r.A, r.B, r.C, [tuple(x) for x in r.D], r.E) == (2, 1, 2, [("u1", 1), ("u2", 1)], ["good"])
