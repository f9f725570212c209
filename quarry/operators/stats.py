"""Counts and averages over reviews, and how rows are spread over partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import simple_words, strip


def count_reviews(reviews: DataFrame) -> DataFrame:
    return reviews.agg(F.count(F.lit(1)).alias("n"))


def count_in_year(reviews: DataFrame, year: int, date: str = "date") -> DataFrame:
    """Reviews of a year; null dates are in none."""
    return reviews.where(F.year(date) == year).agg(F.count(F.lit(1)).alias("n"))


def count_users(reviews: DataFrame, user: str = "user_id") -> DataFrame:
    return reviews.agg(F.count_distinct(user).alias("n"))


def top_users(reviews: DataFrame, m: int, user: str = "user_id") -> DataFrame:
    """The m users with the most reviews; of equal ones the first by id."""
    return reviews.groupBy(user).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(user)).limit(m)


def top_words(texts: DataFrame, n: int, stopwords: DataFrame, text: str = "text") -> DataFrame:
    """The n commonest words that are no stop words (compared without white space around); of equal ones the first by name."""
    words = texts.select(F.explode(simple_words(F.col(text))).alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    left = counts.withColumn("_plain", strip(F.col("word"))).join(stopwords.select(F.col("word").alias("_plain")), "_plain", "left_anti").drop("_plain")
    return left.orderBy(F.desc("n"), F.asc("word")).limit(n)


def report(reviews: DataFrame, stopwords: DataFrame, year: int, m: int, n: int) -> DataFrame:
    """One row: A reviews, B reviews of the year, C users, D top users, E top words."""
    users = top_users(reviews, m).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "user_id", "n"))).alias("d")).select(F.transform("d", lambda x: F.struct(x["user_id"].alias("user_id"), x["n"].alias("n"))).alias("D"))
    words = top_words(reviews, n, stopwords).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "word"))).alias("e")).select(F.transform("e", lambda x: x["word"]).alias("E"))
    base = reviews.agg(F.count(F.lit(1)).alias("A"), F.count(F.when(F.year("date") == year, 1)).alias("B"), F.count_distinct("user_id").alias("C"))
    return base.join(users, F.lit(True)).join(words, F.lit(True))  # one row each


def category_averages(reviews: DataFrame, business: DataFrame, num: int | None = None, item: str = "business_id") -> DataFrame:
    """Average stars of each category, best first, ties by name; null stars and categories do not count, a business counts once."""
    dim = business.where(F.col("categories").isNotNull()).select(item, "categories").dropDuplicates([item])
    facts = reviews.where(F.col("stars").isNotNull()).groupBy(item).agg(F.sum("stars").alias("_s"), F.count("stars").alias("_n"))  # a row for each item goes on
    each = facts.join(dim, item).select(F.explode(F.split("categories", ",")).alias("c"), "_s", "_n").select(F.trim("c").alias("category"), "_s", "_n")
    out = each.groupBy("category").agg((F.sum("_s") / F.sum("_n")).alias("avg_stars")).orderBy(F.desc("avg_stars"), F.asc("category"))
    return out if num is None else out.limit(num)


def heavy_items(reviews: DataFrame, n: int, item: str = "business_id") -> DataFrame:
    """Items with over n reviews."""
    return reviews.groupBy(item).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > n)


def partition_profile(df: DataFrame, partitions: int | None = None, by: Column | None = None) -> DataFrame:
    """Rows of each partition, as the table lies or dealt out by an explicit rule: partition_id, n_items.

    With ``by``, an integer column, row goes to partition ``by mod partitions``.
    """
    if by is not None:
        return df.groupBy(F.pmod(by, F.lit(partitions)).cast("int").alias("partition_id")).agg(F.count(F.lit(1)).alias("n_items"))
    return df.groupBy(F.spark_partition_id().alias("partition_id")).agg(F.count(F.lit(1)).alias("n_items"))


def dealt(df: DataFrame, partitions: int, by: Column) -> DataFrame:
    """The table itself, dealt to partitions by the same rule."""
    return df.repartitionById(partitions, F.pmod(by, F.lit(partitions)).cast("int"))


def reviews_in_state(reviews: DataFrame, business: DataFrame, state: str, user: str = "user_id", item: str = "business_id") -> DataFrame:
    """User and item of the reviews of businesses in a state; repeated reviews stay."""
    return reviews.select(user, item).join(business.where(F.col("state") == state).select(item).distinct(), item, "left_semi").select(user, item)
