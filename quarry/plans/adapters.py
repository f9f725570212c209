"""The test tables in the roles of reviews, businesses, baskets, texts and points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import baskets as bk

#: Words that the text queries leave out.
STOPWORDS = ["the", "of", "and", "to", "in", "is", "that", "for", "it", "on", "with", "as", "was", "at", "by", "an", "be", "this", "are", "or"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of an order is a review: user_id, item_id, supplier_id, stars 1 to 5, date."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), F.col("l_suppkey").alias("supplier_id"), F.ceil(F.col("l_quantity") / 10).cast("double").alias("stars"), F.col("o_orderdate").alias("date")
    )


def businesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with two categories each."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.concat_ws(", ", "p_type", "p_brand").alias("categories"))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with their nation as state."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("supplier_id"), F.col("n_name").alias("state"))


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The brands of an order."""
    brands = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(brands, F.col("l_partkey") == F.col("p_partkey"))
    return bk.baskets(rows, "l_orderkey", "p_brand")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "text")


def stopwords(spark: SparkSession, *more: str) -> DataFrame:
    return spark.createDataFrame([(w,) for w in dict.fromkeys([*STOPWORDS, *more])], "word string")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings, with their label as a cluster."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("int").alias("cluster"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.operators import cf

    return cf.ratings(reviews(spark, sf_dir))
