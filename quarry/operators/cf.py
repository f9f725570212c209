"""Item- and user-based collaborative filtering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.measures import jaccard, pearson
from quarry.operators import minhash
from quarry.operators import pairs as pr
from quarry.sources.shared import kept

CO_RATERS = 3
ITEM_NEIGHBOURS, USER_NEIGHBOURS = 5, 50
DIGITS = 9


def ratings(rows: DataFrame, user: str = "user_id", item: str = "item_id", stars: str = "stars", dup: str = "mean", date: str = "date") -> DataFrame:
    """One rating for each user and item: the mean of repeated ones, or with dup='last' the one with the last date. Nulls do not count."""
    kept = rows.where(F.col(user).isNotNull() & F.col(item).isNotNull() & F.col(stars).isNotNull())
    value = F.avg(stars) if dup == "mean" else F.max_by(F.col(stars).cast("double"), F.struct(date, stars))
    return kept.groupBy(F.col(user).alias("user_id"), F.col(item).alias("item_id")).agg(value.alias("stars"))


def item_model(train: DataFrame, least: int = CO_RATERS) -> DataFrame:
    """b1 < b2, sim: Pearson over at least so many common raters, where it is over 0."""
    met = pr.shared(train, "item_id", "user_id", "stars", least).select(F.col("k1").alias("b1"), F.col("k2").alias("b2"), pearson(F.col("n"), *map(F.col, pr.SUMS)).alias("sim"))
    return met.where("sim > 0").select("b1", "b2", F.round("sim", DIGITS).alias("sim"))


def user_model(train: DataFrame, n: int = 30, least_items: int = 3, least: float = 0.01, shared: int = 3, wide: bool = False) -> DataFrame:
    """u1 < u2, sim: Pearson over common items, where it is over 0, of users that share a MinHash value and enough items, and are similar enough.

    Meetings over common items give the number shared and the correlation of a
    pair at once; their number is the sum over items of their squared raters.
    MinHash values then only have to agree for the few pairs that are left, so
    no candidates are made that share too few items.
    """
    active = train.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least_items)
    sets = kept(train.join(active, "user_id").select("user_id", "item_id", "stars"), "ratings")
    met = kept(pr.shared(sets, "user_id", "item_id", "stars", shared, least).withColumn("sim", pearson(F.col("n"), *map(F.col, pr.SUMS))).where("sim > 0"), "met")
    one, two = (active.select(F.col("user_id").alias(k), F.col("_n").alias(n)) for k, n in (("k1", "n1"), ("k2", "n2")))
    near = met.join(one, "k1").join(two, "k2").where(jaccard(F.col("n"), F.col("n1"), F.col("n2")) >= least).select("k1", "k2", "sim")
    agree = minhash.agreeing(near, sets, "user_id", "item_id", n, wide=wide)
    return agree.select(F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.round("sim", DIGITS).alias("sim"))


def _both_ways(model: DataFrame, a: str, b: str) -> DataFrame:
    return model.select(F.col(a).alias("_x"), F.col(b).alias("_y"), "sim").unionAll(model.select(F.col(b).alias("_x"), F.col(a).alias("_y"), "sim"))


def _rows(a: DataFrame, b: DataFrame, on: str) -> int:
    """Rows of a join."""
    one, two = (df.groupBy(on).agg(F.count(F.lit(1)).alias(n)) for df, n in ((a, "_n1"), (b, "_n2")))
    return one.join(two, on).agg(F.sum(F.col("_n1").cast("double") * F.col("_n2"))).first()[0] or 0


def _met(wanted: DataFrame, rated: DataFrame, ways: DataFrame, by: str) -> DataFrame:
    """wanted (_x, by) and rated (_y, by, ...) for the pairs (_x, _y, sim) of a model: what meets in both is joined by the way that makes fewer rows in between."""
    if _rows(wanted, ways, "_x") <= _rows(wanted, rated, by):
        return wanted.join(ways, "_x").join(rated, ["_y", by])
    return wanted.join(rated, by).join(ways, ["_x", "_y"])


def item_predict(train: DataFrame, test: DataFrame, model: DataFrame, n: int = ITEM_NEIGHBOURS) -> DataFrame:
    """user_id, item_id, stars: weighted mean over the n most similar items that the user rated, ties by item; pairs without one are left out."""
    wanted = kept(test.select("user_id", F.col("item_id").alias("_x")).distinct(), "wanted")
    near = _met(wanted, train.select("user_id", F.col("item_id").alias("_y"), "stars"), kept(_both_ways(model, "b1", "b2"), "ways"), "user_id")
    order = Window.partitionBy("user_id", "_x").orderBy(F.desc("sim"), F.asc("_y"))
    top = near.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n)
    out = top.groupBy("user_id", F.col("_x").alias("item_id")).agg((F.sum(F.col("sim") * F.col("stars")) / F.sum("sim")).alias("stars"))
    return out.where("stars > 0").select("user_id", "item_id", F.round("stars", DIGITS).alias("stars"))


def user_predict(train: DataFrame, test: DataFrame, model: DataFrame, n: int = USER_NEIGHBOURS) -> DataFrame:
    """user_id, item_id, stars: the user's mean plus the weighted mean deviation of the n most similar raters of the item from their mean over common items."""
    means = train.groupBy("user_id").agg(F.avg("stars").alias("_mean"))
    ways = kept(_both_ways(model, "u1", "u2").distinct(), "ways")
    theirs = train.select(F.col("user_id").alias("_y"), "item_id", "stars")
    common = _met(train.select(F.col("user_id").alias("_x"), "item_id"), theirs, ways, "item_id").groupBy("_x", "_y", "sim").agg(F.avg("stars").alias("_base"))
    wanted = kept(test.select(F.col("user_id").alias("_x"), "item_id").distinct(), "wanted")
    near = _met(wanted, theirs, ways, "item_id").join(common, ["_x", "_y", "sim"])
    order = Window.partitionBy("_x", "item_id").orderBy(F.desc("sim"), F.asc("_y"))
    top = near.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n)
    moved = top.groupBy("_x", "item_id").agg((F.sum((F.col("stars") - F.col("_base")) * F.col("sim")) / F.sum("sim")).alias("_move"))
    out = moved.join(means.withColumnRenamed("user_id", "_x"), "_x").select(F.col("_x").alias("user_id"), "item_id", (F.col("_mean") + F.col("_move")).alias("stars"))
    return out.where("stars > 0").select("user_id", "item_id", F.round("stars", DIGITS).alias("stars"))
