"""Frequent item sets: two-phase, partitioned and exact.

Baskets are sorted arrays.  A set's occurrences are rows of the set and the
items that follow its last one in a basket; the next level takes one of these
items in.  Only sets that are candidates go on, so rows are not made for sets
that cannot be frequent, and occurrences are counted where they arise, before
anything moves.  A level that is found is a small table in the shared folder.

Equal baskets are one row with their number (``lists``): what follows costs the
different baskets, however many there are.  Where pairs are asked for, such a
table will do as well, and is then made once for all steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.sources.shared import kept


def baskets(rows: DataFrame, key: str, item: str) -> DataFrame:
    """Distinct (basket, item) pairs; null items and keys do not count. Either column may be the key: users with their businesses, or businesses with their users."""
    return rows.select(F.col(key).alias("basket"), F.col(item).alias("item")).dropna().repartition("basket").distinct()


def lists(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A row for each different basket: its items in order (held) and how many there are (weight). A table of such rows is given back."""
    by = by or []
    if "held" in pairs.columns:
        return pairs
    held = pairs.groupBy(*by, "basket").agg(F.array_sort(F.collect_set("item")).alias("held"))
    return held.groupBy(*by, "held").agg(F.count(F.lit(1)).alias("weight"))


def number(held: DataFrame) -> int:
    """The baskets of ``lists``."""
    return held.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]


def frequent_items(held: DataFrame, support: Column | int, by: list[str] | None = None) -> DataFrame:
    """Single items in at least so many baskets: items (an array), support. With ``by``, counted apart for each value."""
    by = by or []
    return held.select(*by, "weight", F.explode("held").alias("item")).groupBy(*by, "item").agg(F.sum("weight").alias("support")).where(F.col("support") >= support).select(*by, F.array("item").alias("items"), "support")


def only_frequent(held: DataFrame, frequent: DataFrame, by: list[str]) -> DataFrame:
    """Baskets without the items that are not frequent."""
    rows = held.withColumn("_id", F.monotonically_increasing_id()).select(*by, "weight", "_id", F.explode("held").alias("item"))
    kept_ = rows.join(frequent.select(*by, F.element_at("items", 1).alias("item")), [*by, "item"], "left_semi")
    return kept_.groupBy(*by, "_id", "weight").agg(F.array_sort(F.collect_list("item")).alias("held")).groupBy(*by, "held").agg(F.sum("weight").alias("weight"))


def occurrences(held: DataFrame, levels: list[DataFrame], by: list[str] | None = None) -> DataFrame:
    """items, tail (what follows in the basket), weight for each different basket and each set of the last level; levels hold the sets of 1, 2, ... items, and every set's first items are in the level before."""
    by = by or []
    rows = held.select(*by, "weight", F.array().cast(held.schema["held"].dataType).alias("items"), F.col("held").alias("tail"))
    for level in levels:
        rows = rows.select(*by, "weight", "items", "tail", F.posexplode("tail").alias("_at", "_next")).select(*by, "weight", F.concat("items", F.array("_next")).alias("items"), F.expr("slice(tail, _at + 2, size(tail))").alias("tail"))
        rows = rows.join(level.select(*by, "items"), [*by, "items"], "left_semi")
    return rows


def next_candidates(frequent: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sets of one item more whose subsets of the last size are all frequent.

    Two sets that differ in their last item are joined; the others of the
    subsets are counted by a join on them.
    """
    by = by or []
    base = frequent.select(*by, "items")
    size = F.size("items")
    left = base.select(*by, F.slice("items", F.lit(1), size - 1).alias("head"), F.element_at("items", -1).alias("x"))
    right = left.select(*by, "head", F.col("x").alias("y"))
    joined = left.join(right, [*by, "head"]).where("x < y").select(*by, F.concat("head", F.array("x", "y")).alias("items"))
    subsets = joined.withColumn("_n", F.size("items")).select(*by, "items", "_n", F.explode(F.transform(F.sequence(F.lit(1), F.size("items")), lambda i: F.filter("items", lambda v, k: k + 1 != i))).alias("sub"))
    known = subsets.join(base.withColumnRenamed("items", "sub"), [*by, "sub"], "left_semi")
    return known.groupBy(*by, "items").agg(F.count(F.lit(1)).alias("_k"), F.first("_n").alias("_n")).where("_k = _n").select(*by, "items")


def _counted(held: DataFrame, levels: list[DataFrame], by: list[str]) -> DataFrame:
    return occurrences(held, levels, by).groupBy(*by, "items").agg(F.sum("weight").alias("support"))


def count_sets(pairs: DataFrame, sets: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Baskets that hold each set: items, support; a set without baskets is not listed. With a set, its first items must be listed too, as they are in the result of a level-wise search."""
    by = by or []
    sets = kept(sets.select(*by, "items").distinct(), "sets")
    held = pairs if "held" in pairs.columns else kept(lists(pairs, by), "baskets")
    largest = sets.agg(F.coalesce(F.max(F.size("items")), F.lit(0))).first()[0]
    levels = [sets.where(F.size("items") == k) for k in range(1, largest + 1)]
    out = sets.select(*by, "items", F.lit(0).cast("long").alias("support")).limit(0)
    for k in range(1, largest + 1):
        out = out.unionAll(_counted(held, levels[:k], by).select(*by, "items", "support"))
    return out


def apriori(pairs: DataFrame, support: Column | int, max_size: int | None = None, by: list[str] | None = None) -> DataFrame:
    """All sets in at least so many baskets, level by level; the loop ends with the last level that has sets."""
    by = by or []
    held = pairs if "held" in pairs.columns else kept(lists(pairs, by), "baskets")
    levels = [kept(frequent_items(held, support, by), "sets")]
    if held.select(*by, F.explode("held").alias("_item")).distinct().count() > levels[0].count():
        held = kept(only_frequent(held, levels[0], by), "baskets")
    while (max_size is None or len(levels) < max_size) and not levels[-1].isEmpty():
        found = _counted(held, [*levels, next_candidates(levels[-1], by)], by)
        levels.append(kept(found.where(F.col("support") >= support).select(*by, "items", "support"), "sets"))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionAll(level)
    return out


def son_candidates(pairs: DataFrame, support: int, parts: Column, max_size: int | None = None) -> DataFrame:
    """Phase 1: sets that reach their share of the support in some part of the baskets: items.

    ``parts`` is an expression over ``basket``, or over the columns of ``lists``. A part of n of N baskets has
    the threshold support * n / N.
    """
    split = pairs.withColumn("part", parts.cast("int"))
    split = split if "held" in pairs.columns else kept(lists(split, ["part"]), "parts")
    sizes = split.groupBy("part").agg(F.sum("weight").alias("n"))
    total = sizes.agg(F.sum("n").alias("total"))
    need = sizes.join(total, F.lit(True)).select("part", (F.lit(support) * F.col("n") / F.col("total")).alias("need"))  # a row for each part
    rows = kept(split.join(F.broadcast(need), "part").select("part", "need", "held", "weight"), "parts")
    return kept(apriori(rows, F.col("need"), max_size, ["part", "need"]).select("items").distinct(), "candidates")


def son(pairs: DataFrame, support: int, parts: Column, max_size: int | None = None) -> DataFrame:
    """Phase 2: the candidates of phase 1, counted over all baskets: items, support. No frequent set is missed."""
    return count_sets(pairs, son_candidates(pairs, support, parts, max_size)).where(F.col("support") >= support)


def fp_growth(pairs: DataFrame, support: int) -> DataFrame:
    """The same sets by the built-in FP-growth: items (sorted), support."""
    from pyspark.ml.fpm import FPGrowth

    held = pairs.groupBy("basket").agg(F.collect_set("item").alias("items"))
    share = (support - 0.5) / max(1, held.count())
    found = FPGrowth(itemsCol="items", minSupport=max(share, 0.0)).fit(held).freqItemsets
    return found.select(F.array_sort("items").alias("items"), F.col("freq").alias("support"))
