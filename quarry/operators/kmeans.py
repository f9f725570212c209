"""K-Means over (id, vec) tables; centres are few and travel as constants of the plan, so points never move to find theirs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.measures import euclidean
from quarry.sources.shared import kept

Centres = dict[int, list[float]]


def vectors(df: DataFrame, key: str, vec: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec"))


def constant(rows: list[dict], schema: str) -> Column:
    """An array of structs that is folded to one constant: the plan and its generated code are the same whatever the numbers, so each round's code is the last one's."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")


def _constant(centres: Centres) -> Column:
    return constant([{"c": c, "v": [*map(float, v)]} for c, v in sorted(centres.items())], "c:int,v:array<double>")


def nearest(centres: Centres, vec: str = "vec") -> Column:
    """A struct (d, c): distance and number of the nearest centre; of equally near ones the lowest."""
    return F.array_min(F.transform(_constant(centres), lambda x: F.struct(euclidean(F.col(vec), x["v"]).alias("d"), x["c"].alias("c"))))


def assign(points: DataFrame, centres: Centres) -> DataFrame:
    """id, vec, cluster, distance."""
    return points.withColumn("_n", nearest(centres)).select("id", "vec", F.col("_n.c").alias("cluster"), F.col("_n.d").alias("distance"))


def centroids(assigned: DataFrame) -> DataFrame:
    """cluster, dim, value: the mean of each dimension."""
    return assigned.select("cluster", F.posexplode("vec").alias("dim", "x")).groupBy("cluster", "dim").agg(F.avg("x").alias("value"))


def objective(assigned: DataFrame) -> DataFrame:
    """Sum of the distances (not squared)."""
    return assigned.agg(F.sum("distance").alias("objective"))


def collected(table: DataFrame) -> Centres:
    """Centres on the driver: a number for each cluster and dimension."""
    out: dict[int, dict[int, float]] = {}
    for r in table.collect():
        out.setdefault(r["cluster"], {})[r["dim"]] = r["value"]
    return {c: [v[d] for d in sorted(v)] for c, v in out.items()}


def first_centres(points: DataFrame, k: int, seed: int = 49) -> Centres:
    """The point first by a seeded digest of the id, then always the one farthest from all chosen (ties by id)."""
    row = points.orderBy(F.md5(F.concat_ws("-", F.lit(seed), "id")), "id").select("id", "vec").first()
    out: Centres = {}
    while row is not None and len(out) < k:
        out[len(out)] = list(row["vec"])
        far = points.select("id", "vec", nearest(out)["d"].alias("d"))
        row = far.where("d > 0").orderBy(F.desc("d"), F.asc("id")).select("id", "vec").first()
    return out


def kmeans(points: DataFrame, k: int, start: Centres | None = None, rounds: int = 200, seed: int = 49) -> DataFrame:
    """id, vec, cluster, distance of the last assignment; it stops when the objective does not fall. Empty clusters vanish and numbers close up."""
    points = kept(points.select("id", "vec"), "points")
    centres = start or first_centres(points, k, seed)
    if not centres:
        return points.select("id", "vec", F.lit(0).alias("cluster"), F.lit(0.0).alias("distance"))
    last = float("inf")
    for _ in range(rounds):
        done = assign(points, centres)
        moved = done.select("cluster", "distance", F.posexplode("vec").alias("dim", "x")).groupBy("cluster", "dim").agg(F.avg("x").alias("value"), F.sum("distance").alias("d")).collect()
        now = sum(r["d"] for r in moved if r["dim"] == 0)
        if not now < last:
            break
        last = now
        means: dict[int, dict[int, float]] = {}
        for r in moved:
            means.setdefault(r["cluster"], {})[r["dim"]] = r["value"]
        used = sorted(means)
        previous, centres = centres, {i: [means[c][d] for d in sorted(means[c])] for i, c in enumerate(used)}
    else:
        return assign(points, previous)
    return done
