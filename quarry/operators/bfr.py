"""BFR: clusters as counts, sums and sums of squares, fed chunk by chunk.

State: DS (discard sets, the clusters) and CS (compression sets,
mini-clusters), both as statistics, which BFR keeps in memory by design: 16
bytes a dimension for each; RS (retained points) and the points that joined a
set in each round, as tables in the shared folder.  After a round the state is
committed there with the round's number, and ``BFR.resumed`` goes on from the
last one, so a lost driver costs one round at most and no point counts twice.

Points meet the few DS as constants of the plan.  CS can be many: they go to
the tasks as arrays, and all pairs of CS are looked at in blocks by tasks, each
of which sends back a forest of the pairs that merge.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import inf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.measures import mahalanobis
from quarry.operators import kmeans as km
from quarry.sources.shared import stored

SAMPLE = 5000
SMALL = 20
#: Numbers of a block of distances that a task holds at a time.
CELLS = 1 << 21


@dataclass
class Stats:
    """Count, sums and sums of squares of a cluster."""

    n: int
    sums: list[float]
    squares: list[float]

    def mean(self) -> list[float]:
        return [s / self.n for s in self.sums]

    def variance(self) -> list[float]:
        return [max(0.0, q / self.n - (s / self.n) ** 2) for s, q in zip(self.sums, self.squares, strict=True)]

    def plus(self, other: Stats) -> Stats:
        return Stats(self.n + other.n, [a + b for a, b in zip(self.sums, other.sums, strict=True)], [a + b for a, b in zip(self.squares, other.squares, strict=True)])

    def distance(self, point: list[float]) -> float:
        total = 0.0
        for x, m, v in zip(point, self.mean(), self.variance(), strict=True):
            total += (x - m) ** 2 / v if v > 0 else (0.0 if x == m else inf)
        return sqrt(total)


def cluster_stats(assigned: DataFrame) -> DataFrame:
    """cluster, dim, n, sum, sumsq."""
    return assigned.select("cluster", F.posexplode("vec").alias("dim", "x")).groupBy("cluster", "dim").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sum"), F.sum(F.col("x") * F.col("x")).alias("sumsq"))


def collected(table: DataFrame) -> dict[int, Stats]:
    rows: dict[int, dict[int, tuple]] = {}
    for r in table.collect():
        rows.setdefault(r["cluster"], {})[r["dim"]] = (r["n"], r["sum"], r["sumsq"])
    return {c: Stats(v[0][0], [v[d][1] for d in sorted(v)], [v[d][2] for d in sorted(v)]) for c, v in rows.items()}


def nearest_stats(stats: dict[int, Stats], vec: str = "vec") -> Column:
    """A struct (d, c) of the nearest cluster by Mahalanobis distance; null without clusters."""
    if not stats:
        return F.lit(None).cast("struct<d:double,c:int>")
    table = km.constant([{"c": c, "m": s.mean(), "v": s.variance()} for c, s in sorted(stats.items())], "c:int,m:array<double>,v:array<double>")
    return F.array_min(F.transform(table, lambda x: F.struct(mahalanobis(F.col(vec), x["m"], x["v"]).alias("d"), x["c"].alias("c"))))


def assign_within(points: DataFrame, stats: dict[int, Stats]) -> DataFrame:
    """Adds ``cluster``: the nearest within 2 sqrt(dimensions), otherwise null."""
    near = points.withColumn("_n", nearest_stats(stats))
    return near.withColumn("cluster", F.when(F.col("_n.d") <= 2 * F.sqrt(F.size("vec").cast("double")), F.col("_n.c"))).drop("_n")


def arrays(stats: dict[int, Stats]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, means and variances of clusters, in order of their numbers."""
    keys = sorted(stats)
    return np.array(keys, dtype=np.int64), np.array([stats[c].mean() for c in keys]), np.array([stats[c].variance() for c in keys])


def distances(points: np.ndarray, means: np.ndarray, variances: np.ndarray) -> np.ndarray:
    """Squared Mahalanobis distances, points x clusters; a dimension without variance adds nothing where equal and infinity elsewhere."""
    gap = (points[:, None, :] - means[None]) ** 2
    with np.errstate(divide="ignore", invalid="ignore"):
        term = np.where(variances[None] > 0, gap / variances[None], np.where(gap == 0, 0.0, inf))
    return term.sum(axis=2)


def assign_within_many(points: DataFrame, stats: dict[int, Stats]) -> DataFrame:
    """``assign_within`` for any number of clusters, which go to the tasks as arrays."""
    if not stats:
        return points.withColumn("cluster", F.lit(None).cast("int"))
    keys, means, variances = arrays(stats)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // means.size)
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                vec = np.array(batch.column(1).to_pylist(), dtype=float).reshape(batch.num_rows, -1)
                d = distances(vec, means, variances)
                at = d.argmin(axis=1)
                far = d[np.arange(len(at)), at] > 4 * means.shape[1]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys[at], mask=far, type=pa.int32())], names=["id", "vec", "cluster"])

    return points.select("id", "vec").mapInArrow(run, "id long, vec array<double>, cluster int")


def merge_pairs(spark: SparkSession, stats: dict[int, Stats], forest: bool = False) -> DataFrame:
    """Pairs a < b of which the mean of either lies within the limit of the other; of each block of clusters all, or as few as join the same groups."""
    if not stats:
        return spark.createDataFrame([], "a int, b int")
    keys, means, variances = arrays(stats)
    step = max(1, CELLS // means.size)
    blocks = -(-len(keys) // step)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = 4 * means.shape[1]
        for batch in batches:
            for i in batch.column(0).to_pylist():
                own = slice(i * step, (i + 1) * step)
                near = (distances(means[own], means, variances) <= limit) | (distances(means, means[own], variances[own]).T <= limit)
                x, y = np.nonzero(near)
                x = x + i * step
                x, y = x[x < y], y[x < y]
                if forest:
                    goes = Groups()
                    keep = [goes.join(a, b) for a, b in zip(x.tolist(), y.tolist(), strict=True)]
                    x, y = x[keep], y[keep]
                yield pa.RecordBatch.from_arrays([pa.array(keys[x], type=pa.int32()), pa.array(keys[y], type=pa.int32())], names=["a", "b"])

    return spark.range(0, blocks, 1, min(blocks, 1024)).mapInArrow(run, "a int, b int")


class Groups(dict):
    """Groups of numbers, each under its lowest."""

    def root(self, c: int) -> int:
        while (up := self.get(c, c)) != c:
            self[c] = self.get(up, up)
            c = up
        return c

    def join(self, a: int, b: int) -> bool:
        """Whether the two were in different groups."""
        low, high = sorted((self.root(a), self.root(b)))
        self[high] = low
        return low != high


def merged(spark: SparkSession, stats: dict[int, Stats]) -> tuple[dict[int, Stats], dict[int, int]]:
    """Clusters after each group of merging pairs became one under its lowest number, and where each number went."""
    goes = Groups()
    for r in merge_pairs(spark, stats, forest=True).collect():  # less than a row for each cluster and block
        goes.join(r["a"], r["b"])
    out: dict[int, Stats] = {}
    for c in sorted(stats):
        r = goes.root(c)
        out[r] = out[r].plus(stats[c]) if r in out else stats[c]
    return out, {c: goes.root(c) for c in stats}


@dataclass
class BFR:
    """Clusters points fed by ``feed``; ``folder`` holds the tables between rounds and the state after each."""

    spark: SparkSession
    folder: str
    k: int
    sample: int = SAMPLE
    small: int = SMALL
    rounds: int = 200
    ds: dict[int, Stats] = field(default_factory=dict)
    cs: dict[int, Stats] = field(default_factory=dict)
    report: list[tuple[int, ...]] = field(default_factory=list)
    retained: str | None = None  # path of a table (id, vec)
    members: list[str] = field(default_factory=list)  # paths of tables (id, vec, kind, cluster), some for each round
    next_cs: int = 0
    fed: int = -1  # the number of the last chunk of a stream

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}-{len(self.report)}-{uuid.uuid4().hex}"

    def _stored(self, df: DataFrame, name: str) -> DataFrame:
        return stored(df, self._path(name))

    def _points(self, path: str | None) -> DataFrame | None:
        return None if path is None else self.spark.read.schema("id long, vec array<double>").parquet(path)

    def _joined(self) -> DataFrame:
        return self.spark.read.schema("id long, vec array<double>, kind string, cluster int").parquet(*self.members)

    def _join(self, assigned: DataFrame, kind: str, stats: dict[int, Stats]) -> None:
        """Adds points to clusters of a kind, and to the tables of those that joined."""
        for c, s in collected(cluster_stats(assigned)).items():
            stats[c] = stats[c].plus(s) if c in stats else s
        path = self._path("members")
        stored(assigned.select("id", "vec", F.lit(kind).alias("kind"), F.col("cluster").cast("int").alias("cluster")), path)
        self.members.append(path)

    def _retain(self, points: DataFrame) -> None:
        self.retained = self._path("kept")
        stored(points.select("id", "vec"), self.retained)

    def _compress(self, points: DataFrame) -> None:
        """Retained points of clusters of two and more become new CS, the others stay."""
        done = self._stored(km.kmeans(points, 5 * self.k, rounds=self.rounds), "retained")
        sizes = done.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
        numbers = {r["cluster"]: self.next_cs + i for i, r in enumerate(sizes.where("n > 1").orderBy("cluster").collect())}  # 5 k at most
        self.next_cs += len(numbers)
        self._retain(done.where(~F.col("cluster").isin(list(numbers))) if numbers else done)
        if numbers:
            pairs = self.spark.createDataFrame(list(numbers.items()), "cluster int, new int")
            self._join(done.join(F.broadcast(pairs), "cluster").select("id", "vec", F.col("new").alias("cluster")), "CS", self.cs)

    def _start(self, points: DataFrame) -> DataFrame:
        """Clusters a sample of the first chunk; the rest of it."""
        chosen = self._stored(points.orderBy(F.md5(F.concat_ws("-", F.lit(49), "id")), "id").limit(self.sample), "sample")
        rest = points.join(chosen.select("id"), "id", "left_anti")
        done = self._stored(km.kmeans(chosen, 5 * self.k, rounds=self.rounds), "first")
        large = done.join(done.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= self.small).select("cluster"), "cluster", "left_semi")
        if large.isEmpty():  # a first chunk too small for clusters of that size
            large = done
        inner = self._stored(km.kmeans(large.select("id", "vec"), self.k, rounds=self.rounds), "inner")
        self._join(inner, "DS", self.ds)
        outer = chosen.join(inner.select("id"), "id", "left_anti")
        if outer.isEmpty():
            self._retain(outer)
        else:
            self._compress(outer)
        return rest

    def feed(self, points: DataFrame, number: int | None = None) -> None:
        """One chunk of (id, vec); its state is committed at the end, under its number in a stream if it has one."""
        points = self._stored(points.select("id", "vec"), "chunk")
        if points.isEmpty() and not self.ds:
            return
        if not self.ds:
            points = self._start(points)
        near = self._stored(assign_within(points, self.ds), "near")
        self._join(near.where("cluster is not null"), "DS", self.ds)
        second = self._stored(assign_within_many(near.where("cluster is null").drop("cluster"), self.cs), "second")
        self._join(second.where("cluster is not null"), "CS", self.cs)
        left = second.where("cluster is null").select("id", "vec")
        left = left if self.retained is None else self._points(self.retained).unionAll(left)
        left = self._stored(left, "left")
        if left.isEmpty():
            self._retain(left)
        else:
            self._compress(left)
        self.cs, _ = merged(self.spark, self.cs)
        count = lambda s: (len(s), sum(x.n for x in s.values()))
        self.report.append((len(self.report) + 1, *count(self.ds), *count(self.cs), self._points(self.retained).count()))
        self.fed = self.fed + 1 if number is None else number
        self._commit()

    def _commit(self) -> None:
        """The state as a table of one row for each set, and one for the rest; Spark's marker of success makes it valid."""
        rest = {"report": self.report, "retained": self.retained, "members": self.members, "next_cs": self.next_cs, "fed": self.fed}
        rows = [("rest", 0, 0, [], [], json.dumps(rest))]
        rows += [(kind, c, s.n, s.sums, s.squares, None) for kind, stats in (("DS", self.ds), ("CS", self.cs)) for c, s in stats.items()]
        table = self.spark.createDataFrame(rows, "kind string, cluster int, n long, sums array<double>, squares array<double>, rest string")
        table.coalesce(1).write.parquet(f"{self.folder}/state/{len(self.report):09d}-{uuid.uuid4().hex}")

    @classmethod
    def resumed(cls, spark: SparkSession, folder: str, k: int, **more: int) -> BFR:
        """The clusterer of the last committed round in a folder; a new one if there is none."""
        out = cls(spark, folder, k, **more)
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/state")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return out
        names = sorted(f.getPath().getName() for f in fs.listStatus(path) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS")))
        if not names:
            return out
        for r in spark.read.parquet(f"{folder}/state/{names[-1]}").collect():
            if r["kind"] == "rest":
                rest = json.loads(r["rest"])
                out.report, out.members = [tuple(x) for x in rest["report"]], rest["members"]
                out.retained, out.next_cs, out.fed = rest["retained"], rest["next_cs"], rest["fed"]
            else:
                (out.ds if r["kind"] == "DS" else out.cs)[r["cluster"]] = Stats(r["n"], list(r["sums"]), list(r["squares"]))
        return out

    def round_report(self) -> DataFrame:
        names = "round_id, nof_cluster_discard, nof_point_discard, nof_cluster_compression, nof_point_compression, nof_point_retained"
        return self.spark.createDataFrame(self.report, ", ".join(f"{n.strip()} long" for n in names.split(",")))

    def finalise(self) -> DataFrame:
        """id, cluster: points of DS as they are, those of a CS and of RS with the nearest DS centre."""
        if not self.members:
            return self.spark.createDataFrame([], "id long, cluster int")
        centres = {c: s.mean() for c, s in self.ds.items()}
        members = self._joined()
        open_ = members.where("kind = 'CS'").select("id", "vec").unionAll(self._points(self.retained))
        return members.where("kind = 'DS'").select("id", "cluster").unionAll(finalise(open_, centres))


def finalise(points: DataFrame, centres: km.Centres) -> DataFrame:
    """id, cluster: the nearest centre of each point."""
    return km.assign(points, centres).select("id", F.col("cluster").cast("int").alias("cluster"))
