"""What the operators of this subpackage share.

Folders: everything that executors write and others read lies under the folder
named by ``spark.checkpoint.dir``.  Partition counts follow
``spark.sql.shuffle.partitions`` and the planner's estimate of the input size.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.sources import shared
from quarry.sources.shared import shared_dir

__all__ = ["shared_dir"]

#: Bytes of input (as the planner estimates them) for each partition of a shuffle.
PARTITION_BYTES = 8 << 20
#: Most range partitions; they stream their rows, so more would only shorten the tasks.
MOST_RANGES = 16384


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder and the folder's path in it."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def stored(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """Writes a table in a shared folder and reads it again: its lineage ends there."""
    return shared.stored(df, path)


def size_of(df: DataFrame) -> int:
    """Bytes of a table as the planner estimates them; 0 if it cannot."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 0 if size > 1 << 60 else size


def partitions(spark: SparkSession, df: DataFrame, most: int = 1 << 20) -> int:
    """How many partitions a shuffle of this table needs so that each fits in memory."""
    return int(min(most, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size_of(df) // PARTITION_BYTES))))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Pieces of the batches with at most so many bytes in a column (one row at least), and that column as UTF-8."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
        lengths = np.asarray(pc.binary_length(texts).fill_null(0), dtype=np.int64)
        ends, start = np.cumsum(lengths), 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start), texts.slice(start, stop - start).to_pylist()
            start = stop


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; memory that Arrow and the C library hold for later goes back once they are through, as workers outlive their tasks."""
    yield from batches
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A step whose worker gives its memory back at the end of a task."""
    return lambda batches: released(run(batches))


def free(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores in front until none is a column's."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def without(fields: list[T.StructField], names: Iterable[str]) -> list[T.StructField]:
    """The columns that are named like none of the names; Spark takes names as equal whatever the case of their letters."""
    taken = {n.lower() for n in names}
    return [f for f in fields if f.name.lower() not in taken]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes start, start + 1, ... of each piece, one piece after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 1 << 30 and (len(starts) == 0 or int(starts.max()) < 1 << 30) else np.int64
    out = np.arange(total, dtype=kind)
    out += np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def range_bounds(df: DataFrame, key: str, n: int) -> list[int]:
    """The first keys of about n ranges with about as many rows each; all of them occur in the table. Nulls do not count."""
    n = min(n, MOST_RANGES)
    at = [i / n for i in range(1, n)]
    row = df.agg(F.min(key).alias("low"), F.percentile_approx(key, at or [0.5], max(10_000, 20 * n)).alias("cuts")).first()
    if row is None or row["low"] is None:
        return [0]
    return sorted({row["low"], *(row["cuts"] if at else [])})


def range_of(key: Column, bounds: list[int]) -> Column:
    """The number of the range that holds a key; nulls and smaller keys are in the first."""
    cuts = np.array(bounds, dtype=np.int64)

    @F.pandas_udf(T.IntegerType())
    def number(keys: pd.Series) -> pd.Series:
        return pd.Series(np.maximum(0, np.searchsorted(cuts, keys.fillna(cuts[0]).to_numpy(dtype=np.int64), side="right") - 1).astype(np.int32))

    return number(F.coalesce(key.cast("long"), F.lit(int(bounds[0]))))


def ranked(df: DataFrame, group: str, key: str, n: int, out: str, *ties: str) -> DataFrame:
    """Adds a number from 0 on, without gaps, to the rows of each group, in the order of the key (nulls first), of equal ones in that of the other columns.

    No group is gathered in one task: it is cut into ranges of the key, whose
    sizes are counted and summed up first.
    """
    from pyspark.sql import Window

    bounds = range_bounds(df, key, n)
    range_, group_, at, count, before_, rank = free([*df.columns, out], "_range", "_group", "_at", "_count", "_before", "_rank")
    cut = df.withColumn(range_, range_of(F.col(key), bounds))
    before = (
        cut.groupBy(F.col(group).alias(group_), F.col(range_).alias(at)).agg(F.count("*").alias(count))
        .withColumn(before_, F.coalesce(F.sum(count).over(Window.partitionBy(group_).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop(count)
    )
    inner = cut.withColumn(rank, F.row_number().over(Window.partitionBy(group, range_).orderBy(F.col(key).asc_nulls_first(), *ties)) - 1)
    return (
        inner.join(before, F.col(group).eqNullSafe(F.col(group_)) & (F.col(range_) == F.col(at)))
        .withColumn(out, (F.col(before_) + F.col(rank)).cast("long"))
        .drop(group_, at, before_, rank, range_)
    )
