"""Sharding by jump consistent hashing (operator 8).

The law is ``key``: a row's shard depends on its mixed key and the number of
shards alone.  There is no ring table; a key's last jump below the number of
shards is its shard, and one more shard takes rows only into itself.

Each row also gets a slot: its place in its shard, in ascending order of the
key, from 0 on without gaps.  Slots are counted per shard and range of the key,
so no shard is gathered in one task.

Defined cases: a null text has no bytes and the checksum of the empty text; a
null key is a key of its own; rows with equal keys share a shard and get
different slots, in the order of a hash of their texts (so only rows of equal
keys and texts may change places); an empty table gives no rows; extra columns
are kept unless they are named like an output column, in any case of letters.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import free, partitions, ranked, without

#: Fixed values of the hash: the multiplier of its generator, and 2**31.
MULTIPLIER = 2862933555777941757
SPAN = float(1 << 31)
NULL_KEY = "null key"


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards of 64-bit keys."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = keys.astype(np.uint64)
    shard = np.zeros(len(state), dtype=np.int64)
    left = np.arange(len(state))
    while len(left):
        state[left] = state[left] * np.uint64(MULTIPLIER) + np.uint64(1)
        step = (shard[left] + 1) * (SPAN / ((state[left] >> np.uint64(33)).astype(np.float64) + 1))
        inside = step < shards
        left = left[inside]
        shard[left] = step[inside].astype(np.int64)
    return shard.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a key of any type."""

    @F.pandas_udf(T.IntegerType())
    def number(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(dtype=np.int64).view(np.uint64), shards))

    return number(F.when(key.isNull(), F.xxhash64(F.lit(NULL_KEY))).otherwise(F.xxhash64(key)))


def assign(spark: SparkSession, df: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds size, text_crc32, law, shard, slot and grown_shard (with one more shard), and drops the text."""
    rest = [f.name for f in without(df.schema.fields, (text, "size", "text_crc32", "law", "shard", "slot", "grown_shard"))]
    (tie,) = free([*df.columns, "size", "text_crc32", "law", "shard", "slot", "grown_shard"], "_tie")
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b"").cast("binary"))
    dealt = df.select(
        *rest,
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col(key), shards).alias("shard"),
        shard_of(F.col(key), shards + 1).alias("grown_shard"),
        F.xxhash64(text).alias(tie),
    )
    return ranked(dealt, "shard", key, partitions(spark, df), "slot", tie).drop(tie)
