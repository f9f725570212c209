"""Document fingerprints by consistent weighted sampling (operator 3).

A text is a weighted set: its words, lower-cased in ASCII, each weighted by
its count times its length in bytes, so that the set measures the text that
words cover.  For each of ``SAMPLES`` samples every term draws two gamma
variables r, c and a uniform b from tables that its hash points into; weight w
gives the step t = floor(ln w / r + b) and the value ln c - r (t - b + 1), and
the term of the least value is the sample, with its step.  Two sets agree in a
sample with the probability of their generalised Jaccard similarity
sum(min) / sum(max), so the share of equal samples estimates it; its standard
error is at most 0.5 / sqrt(SAMPLES).

A fingerprint is a string of hexadecimal digits, four for each sample.

Defined cases: null text counts as empty; a text without words has the
fingerprint of all zeros, which is 1 like itself and 0 like any other; equal
texts have equal fingerprints; a table's next document follows in the order of
(doc_id, text), nulls first, and after the last comes the first (one row is its
own successor); an empty table gives no rows; other columns are dropped by
``compare_edited`` and kept by ``fingerprint`` unless named like its output
column, in any case of letters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import mix, partitions, range_bounds, slices, without

SAMPLES = 64
#: Rows of the tables of draws; r and c have rows of their own, so a term has one of ROWS * ROWS pairs.
ROWS = 8192
#: Terms of a set that are valued at a time (256 bytes each).
MANY = 65_536
SEED = 20_011


@lru_cache(maxsize=1)
def draws() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tables r, 1 / r, b and ln c of SAMPLES x ROWS."""
    g = np.random.Generator(np.random.PCG64(SEED))
    r = g.gamma(2.0, 1.0, (SAMPLES, ROWS)).astype(np.float32)
    c = np.log(g.gamma(2.0, 1.0, (SAMPLES, ROWS))).astype(np.float32)
    return r, (1 / r).astype(np.float32), g.random((SAMPLES, ROWS)).astype(np.float32), c


def values(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The value of each weighted term in each sample, SAMPLES x terms."""
    r, inv, b, c = draws()
    out = np.empty((SAMPLES, len(hashes)), dtype=np.float32)
    for k in range(0, len(hashes), 2048):
        h = hashes[k : k + 2048]
        i, j = (h % np.uint64(ROWS)).astype(np.int64), ((h >> np.uint64(32)) % np.uint64(ROWS)).astype(np.int64)
        shift, step = b.take(i, axis=1), inv.take(i, axis=1)
        step *= np.log(weights[k : k + 2048]).astype(np.float32)
        step += shift
        np.floor(step, out=step)
        shift -= step
        shift -= 1
        shift *= r.take(i, axis=1)
        shift += c.take(j, axis=1)
        out[:, k : k + 2048] = shift
    return out


def tags(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The chosen terms of the samples, with their steps, as 16-bit values (never 0)."""
    _, inv, b, _ = draws()
    every, row = np.arange(SAMPLES), (hashes % np.uint64(ROWS)).astype(np.int64)
    steps = np.floor(inv[every, row] * np.log(weights).astype(np.float32) + b[every, row])
    tag = mix(hashes ^ mix(steps.astype(np.int64).view(np.uint64) + np.uint64(SEED)))
    return (tag % np.uint64(65535)).astype(np.uint16) + np.uint16(1)


def terms(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct term hashes, ascending, and weights of each text."""
    for t in texts:
        words = t.lower().split()
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
        lengths = np.fromiter(map(len, words), dtype=np.float64, count=len(words))
        order = hashes.argsort()
        hashes = hashes[order]
        first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1]))) if len(words) else order
        yield hashes[first], np.add.reduceat(lengths[order], first) if len(words) else lengths


def chosen(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The tags of one set, however many terms it has: the least value of each sample is kept from block to block."""
    least, place = np.full(SAMPLES, np.inf, dtype=np.float32), np.zeros(SAMPLES, dtype=np.int64)
    for k in range(0, len(hashes), MANY):
        table = values(hashes[k : k + MANY], weights[k : k + MANY])
        at = table.argmin(axis=1)
        low = table[np.arange(SAMPLES), at]
        place, least = np.where(low < least, at + k, place), np.minimum(low, least)
    return tags(hashes[place], weights[place])


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """A row of SAMPLES values for each text; zeros where it has no words. A weighted term that several texts have is valued once, but for texts of very many terms."""
    out = np.zeros((len(texts), SAMPLES), dtype=np.uint16)
    sets = list(terms(texts))
    for k, (own, w) in enumerate(sets):
        if len(own) > MANY:
            out[k], sets[k] = chosen(own, w), (own[:0], w[:0])
    hashes, weights = (np.concatenate([s[i] for s in sets]) if sets else np.zeros(0) for i in (0, 1))
    if not len(hashes):
        return out
    _, first, place = np.unique(hashes ^ mix(weights.astype(np.uint64) + np.uint64(SEED)), return_index=True, return_inverse=True)
    table = values(hashes[first], weights[first])
    start = 0
    for k, (own, w) in enumerate(sets):
        if len(own):
            best = table.take(place[start : start + len(own)], axis=1).argmin(axis=1)
            out[k] = tags(own[best], w[best])
            start += len(own)
    return out


def shown(prints: np.ndarray) -> list[str]:
    return [p.astype(">u2").tobytes().hex() for p in prints]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal samples, row by row."""
    return (a == b).mean(axis=1)


def fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint of a text column."""
    kept = without(df.schema.fields, [out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, text, 1 << 20):
            prints = pa.array(shown(fingerprints([t or b"" for t in texts])), type=pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), prints], names=[*(f.name for f in kept), out])

    return df.mapInArrow(run, T.StructType([*kept, T.StructField(out, T.StringType())]))


def ranges_with_next(key: Column, bounds: list[int]) -> Column:
    """The range of a key and, for the first key of a range, also the range before it (the last for the first range), whose last row it follows."""
    cuts, n = np.array(bounds, dtype=np.int64), len(bounds)

    @F.pandas_udf("array<int>")
    def number(keys: pd.Series) -> pd.Series:
        values = keys.to_numpy(dtype=np.int64)
        at = np.maximum(0, np.searchsorted(cuts, values, side="right") - 1)
        opens = cuts[at] >= values
        return pd.Series([[a, n + (a or n) - 1] if o else [a] for a, o in zip(at.tolist(), opens.tolist(), strict=True)])

    return number(F.coalesce(key.cast("long"), F.lit(-(1 << 63))))


def compare_edited(spark: SparkSession, df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edit, whose last half is the next document's first code points, and how alike they are.

    The table is dealt to ranges of the key; the first row of a range is also
    sent to the range before it, so each task sees every row with its next.
    """
    bounds = range_bounds(df, key, partitions(spark, df))
    n = len(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str]] = []
        print_of: np.ndarray | None = None  # of the held row
        done = False

        def rows(follow: list[tuple[int | None, str]]) -> pa.RecordBatch:
            nonlocal print_of
            docs = [*held, *follow]
            fresh = [t.encode() for _, t in (follow if print_of is not None else docs)]
            edits = []
            for (_, a), (_, b) in zip(docs, docs[1:], strict=False):
                half = len(a) // 2
                edits.append((a[: len(a) - half] + b[:half]).encode())
            both = fingerprints([*fresh, *edits])
            own, edited = both[: len(fresh)], both[len(fresh) :]
            if print_of is not None:
                own = np.vstack([print_of[None], own])
            print_of = own[-1]
            keys = [k for k, _ in docs[:-1]]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, type=pa.int64()),
                    pa.array([len(t) for _, t in docs[:-1]], type=pa.int64()),
                    pa.array([hashlib.sha256(e).hexdigest() for e in edits]),
                    pa.array(shown(own[:-1])),
                    pa.array(shown(edited)),
                    pa.array(likeness(own[:-1], edited)),
                    pa.array(likeness(own[:-1], own[1:])),
                ],
                names=["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        for batch, texts in slices(batches, "text", 1 << 20):
            keys, over = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            follow = []
            for k, t, o in zip(keys, texts, over, strict=True):
                if not done:
                    follow.append((k, (t or b"").decode("utf-8", "replace")))
                    done = o  # the first row of the next range ends this one
            if not held and follow:
                held, follow = follow[:1], follow[1:]
            if follow:
                yield rows(follow)
                held = follow[-1:]

    spread = df.select(F.explode(ranges_with_next(F.col(key), bounds)).alias("at"), F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    dealt = spread.select(F.expr(f"at % {n}").alias("at"), "key", (F.col("at") >= n).alias("over"), "text").repartitionById(n, "at")
    ordered = dealt.sortWithinPartitions("over", F.asc_nulls_first("key"), F.asc_nulls_first("text")).select("at", "key", "over", "text")
    return ordered.mapInArrow(
        run, "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    ).withColumnRenamed("key", key)
