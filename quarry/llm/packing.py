"""Packing by optimal length buckets (operator 9).

The lengths of all documents are counted into one histogram with a row for
each length that occurs.  Dynamic programming over it chooses the bucket
boundaries with the least padding for a given number of buckets; each document
is padded to its bucket's boundary, which is the length of its longest member,
and a bucket's documents, in the order of their ids, form batches within a
token budget.

The histogram goes to the driver.  Its d rows hold different lengths, so the
table has at least d (d - 1) / 2 words: d is at most the root of twice the
words of the corpus, 6 million rows for 100 TB of text even if every length
occurred.  All arithmetic is in whole numbers, and the time is d times the
number of buckets.

Lengths are words, ``[^\\x20\\x09-\\x0D]+``, or what a column of token counts
says; ``n_tokens`` and the budget are in the same unit.

Defined cases: null and empty texts (and null or negative counts) have length 0
and share the first bucket; a document longer than the budget forms a batch of
its own; equal lengths share a bucket; rows with equal ids follow each other by
a hash of their texts; rows with a null id come first; other columns are
dropped; an empty table gives no rows.
"""

from __future__ import annotations

from array import array
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import partitions, ranked, shared_dir, stored

BUCKETS = 16
BUDGET = 65536


def boundaries(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Ascending boundaries, the longest length last, with the least sum of padding.

    With lengths l_1 < ... < l_m, the cost of a bucket over i+1..j is
    l_j (C_j - C_i) - (S_j - S_i), for running counts C and sums S.  For a last
    cut at i the cost up to j is a line in l_j of slope -C_i, and slopes fall
    with i as l_j grows with j: each layer walks once along the lower hull.
    """
    lengths = sorted(histogram)
    if not lengths:
        return []
    m = len(lengths)
    c = list(accumulate((histogram[x] for x in lengths), initial=0))
    s = list(accumulate((histogram[x] * x for x in lengths), initial=0))
    best = [lengths[j] * c[j + 1] - s[j + 1] for j in range(m)]  # one bucket
    cuts: list[array] = []
    for _ in range(1, min(buckets, m)):
        now, cut = list(best), array("q", [0]) * m
        hull: list[tuple[int, int, int]] = []  # slope, height, cut
        at = 0
        for j in range(1, m):
            slope, height = -c[j], best[j - 1] + s[j]
            while len(hull) - at > 1 and (height - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - slope):
                hull.pop()
            hull.append((slope, height, j))
            x = lengths[j]
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                at += 1
            cost = hull[at][0] * x + hull[at][1] + x * c[j + 1] - s[j + 1]
            if cost < now[j]:
                now[j], cut[j] = cost, hull[at][2]
        best = now
        cuts.append(cut)
    out, j = [lengths[-1]], m - 1
    for cut in reversed(cuts):
        if cut[j]:
            j = cut[j] - 1
            out.append(lengths[j])
    return out[::-1]


def length_of(text: str) -> F.Column:
    words = F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"))
    return F.coalesce(words, F.lit(0)).cast("long")


def pack(spark: SparkSession, docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, key: str = "doc_id", text: str = "text", tokens: str | None = None) -> DataFrame:
    """key, n_tokens, bucket, bucket_length, batch (in its bucket), place (in its batch) and padding of each document; ``tokens`` may name a column of token counts."""
    length = length_of(text) if tokens is None else F.greatest(F.coalesce(F.col(tokens), F.lit(0)), F.lit(0)).cast("long")
    lengths = stored(spark, docs.select(F.col(key).cast("long").alias("_key"), length.alias("n_tokens"), F.xxhash64(text).alias("_tie")), f"{shared_dir(spark, 'packing')}/lengths")
    histogram = {r["n_tokens"]: r["n"] for r in lengths.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}  # a row for each length, see above
    ends = boundaries(histogram, buckets)
    bucket = F.lit(len(ends) - 1)
    size = F.lit(ends[-1] if ends else 0)
    for i in range(len(ends) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= ends[i], F.lit(i)).otherwise(bucket)
        size = F.when(F.col("n_tokens") <= ends[i], F.lit(ends[i])).otherwise(size)
    sized = lengths.select("_key", "_tie", "n_tokens", bucket.cast("int").alias("bucket"), size.cast("long").alias("bucket_length"))
    placed = ranked(sized, "bucket", "_key", partitions(spark, docs), "_slot", "_tie")
    rows = F.greatest(F.lit(1), F.expr(f"{budget} div greatest(bucket_length, 1)"))
    return placed.select(
        F.col("_key").alias(key),
        "n_tokens",
        "bucket",
        "bucket_length",
        F.floor(F.col("_slot") / rows).cast("long").alias("batch"),
        (F.col("_slot") % rows).cast("long").alias("place"),
        (F.col("bucket_length") - F.col("n_tokens")).alias("padding"),
    )
