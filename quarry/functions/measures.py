"""Similarities and distances as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A covariance or weight sum below this is zero.
TINY = 1e-9


def jaccard(shared: Column, n1: Column, n2: Column) -> Column:
    return shared / (n1 + n2 - shared)


def cosine(shared: Column, n1: Column, n2: Column) -> Column:
    """Of two sets, as vectors of zeros and ones."""
    return shared / F.sqrt(n1 * n2)


def pearson(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """From a number of pairs and their sums: the correlation if it is over 0, otherwise null (also where either side is constant)."""
    over = n * sxy - sx * sy
    spread = (n * sxx - sx * sx) * (n * syy - sy * sy)
    return F.when((over > TINY) & (spread > TINY), F.try_divide(over, F.sqrt(F.greatest(spread, F.lit(0.0)))))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def mahalanobis(point: Column, mean: Column, variance: Column) -> Column:
    """With a diagonal variance; a dimension without variance adds nothing where equal and makes the distance infinite elsewhere."""
    gap = F.zip_with(point, mean, lambda x, m: (x - m) * (x - m))
    term = lambda g, v: F.when(v > 0, F.try_divide(g, v)).when(g == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))
    return F.sqrt(total(F.zip_with(gap, variance, term)))
