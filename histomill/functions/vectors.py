"""Expressions over a pixel's array of feature values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def clipped(values: Column) -> Column:
    return F.transform(values, lambda v: F.greatest(v, F.lit(0.0)))


def median(values: Column) -> Column:
    """Median of an array, null if it is empty."""
    ordered, n = F.array_sort(values), F.size(values)
    low = F.get(ordered, F.floor((n - 1) / 2).cast("int"))
    high = F.get(ordered, F.floor(n / 2).cast("int"))
    return (low + high) / 2


def entropy(values: Column) -> Column:
    """Shannon entropy of clipped shares; 0 where they add up to nothing."""
    x = clipped(values)
    whole = F.when(total(x) == 0, F.lit(1.0)).otherwise(total(x))
    share = lambda v: v / whole
    return F.aggregate(x, F.lit(0.0), lambda a, v: a - F.when(v > 0, share(v) * F.log(share(v))).otherwise(0.0))


def simpson(values: Column) -> Column:
    """1 less the sum of squared clipped shares; 1 where they add up to nothing."""
    x = clipped(values)
    whole = F.when(total(x) == 0, F.lit(1.0)).otherwise(total(x))
    return 1 - F.aggregate(x, F.lit(0.0), lambda a, v: a + (v / whole) * (v / whole))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
