"""Ranks and false-discovery control as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histomill.storage import stored


def mid_rank(value: str, *keys: str) -> Column:
    """Rank of ``value`` within ``keys``, ties sharing their mean rank."""
    order = Window.partitionBy(*keys).orderBy(value)
    ties = Window.partitionBy(*keys, value)
    return F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0)


def counted_rank(counted: DataFrame, feature: str, value: str, size: str, spread: bool = False) -> DataFrame:
    """``counted`` (a row a feature and value, ``size`` of each) with ``rank``, the mid-rank of the
    value within its feature. ``spread`` ranks a feature in ranges of its values, whose sizes are
    added up before, so that no task holds all values of a feature; it is for pixels, and stores the
    ranges once."""
    half = (F.col(size) + 1) / F.lit(2.0)
    running = lambda *keys: F.coalesce(F.sum(size).over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if not spread:
        return counted.withColumn("rank", running(feature) + half)
    ranges = stored(counted.repartitionByRange(feature, value).withColumn("_range", F.spark_partition_id()), "ranges")
    of = ranges.groupBy(feature, "_range").agg(F.sum(size).alias("_of"))  # a row a feature and range
    before = of.select(feature, "_range", (F.sum("_of").over(Window.partitionBy(feature).orderBy("_range")) - F.col("_of")).alias("_before"))
    return ranges.join(before, [feature, "_range"]).withColumn("rank", F.col("_before") + running(feature, "_range") + half).drop("_range", "_before")


def tie_size(value: str, *keys: str) -> Column:
    return F.count(F.lit(1)).over(Window.partitionBy(*keys, value))


def with_bh(table: DataFrame, p: str = "pval", out: str = "pval_adj", *keys: str) -> DataFrame:
    """Benjamini-Hochberg adjusted p-values. The table has a row a feature, so its window over
    all rows (of a key) is bounded by the panel; rows without p stay without."""
    known = F.col(p).isNotNull()
    within = [*keys, known]
    order = Window.partitionBy(*within).orderBy(p)
    size = F.count(F.lit(1)).over(Window.partitionBy(*within))
    ranked = table.withColumn("_raw", F.when(known, F.least(F.lit(1.0), F.col(p) * size / F.row_number().over(order))))
    return ranked.withColumn(out, F.min("_raw").over(order.rangeBetween(Window.currentRow, Window.unboundedFollowing))).drop("_raw")
