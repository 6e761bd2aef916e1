"""Connected components of link tables, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histomill.llm.common import join_hot, materialise


def _with_smallest(pairs: DataFrame) -> DataFrame:
    """``(a, b, m)``: the smallest of ``a`` and all its partners beside every pair. The middle of
    a large star has a large share of the pairs, hence the split join."""
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
    return join_hot(pairs, materialise(least, "least"), "a", "n").select("a", "b", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_smallest(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    told = _with_smallest(down)
    own = F.struct(F.col("a").alias("a"), F.col("m").alias("b"))
    other = F.struct(F.col("b").alias("a"), F.col("m").alias("b"))
    return told.select(F.explode(F.array(own, other)).alias("e")).select("e.*").where("a <> b")


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)``: the smallest node that each linked node of ``edges(a, b)`` reaches.
    Large-star and small-star rounds alternate until the links no longer change; every round is
    written to the shared folder, so each starts from stored data."""
    mark = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    now = materialise(edges.where("a <> b").distinct(), "links")
    seen = mark(now)
    while seen[0]:
        now = materialise(_small_star(materialise(_large_star(now).distinct(), "links")).distinct(), "links")
        if (after := mark(now)) == seen:
            break
        seen = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )
