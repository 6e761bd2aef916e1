"""From pixels to samples, and grouped summaries."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histomill.errors import InsufficientSamplesError, InvalidParameterError, listing, require_column
from histomill.model import VALUES, Cohort

# Prefixes of lipid shorthand, in the order in which they are tried.
LIPID_PREFIXES = [
    ("PC", "Phosphatidylcholine"),
    ("PE", "Phosphatidylethanolamine"),
    ("PS", "Phosphatidylserine"),
    ("PI", "Phosphatidylinositol"),
    ("PG", "Phosphatidylglycerol"),
    ("PA", "Phosphatidic acid"),
    ("SM", "Sphingomyelin"),
    ("Cer", "Ceramide"),
    ("HexCer", "Hexosylceramide"),
    ("TG", "Triglyceride"),
    ("DG", "Diglyceride"),
    ("MG", "Monoglyceride"),
    ("LPC", "Lysophosphatidylcholine"),
    ("LPE", "Lysophosphatidylethanolamine"),
    ("FA", "Fatty acid"),
    ("CE", "Cholesterol ester"),
]


@dataclass(frozen=True)
class Samples:
    """``values(sample, metric, metabolite, value)`` and ``samples(sample, n_pixels, ...)``."""

    values: DataFrame
    samples: DataFrame
    steps: tuple[str, ...] = ()

    def metric(self, name: str) -> Samples:
        return replace(self, values=self.values.where(F.col("metric") == name))


def _carried(cohort: Cohort, sample_key: str, carry_obs: Sequence[str] | None) -> list[str]:
    """Columns with at most one value in every sample, by one aggregate over all pixels."""
    if carry_obs is not None:
        for c in carry_obs:
            require_column(cohort.pixels.columns, c)
        return list(carry_obs)
    columns = [c for c in (*cohort.observations(), "section") if c != sample_key and c in cohort.pixels.columns]
    simple = {f.name for f in cohort.pixels.schema.fields if f.dataType.typeName() not in ("array", "map", "struct")}
    columns = [c for c in columns if c in simple]
    if not columns:
        return []
    # min and max combine before the shuffle, unlike distinct counts
    differ = [F.max((F.col(f"a{i}") != F.col(f"b{i}")).cast("int")).alias(c) for i, c in enumerate(columns)]
    ends = [f(F.col(c)).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("a", F.min), ("b", F.max))]
    row = cohort.pixels.groupBy(sample_key).agg(*ends).agg(*differ).first()
    return [c for c in columns if not row[c]]


def sizes(cohort: Cohort, sample_key: str, min_pixels: int, carry: Sequence[str]) -> DataFrame:
    """``sample, n_pixels`` and the carried columns of the samples that are large enough."""
    kept = [F.any_value(c).alias(c) for c in carry if c != "sample"]
    every = cohort.pixels.groupBy(F.col(sample_key).cast("string").alias("_sample")).agg(F.count(F.lit(1)).alias("n_pixels"), *kept)
    return every.withColumnRenamed("_sample", "sample").where(F.col("n_pixels") >= min_pixels)


def _warn_small(cohort: Cohort, sample_key: str, min_pixels: int) -> None:
    counts = cohort.pixels.groupBy(F.col(sample_key).cast("string").alias("s")).count()
    small, large = counts.agg(F.count_if(F.col("count") < min_pixels), F.count_if(F.col("count") >= min_pixels)).first()
    if not large:
        raise InsufficientSamplesError(f"No sample has {min_pixels} pixels.")
    if small:
        names = [r.s for r in counts.where(F.col("count") < min_pixels).orderBy("s").limit(8).collect()]
        warnings.warn(f"Dropped {small} samples of fewer than {min_pixels} pixels: {listing(names)}.", stacklevel=3)


def pseudobulk(
    cohort: Cohort, sample_key: str, method: str = "mean", layer: str | None = None, min_pixels: int = 10, carry_obs: Sequence[str] | None = None
) -> Samples:
    """One profile a sample: the mean, median or sum over its pixels."""
    ways = {"mean": F.avg, "median": F.median, "sum": F.sum}
    if method not in ways:
        raise InvalidParameterError(f"method must be one of {listing(ways)}, got {method!r}.")
    if min_pixels < 1:
        raise InvalidParameterError(f"min_pixels must be at least 1, got {min_pixels}.")
    require_column(cohort.pixels.columns, sample_key)
    _warn_small(cohort, sample_key, min_pixels)
    samples = sizes(cohort, sample_key, min_pixels, _carried(cohort, sample_key, carry_obs))
    long = cohort.long(F.col(sample_key).cast("string").alias("sample"), layer=cohort.layer(layer))
    values = long.groupBy("sample", "feature_idx").agg(ways[method]("value").alias("value")).join(samples.select("sample"), "sample", "left_semi")
    named = cohort.named(values).select("sample", F.lit("abundance").alias("metric"), "metabolite", "value")
    made = cohort.record("pseudobulk", {"sample_key": sample_key, "method": method, "layer": layer, "min_pixels": min_pixels})
    return Samples(named, samples, made.steps)


def lipid_class(name: Column) -> Column:
    out = F.lit("Other")
    for prefix, label in reversed(LIPID_PREFIXES):
        out = F.when(name.startswith(prefix), label).otherwise(out)
    return out


def lipid_class_summary(cohort: Cohort, groupby: str | None = None) -> DataFrame:
    """``lipid_class, n_metabolites, mean_intensity``, or a mean a group as a column."""
    classes = cohort.features().select("feature_idx", lipid_class(F.col("metabolite")).alias("lipid_class"))
    counts = classes.groupBy("lipid_class").agg(F.count(F.lit(1)).alias("n_metabolites"))
    keep = [groupby] if groupby else []
    # sums by feature first: a panel's rows meet the classes, not the pixels'
    sums = cohort.long(*keep, layer=cohort.analysis_layer()).groupBy(*keep, "feature_idx").agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    joined = sums.join(F.broadcast(classes), "feature_idx")
    mean = F.sum("s") / F.sum("n")
    if groupby:
        means = joined.groupBy("lipid_class").pivot(groupby).agg(mean)
    else:
        means = joined.groupBy("lipid_class").agg(mean.alias("mean_intensity"))
    return counts.join(means, "lipid_class").orderBy("lipid_class")


def cluster_diversity(cohort: Cohort, cluster_key: str = "cluster", groupby: str = "section", method: str = "shannon") -> DataFrame:
    """``groupby, diversity, n_clusters``: how evenly a group's pixels spread over clusters."""
    require_column(cohort.pixels.columns, cluster_key)
    counts = cohort.pixels.groupBy(groupby, cluster_key).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(groupby))
    part = counts.withColumn("p", share)
    score = -F.sum(F.col("p") * F.log("p")) if method == "shannon" else 1 - F.sum(F.col("p") * F.col("p"))
    return part.groupBy(groupby).agg(score.alias("diversity"), F.count(F.lit(1)).alias("n_clusters")).orderBy(F.desc("diversity"), groupby)
