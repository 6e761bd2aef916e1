"""The tables behind figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histomill.errors import require_column
from histomill.model import Cohort
from histomill.operators.filters import background_ratios


def metabolite_values(cohort: Cohort, name: str) -> Column:
    """A column about pixels of that name, else the feature's analysis value."""
    if name in cohort.pixels.columns:
        return F.col(name)
    return F.get(cohort.analysis_layer(), F.lit(cohort.index_of(name)))


def qc_fold_changes(cohort: Cohort, bins: int = 40) -> DataFrame:
    """``bin, low, high, n``: histogram of log2 tissue-to-background ratios."""
    ratios = background_ratios(cohort, "group").where("ratio > 0").select(F.log2("ratio").alias("v"))
    ends = ratios.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(1.0)
    placed = ratios.crossJoin(F.broadcast(ends)).select("lo", width.alias("w"), F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1)).cast("int").alias("bin"))
    return placed.groupBy("bin").agg((F.min("lo") + F.col("bin") * F.min("w")).alias("low"), (F.min("lo") + (F.col("bin") + 1) * F.min("w")).alias("high"), F.count(F.lit(1)).alias("n")).orderBy("bin")


def qc_retention(cohort: Cohort, thresholds: int = 120, highest: float = 10.0) -> DataFrame:
    """``threshold, n_kept``: features kept at every cutoff."""
    ratios = background_ratios(cohort, "group")
    cuts = cohort.pixels.sparkSession.range(thresholds).select((F.col("id") * highest / (thresholds - 1)).alias("threshold"))
    return cuts.crossJoin(F.broadcast(ratios.select("ratio"))).groupBy("threshold").agg(F.count_if(F.col("ratio") >= F.col("threshold")).alias("n_kept")).orderBy("threshold")


def spatial_map(cohort: Cohort, name: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """``section, x, y, value, vmin, vmax``: an ion image with limits at two percentiles over all
    sections."""
    rows = cohort.pixels.select("section", "x", "y", metabolite_values(cohort, name).alias("value"))
    ends = rows.agg(F.percentile("value", low).alias("vmin"), F.percentile("value", high).alias("vmax"))
    return rows.crossJoin(F.broadcast(ends))  # one row


def ion_images(cohort: Cohort, names: Sequence[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """``metabolite, section, x, y, value, vmin, vmax``: maps of several features, each feature's
    panels with the same limits in all sections."""
    at = [cohort.index_of(n) for n in names]
    long = cohort.long("section", "x", "y", layer=cohort.analysis_layer()).where(F.col("feature_idx").isin(at))
    ends = long.groupBy("feature_idx").agg(F.percentile("value", low).alias("vmin"), F.percentile("value", high).alias("vmax"))  # a row a feature
    return cohort.named(long.join(F.broadcast(ends), "feature_idx")).select("metabolite", "section", "x", "y", "value", "vmin", "vmax")


def image_overlay(cohort: Cohort, name: str, **placement: float) -> DataFrame:
    """``section, image_x, image_y, value`` of a feature's pixels on an image, with the extent of
    their section there."""
    from histomill.operators.image import align_image

    placed = align_image(cohort, **placement) if placement or "image_x" not in cohort.pixels.columns else cohort
    rows = placed.pixels.select("section", "image_x", "image_y", metabolite_values(placed, name).alias("value"))
    ends = rows.groupBy("section").agg(*[f(f"image_{c}").alias(f"{n}_{c}") for c in "xy" for n, f in (("low", F.min), ("high", F.max))])
    return rows.join(ends, "section")


def embedding_map(cohort: Cohort, rep: str, colour: str) -> DataFrame:
    require_column(cohort.pixels.columns, rep)
    return cohort.pixels.select(F.get(rep, F.lit(0)).alias("u"), F.get(rep, F.lit(1)).alias("v"), metabolite_values(cohort, colour).alias("colour"))


def group_means(cohort: Cohort, groupby: str, names: Sequence[str]) -> DataFrame:
    """``metabolite, group, mean, fraction_positive`` for heat maps, dot plots and markers."""
    at = [cohort.index_of(n) for n in names]
    long = cohort.long(F.col(groupby).cast("string").alias("group"), layer=cohort.analysis_layer()).where(F.col("feature_idx").isin(at))
    means = long.groupBy("group", "feature_idx").agg(F.avg("value").alias("mean"), F.avg((F.col("value") > 0).cast("double")).alias("fraction_positive"))
    return cohort.named(means).orderBy("metabolite", "group")


def volcano(result: DataFrame, effect: str = "log2fc", effect_cut: float = 1.0, p_cut: float = 0.05, n_top: int = 10) -> DataFrame:
    """``metabolite, effect, y, status, label``: p as -log10, and names for the strongest."""
    y = -F.log10(F.greatest("pval_adj", F.lit(1e-50)))
    far = (F.col("pval_adj") < p_cut) & (F.abs(effect) >= effect_cut)
    rows = result.select("metabolite", F.col(effect).alias("effect"), y.alias("y"), F.when(far & (F.col(effect) > 0), "up").when(far, "down").otherwise("ns").alias("status"))
    rank = F.row_number().over(Window.orderBy((F.col("status") == "ns").cast("int"), F.desc(F.abs("effect") * F.col("y")), "metabolite"))  # a row a feature
    return rows.withColumn("label", F.when((F.col("status") != "ns") & (rank <= n_top), F.col("metabolite"))).orderBy("metabolite")


def delta_volcano(result: DataFrame, effect_cut: float = 0.474, p_cut: float = 0.05, n_top: int = 10) -> DataFrame:
    """``metabolite, delta, y, score, status, label``: effects against p as -log10 (which ends at
    300), and names for the largest products of both."""
    y = -F.log10(F.greatest("pval_adj", F.lit(1e-300)))
    far = (F.col("pval_adj") < p_cut) & (F.abs("delta") >= effect_cut)
    rows = result.select("metabolite", "delta", y.alias("y"), (F.abs("delta") * y).alias("score"), F.when(far & (F.col("delta") > 0), "up").when(far, "down").otherwise("ns").alias("status"))
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "metabolite"))  # a row a feature
    return rows.withColumn("label", F.when(rank <= n_top, F.col("metabolite"))).orderBy(F.desc("score"), "metabolite")


def composition(cohort: Cohort, groupby: str, cluster_key: str = "cluster") -> DataFrame:
    """``group, cluster, n, percent``."""
    counts = cohort.pixels.groupBy(F.col(groupby).cast("string").alias("group"), F.col(cluster_key).cast("string").alias("cluster")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy("group"))).orderBy("group", "cluster")


def top_by(table: DataFrame, column: str, n: int = 20, name: str = "metabolite", absolute: bool = True) -> DataFrame:
    """The first rows by size of a column: effects, autocorrelation, classes."""
    key = F.abs(column) if absolute else F.col(column)
    return table.orderBy(F.desc(key), name).limit(n)


def effect_forest(result: DataFrame, n: int = 20) -> DataFrame:
    """The largest effects with their intervals, where there are any."""
    have = [c for c in ("delta_ci_low", "delta_ci_high", "ci_excludes_zero") if c in result.columns]
    return top_by(result.select("metabolite", "delta", "magnitude", *have), "delta", n)


def stacked_points(table: DataFrame, x: str, y: str, digits: int = 6) -> DataFrame:
    """``x, y, n``: how many features share a point."""
    return table.groupBy((F.round(x, digits) + 0.0).alias("x"), (F.round(y, digits) + 0.0).alias("y")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "x", "y")


def organization_matrix(values: DataFrame, samples: DataFrame, group_key: str, n: int = 30, result: DataFrame | None = None) -> DataFrame:
    """``metabolite, sample, group, value`` of the features with the largest effect, or variance."""
    if result is not None:
        chosen = top_by(result, "delta", n).select("metabolite")
    else:
        chosen = top_by(values.groupBy("metabolite").agg(F.var_samp("value").alias("v")), "v", n).select("metabolite")
    return values.join(chosen, "metabolite", "left_semi").join(samples.select("sample", F.col(group_key).alias("group")), "sample").select("metabolite", "sample", "group", "value").orderBy("group", "sample", "metabolite")


def pathway_dots(ora: DataFrame, n: int = 15, odds_cap: float = 50.0) -> DataFrame:
    """The first pathways of every direction; infinite odds are capped for drawing."""
    rank = F.row_number().over(Window.partitionBy("direction").orderBy("pval", "pathway"))
    return ora.withColumn("rank", rank).where(F.col("rank") <= n).withColumn("odds", F.least("odds_ratio", F.lit(odds_cap))).withColumn("y", -F.log10(F.greatest("pval_adj", F.lit(1e-300)))).orderBy("direction", "rank")


def marker_violin(cohort: Cohort, groupby: str, name: str) -> DataFrame:
    """``group, value`` of every pixel."""
    return cohort.pixels.select(F.col(groupby).cast("string").alias("group"), metabolite_values(cohort, name).alias("value"))
