"""Group tests on samples and on pixels: ranks by windows, tails by one small vectorised call."""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histomill.errors import InsufficientSamplesError, InvalidParameterError, PseudoreplicationWarning, listing, require_column
from histomill.functions import special
from histomill.functions.ranks import counted_rank, mid_rank, with_bh
from histomill.model import Cohort
from histomill.operators.samples import Samples

# Bounds of Cliff's delta between negligible, small, medium and large.
MAGNITUDES = [(0.147, "negligible"), (0.33, "small"), (0.474, "medium")]
PSEUDO_COUNT = 1e-9


def magnitude(delta: Column) -> Column:
    out = F.lit("large")
    for bound, name in reversed(MAGNITUDES):
        out = F.when(F.abs(delta) < bound, name).otherwise(out)
    return out


def rank_table(long: DataFrame, feature: str = "metabolite", group: str = "grp", spread: bool = False) -> DataFrame:
    """Per feature of two groups (``grp`` 1 and 2): sizes, ``u1``, the tie term ``sum(t^3-t)``,
    Cliff's delta (positive: group 1 larger), ``z`` and whether the feature is constant.

    Values are counted before they are ranked, so equal values (zeros, above all) meet in one
    row, and a rank is a running sum over distinct values (by ranges if ``spread``)."""
    counted = long.groupBy(feature, "value").agg(F.count_if(F.col(group) == 1).alias("c1"), F.count_if(F.col(group) == 2).alias("c2"))
    t = F.col("t")
    ranked = counted_rank(counted.withColumn("t", F.col("c1") + F.col("c2")), feature, "value", "t", spread)
    n1, n2, u1 = F.col("n1"), F.col("n2"), F.col("u1")
    n = n1 + n2
    return (
        ranked.groupBy(feature)
        .agg(
            F.sum("c1").alias("n1"),
            F.sum("c2").alias("n2"),
            F.sum(F.col("rank") * F.col("c1")).alias("r1"),
            F.sum(t.cast("double") * t * t - t).alias("ties"),
            (F.count(F.lit(1)) == 1).alias("constant"),
        )
        .where("n1 > 0 AND n2 > 0")
        .withColumn("u1", F.col("r1") - n1 * (n1 + 1) / F.lit(2.0))
        .withColumn("delta", 2 * u1 / (n1 * n2) - 1)
        .withColumn("_v", n1 * n2 / F.lit(12.0) * (n + 1 - F.col("ties") / (n * (n - 1))))
        .withColumn("z", F.when(F.col("_v") > 0, (F.greatest(u1, n1 * n2 - u1) - n1 * n2 / F.lit(2.0) - 0.5) / F.sqrt("_v")))
        .drop("r1", "_v")
    )


def with_rank_p(table: DataFrame, exact: bool | None = None) -> DataFrame:
    """``pval`` of rank tables: the exact null if the smaller group has at most 8 members and no
    feature of the table (constant ones aside) has ties, the normal one with tie and continuity
    correction otherwise; a constant feature has 1."""
    whole = Window.partitionBy()  # a row a feature
    no_ties = F.max(F.when(~F.col("constant"), F.col("ties")).otherwise(0.0)).over(whole) == 0
    small = F.least("n1", "n2") <= 8
    choice = (no_ties & small) if exact is None else F.lit(exact)
    p = special.mann_whitney_udf("u1", "n1", "n2", "ties", choice)
    return table.withColumn("pval", F.when(F.col("constant"), F.lit(1.0)).otherwise(p))


def cliffs_delta(long: DataFrame, feature: str = "metabolite", group: str = "grp") -> DataFrame:
    """``feature, delta, magnitude`` of a long table with groups 1 and 2."""
    return rank_table(long, feature, group).select(feature, "delta", magnitude(F.col("delta")).alias("magnitude"))


def _two_groups(samples: Samples, group_key: str, group1, group2, min_samples: int) -> DataFrame:
    require_column(samples.samples.columns, group_key)
    if group1 == group2:
        raise InvalidParameterError("The two groups are the same.")
    counts = {r[0]: r[1] for r in samples.samples.groupBy(F.col(group_key).cast("string")).count().collect()}
    for g in (group1, group2):
        if str(g) not in counts:
            raise InvalidParameterError(f"No sample has {group_key} {g!r}. There are: {listing(counts)}.")
        if counts[str(g)] < min_samples:
            raise InsufficientSamplesError(f"{group_key} {g!r} has {counts[str(g)]} samples, fewer than {min_samples}.")
    grp = F.when(F.col(group_key).cast("string") == str(group1), 1).when(F.col(group_key).cast("string") == str(group2), 2)
    chosen = samples.samples.select("sample", grp.alias("grp")).where("grp IS NOT NULL")
    return samples.values.join(chosen, "sample").select("sample", "metabolite", "value", "grp")


def _xxhash64(values: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64`` of ints (as unsigned numbers) after what ``seed`` hashes."""
    p1, p2, p3, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    h = (seed + p5 + np.uint64(4)) ^ (values.astype(np.uint32).astype(np.uint64) * p1)
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * p2 + p3
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def _drawn(size: int, replicate: int, group: int, seed: int) -> np.ndarray:
    """How often each of ``size`` samples of a group is drawn: draw ``j`` is the hash of (seed,
    replicate, group, j), modulo the size."""
    with np.errstate(over="ignore"):
        h = np.array([42], np.uint64)
        for part in (seed, replicate, group):
            h = _xxhash64(np.array([part]), h)
        h = _xxhash64(np.arange(1, size + 1), h)
    return np.bincount(h.view(np.int64) % size, minlength=size)


def _drawn_deltas(a: pa.Array, b: pa.Array, replicates: int, seed: int) -> list[float]:
    """Cliff's delta of every replicate. Values are ranked once; a replicate adds up its draws along
    the ranks, so no pairs are made. NaN is the largest value, as in Spark; nulls are drawn, and win
    and lose against nothing."""
    known = [v.is_valid().to_numpy(zero_copy_only=False) for v in (a, b)]
    values = [v.drop_null().to_numpy() for v in (a, b)]
    levels, place = np.unique(np.concatenate(values), return_inverse=True)
    out = []
    for rep in range(1, replicates + 1):
        ca, cb = (
            np.bincount(at, _drawn(len(k), rep, g, seed)[k], len(levels))
            for g, k, at in zip((1, 2), known, np.split(place, [len(values[0])]), strict=True)
        )
        wins = (ca * (2 * cb.cumsum() - cb - cb.sum())).sum()  # draws of b below, less those above
        out.append(float(wins) / (float(len(a)) * len(b)))
    return out


def bootstrap_delta(long: DataFrame, replicates: int, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """``metabolite, delta_ci_low, delta_ci_high``: percentile interval over samples drawn with
    replacement within their group, in order of their names. Draws are hashes of (seed, replicate,
    group, draw), so they do not depend on partitions; a draw is of samples and the same for all
    features."""
    values = lambda g: F.transform(
        F.array_sort(F.collect_list(F.when(F.col("grp") == g, F.struct("sample", F.col("value").cast("double").alias("value"))))), lambda r: r["value"]
    )
    pairs = long.groupBy("metabolite").agg(values(1).alias("a"), values(2).alias("b")).where("size(a) > 0 AND size(b) > 0")  # a row a sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                deltas = _drawn_deltas(batch["a"][r].values, batch["b"][r].values, replicates, seed)
                yield pa.RecordBatch.from_pydict({"metabolite": batch["metabolite"].slice(r, 1), "d": pa.array([deltas], pa.list_(pa.float64()))})

    tasks = 4 * long.sparkSession.sparkContext.defaultParallelism
    deltas = pairs.repartition(tasks, "metabolite").mapInArrow(run, "metabolite string, d array<double>").select("metabolite", F.explode("d").alias("d"))
    ends = deltas.groupBy("metabolite").agg(F.percentile("d", [alpha / 2, 1 - alpha / 2]).alias("q"))
    return ends.select("metabolite", F.col("q")[0].alias("delta_ci_low"), F.col("q")[1].alias("delta_ci_high"))


def log2_ratio(a: Column, b: Column) -> Column:
    return F.log2((a + PSEUDO_COUNT) / (b + PSEUDO_COUNT))


def differential_abundance(
    samples: Samples, group_key: str, group1, group2, min_samples: int = 3, bootstrap: int = 0, alpha: float = 0.05, random_state: int = 0
) -> DataFrame:
    """Two groups of samples, feature by feature; positive effects: larger in ``group1``."""
    long = _two_groups(samples, group_key, group1, group2, min_samples)
    middles = long.groupBy("metabolite").agg(
        F.median(F.when(F.col("grp") == 1, F.col("value"))).alias("median_group1"), F.median(F.when(F.col("grp") == 2, F.col("value"))).alias("median_group2")
    )
    both = (F.col("median_group1") >= 0) & (F.col("median_group2") >= 0)
    tested = with_bh(with_rank_p(rank_table(long)))
    out = tested.join(middles, "metabolite").select(
        "metabolite",
        "delta",
        magnitude(F.col("delta")).alias("magnitude"),
        "median_group1",
        "median_group2",
        F.when(both, log2_ratio(F.col("median_group1"), F.col("median_group2"))).alias("log2fc"),
        "pval",
        "pval_adj",
        F.col("n1").alias("n_group1"),
        F.col("n2").alias("n_group2"),
        "u1",
        "z",
    )
    if bootstrap:
        ends = bootstrap_delta(long, bootstrap, alpha, random_state)
        out = out.join(ends, "metabolite").withColumn("ci_excludes_zero", (F.col("delta_ci_low") > 0) | (F.col("delta_ci_high") < 0))
    return out.orderBy(F.desc(F.abs("delta")), "metabolite")


def paired_differential_abundance(samples: Samples, pair_key: str, time_key: str, time1, time2, min_pairs: int = 3) -> DataFrame:
    """Change of matched subjects from ``time1`` to ``time2``; of several samples of a subject
    at a time the last by name counts."""
    for c in (pair_key, time_key):
        require_column(samples.samples.columns, c)
    at = lambda t: (
        samples.samples.where(F.col(time_key).cast("string") == str(t)).groupBy(F.col(pair_key).cast("string").alias("subject")).agg(F.max("sample").alias("sample"))
    )
    first, second = at(time1), at(time2)
    matched, alone1, alone2 = first.join(second, "subject", "left_semi"), first.join(second, "subject", "left_anti"), second.join(first, "subject", "left_anti")
    n = matched.count()
    if n < min_pairs:
        raise InsufficientSamplesError(f"{n} subjects have both times, fewer than {min_pairs}.")
    if (left := alone1.count() + alone2.count()) > 0:
        warnings.warn(f"{left} subjects have one time only.", stacklevel=2)
    value = lambda t, name: samples.values.join(t, "sample").select("subject", "metabolite", F.col("value").alias(name))
    change = value(first, "before").join(value(second, "after"), ["subject", "metabolite"]).withColumn("d", F.col("after") - F.col("before"))
    kept = change.where("d <> 0").withColumn("a", F.abs("d"))
    t = F.count(F.lit(1)).over(Window.partitionBy("metabolite", "a"))
    ranked = kept.select("metabolite", "d", mid_rank("a", "metabolite").alias("rank"), t.alias("t"))
    w = ranked.groupBy("metabolite").agg(
        F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("rank"))), F.lit(0.0)).alias("w_plus"),
        F.count(F.lit(1)).alias("n_moved"),
        F.sum(F.col("t").cast("double") * F.col("t") - 1).alias("ties"),
    )
    summary = change.groupBy("metabolite").agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.count_if(F.col("d") > 0).alias("n_up"),
        F.count_if(F.col("d") < 0).alias("n_down"),
        F.median("d").alias("median_change"),
    )
    both = summary.join(w, "metabolite", "left")
    p = special.signed_rank_udf("w_plus", "n_moved", "ties", F.col("n_moved") < F.col("n_pairs"))
    delta = (F.col("n_up") - F.col("n_down")) / F.col("n_pairs")
    tested = with_bh(both.withColumn("pval", F.when(F.col("n_moved") > 0, p).otherwise(1.0)).withColumn("delta", delta))
    return tested.select(
        "metabolite", "delta", magnitude(F.col("delta")).alias("magnitude"), "median_change", "n_pairs", "n_up", "n_down", "w_plus", "pval", "pval_adj"
    ).orderBy(F.desc(F.abs("delta")), "metabolite")


def _warn_pixels(acknowledged: bool) -> None:
    if not acknowledged:
        warnings.warn("Pixels are not independent samples; test samples for claims about groups.", PseudoreplicationWarning, stacklevel=3)


def _pixel_groups(cohort: Cohort, groupby: str) -> DataFrame:
    require_column(cohort.pixels.columns, groupby)
    return cohort.long(F.col(groupby).cast("string").alias("g"), layer=cohort.analysis_layer())


def compare_groups(cohort: Cohort, groupby: str, group1, group2, method: str = "mannwhitney", acknowledge_pixel_level: bool = False) -> DataFrame:
    """Pixels of two groups; fold change and Cohen's d are of ``group2`` against ``group1``."""
    if method not in ("mannwhitney", "ttest"):
        raise InvalidParameterError(f"method must be mannwhitney or ttest, got {method!r}.")
    _warn_pixels(acknowledge_pixel_level)
    grp = F.when(F.col("g") == str(group1), 1).when(F.col("g") == str(group2), 2)
    long = _pixel_groups(cohort, groupby).withColumn("grp", grp).where("grp IS NOT NULL").select("feature_idx", "grp", "value")
    of = lambda f, g: f(F.when(F.col("grp") == g, F.col("value")))
    stats = long.groupBy("feature_idx").agg(*[
        of(f, g).alias(f"{n}{g}") for g in (1, 2) for n, f in (("m", F.avg), ("v", F.var_pop), ("s", F.var_samp), ("n", F.count))
    ])
    n1, n2 = F.col("n1"), F.col("n2")
    pooled = F.sqrt(((n1 - 1) * F.col("v1") + (n2 - 1) * F.col("v2")) / (n1 + n2 - 2))
    stats = stats.withColumn("log2fc", log2_ratio(F.col("m2"), F.col("m1"))).withColumn(
        "cohens_d", F.when(pooled > 0, (F.col("m2") - F.col("m1")) / pooled).otherwise(0.0)
    )
    if method == "mannwhitney":
        tested = with_rank_p(rank_table(long, "feature_idx", spread=True)).select("feature_idx", "pval", F.col("u1").alias("statistic"))
    else:
        a, b = F.col("s1") / n1, F.col("s2") / n2
        t = (F.col("m1") - F.col("m2")) / F.sqrt(a + b)
        df = (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n2 - 1))
        known = stats.where((a + b) > 0).select("feature_idx", t.alias("statistic"), df.alias("df"))
        tested = stats.select("feature_idx").join(known, "feature_idx", "left").select(
            "feature_idx", F.coalesce(special.t_two_sided_udf("statistic", "df"), F.lit(1.0)).alias("pval"), "statistic"
        )
    out = cohort.named(with_bh(stats.join(tested, "feature_idx")))
    return out.select("metabolite", F.col("m1").alias("mean_group1"), F.col("m2").alias("mean_group2"), "log2fc", "cohens_d", "statistic", "pval", "pval_adj").orderBy(
        "pval_adj", "metabolite"
    )


def multi_group_test(cohort: Cohort, groupby: str, method: str = "kruskal", acknowledge_pixel_level: bool = False) -> DataFrame:
    """Kruskal-Wallis or one-way ANOVA over all groups, with eta squared."""
    if method not in ("kruskal", "anova"):
        raise InvalidParameterError(f"method must be kruskal or anova, got {method!r}.")
    _warn_pixels(acknowledge_pixel_level)
    long = _pixel_groups(cohort, groupby).where("g IS NOT NULL")
    per = long.groupBy("feature_idx", "g").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    whole = per.groupBy("feature_idx").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), (F.sum("s") / F.sum("n")).alias("mean"))
    squares = (
        per.join(whole.select("feature_idx", "mean"), "feature_idx")
        .groupBy("feature_idx")
        .agg(F.sum(F.col("n") * (F.col("m") - F.col("mean")) * (F.col("m") - F.col("mean"))).alias("ssb"), F.sum(F.col("n") * F.col("v")).alias("ssw"))
    )
    table = whole.join(squares, "feature_idx").withColumn("eta_squared", F.col("ssb") / (F.col("ssb") + F.col("ssw") + 1e-12))
    n, k = F.col("n"), F.col("k")
    if method == "kruskal":
        counted = long.groupBy("feature_idx", "value", "g").agg(F.count(F.lit(1)).alias("c"))
        ties = counted.groupBy("feature_idx", "value").agg(F.sum("c").alias("t"))
        ranks = counted_rank(ties, "feature_idx", "value", "t", spread=True)
        sums = counted.join(ranks.select("feature_idx", "value", "rank"), ["feature_idx", "value"]).groupBy("feature_idx", "g").agg(
            F.sum(F.col("rank") * F.col("c")).alias("r"), F.sum("c").alias("n")
        )
        h = sums.groupBy("feature_idx").agg(F.sum(F.col("r") * F.col("r") / F.col("n")).alias("q"))
        correction = ranks.groupBy("feature_idx").agg(F.sum(F.col("t").cast("double") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
        table = table.join(h, "feature_idx").join(correction, "feature_idx")
        free = 1 - F.col("ties") / (n * n * n - n)
        table = table.withColumn("statistic", F.when(free > 0, (12.0 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / free))
        p = special.chi2_sf_udf("statistic", k - 1)
    else:
        table = table.withColumn("statistic", F.when(F.col("ssw") > 0, (F.col("ssb") / (k - 1)) / (F.col("ssw") / (n - k))))
        p = special.f_sf_udf("statistic", k - 1, n - k)
    tested = with_bh(table.withColumn("pval", F.coalesce(p, F.lit(1.0))))
    return cohort.named(tested).select("metabolite", "statistic", "pval", "pval_adj", "eta_squared").orderBy("pval_adj", "metabolite")


def find_markers(cohort: Cohort, cluster_key: str = "cluster", method: str = "wilcoxon", n_top: int | None = 20) -> DataFrame:
    """``cluster, metabolite, score, log2fc, pval, pval_adj, rank``: each cluster against the
    rest. Rank sums of all clusters come from one ranking of all pixels."""
    if method not in ("wilcoxon", "t-test", "logreg"):
        raise InvalidParameterError(f"method must be wilcoxon, t-test or logreg, got {method!r}.")
    long = _pixel_groups(cohort, cluster_key)
    per = long.groupBy("feature_idx", "g").agg(F.count(F.lit(1)).alias("n1"), F.sum("value").alias("s1"), F.sum(F.col("value") * F.col("value")).alias("q1"))
    all_ = Window.partitionBy("feature_idx")
    table = per.withColumn("n2", F.sum("n1").over(all_) - F.col("n1")).withColumn("s2", F.sum("s1").over(all_) - F.col("s1")).withColumn("q2", F.sum("q1").over(all_) - F.col("q1")).where("n2 > 0")
    n1, n2 = F.col("n1"), F.col("n2")
    m1, m2 = F.col("s1") / n1, F.col("s2") / n2
    table = table.withColumn("log2fc", F.log2((F.abs(m1) + PSEUDO_COUNT) / (F.abs(m2) + PSEUDO_COUNT)))
    if method == "wilcoxon":
        counted = long.groupBy("feature_idx", "value", "g").agg(F.count(F.lit(1)).alias("c"))
        ties = counted.groupBy("feature_idx", "value").agg(F.sum("c").alias("t"))
        ranks = counted_rank(ties, "feature_idx", "value", "t", spread=True)
        sums = counted.join(ranks.select("feature_idx", "value", "rank"), ["feature_idx", "value"]).groupBy("feature_idx", "g").agg(F.sum(F.col("rank") * F.col("c")).alias("r"))
        table = table.join(sums, ["feature_idx", "g"])
        n = n1 + n2
        table = table.withColumn("score", (F.col("r") - n1 * (n + 1) / 2.0) / F.sqrt(n1 * n2 * (n + 1) / 12.0))
        table = table.withColumn("pval", special.normal_two_sided_udf("score"))
    else:
        v1 = F.greatest(F.lit(0.0), (F.col("q1") - F.col("s1") * F.col("s1") / n1) / (n1 - 1))
        v2 = F.greatest(F.lit(0.0), (F.col("q2") - F.col("s2") * F.col("s2") / n2) / (n2 - 1))
        a, b = v1 / n1, v2 / n2
        table = table.withColumn("score", F.when((a + b) > 0, (m1 - m2) / F.sqrt(a + b)).otherwise(0.0))
        df = F.when((a + b) > 0, (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n2 - 1)))
        table = table.withColumn("pval", F.coalesce(special.t_two_sided_udf("score", df), F.lit(1.0)))
        if method == "logreg":
            table = table.drop("score").join(_logistic_scores(cohort, cluster_key), ["feature_idx", "g"])
    tested = cohort.named(with_bh(table, "pval", "pval_adj", "g"))
    order = Window.partitionBy("g").orderBy(F.desc("score"), "metabolite")
    out = tested.withColumn("rank", F.row_number().over(order))
    out = out if n_top is None else out.where(F.col("rank") <= n_top)
    return out.select(F.col("g").alias("cluster"), "metabolite", "score", "log2fc", "pval", "pval_adj", "rank").orderBy("cluster", "rank")


def _logistic_scores(cohort: Cohort, cluster_key: str) -> DataFrame:
    """``feature_idx, g, score``: coefficients of one multinomial regression."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import array_to_vector

    rows = cohort.pixels.select(F.col(cluster_key).cast("string").alias("g"), array_to_vector(F.col(cohort.analysis_layer())).alias("features"))
    indexer = StringIndexer(inputCol="g", outputCol="label", stringOrderType="alphabetAsc").fit(rows)
    model = LogisticRegression(family="multinomial", regParam=0.01).fit(indexer.transform(rows))
    weights = model.coefficientMatrix.toArray()
    table = [(j, g, float(weights[i, j])) for i, g in enumerate(indexer.labels) for j in range(len(cohort.names))]
    return cohort.pixels.sparkSession.createDataFrame(table, "feature_idx int, g string, score double")


def compare_abundance_and_organization(abundance: DataFrame, organization: DataFrame, delta_threshold: float = 0.474, fdr_threshold: float | None = None) -> DataFrame:
    """Which features move in amount, in arrangement, in both, or in neither."""
    if not 0 <= delta_threshold <= 1:
        raise InvalidParameterError(f"delta_threshold must be between 0 and 1, got {delta_threshold}.")
    if fdr_threshold is not None and not 0 < fdr_threshold <= 1:
        raise InvalidParameterError(f"fdr_threshold must be in (0, 1], got {fdr_threshold}.")
    for table in (abundance, organization):
        for c in ("metabolite", "delta", "pval_adj"):
            require_column(table.columns, c)
    side = lambda t, n: t.select("metabolite", F.col("delta").alias(f"delta_{n}"), F.col("pval_adj").alias(f"pval_adj_{n}"))
    both = side(abundance, "abundance").join(side(organization, "organization"), "metabolite")

    def moved(n: str) -> Column:
        far = F.abs(f"delta_{n}") >= delta_threshold
        return far if fdr_threshold is None else far & (F.col(f"pval_adj_{n}") < fdr_threshold)

    label = (
        F.when(moved("abundance") & moved("organization"), "both")
        .when(moved("organization"), "organization only")
        .when(moved("abundance"), "abundance only")
        .otherwise("neither")
    )
    rank = F.when(label == "organization only", 0).when(label == "both", 1).when(label == "abundance only", 2).otherwise(3)
    return both.withColumn("classification", label).orderBy(rank, F.desc(F.abs("delta_organization")), "metabolite")


def differential_spatial_organization(organization: Samples, group_key: str, group1, group2, metric: str = "morans_i", min_samples: int = 3) -> DataFrame:
    """The abundance test on a metric of arrangement."""
    return differential_abundance(organization.metric(metric), group_key, group1, group2, min_samples).withColumnRenamed("log2fc", "log2fc_metric")


def correlation(a: str, b: str) -> Column:
    """Pearson's correlation; null where a side is constant."""
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def compare_signatures(a: DataFrame, b: DataFrame, effect_col: str = "delta", labels: Sequence[str] = ("a", "b"), min_shared: int = 10, n_boot: int = 0, random_state: int = 0) -> tuple[dict, DataFrame]:
    """Spearman's rho of two effect tables, its p, and the features side by side."""
    for t in (a, b):
        require_column(t.columns, effect_col)
        if not t.groupBy("metabolite").count().where("count > 1").isEmpty():
            raise InvalidParameterError("A metabolite occurs twice in a result table.")
    la, lb = labels
    both = a.select("metabolite", F.col(effect_col).cast("double").alias("ea")).join(b.select("metabolite", F.col(effect_col).cast("double").alias("eb")), "metabolite")
    both = both.where("ea IS NOT NULL AND eb IS NOT NULL")
    ranked = both.select("*", mid_rank("ea").alias("ra"), mid_rank("eb").alias("rb"))
    rho, n, da, db = ranked.agg(correlation("ra", "rb"), F.count(F.lit(1)), F.max("ea") - F.min("ea"), F.max("eb") - F.min("eb")).first()
    if n < min_shared:
        raise InvalidParameterError(f"{n} metabolites are shared, fewer than {min_shared}.")
    if not da or not db:
        raise InvalidParameterError("An effect is the same for all metabolites, so ranks do not correlate.")
    t = abs(rho) * math.sqrt((n - 2) / max(1e-300, (1 - rho) * (1 + rho)))
    summary = {"rho": rho, "pval": special.t_two_sided(t, n - 2) if abs(rho) < 1 else 0.0, "n": n}
    weak = (F.abs("ea") < WEAK) | (F.abs("eb") < WEAK)
    agreement = F.when(weak, "weak").when(F.signum("ea") == F.signum("eb"), "concordant").otherwise("discordant")
    table = both.withColumn("sa", -F.abs("ea")).withColumn("sb", -F.abs("eb")).select(
        "metabolite", F.col("ea").alias(f"{effect_col}_{la}"), F.col("eb").alias(f"{effect_col}_{lb}"),
        mid_rank("sa").alias(f"rank_{la}"), mid_rank("sb").alias(f"rank_{lb}"), agreement.alias("agreement"),
    )
    if n_boot:
        drawn = both.withColumn("i", F.row_number().over(Window.orderBy("metabolite")) - 1)  # a row a feature
        picks = drawn.sparkSession.range(n_boot).select(F.col("id").alias("rep"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("j"))
        picks = picks.select("rep", F.pmod(F.xxhash64(F.lit(random_state), "rep", "j"), F.lit(n)).cast("int").alias("i")).join(F.broadcast(drawn), "i")
        rhos = picks.select("rep", mid_rank("ea", "rep").alias("ra"), mid_rank("eb", "rep").alias("rb")).groupBy("rep").agg(correlation("ra", "rb").alias("r"))
        low, high = rhos.where("r IS NOT NULL").agg(F.percentile("r", [0.025, 0.975])).first()[0]
        summary |= {"rho_ci_low": low, "rho_ci_high": high}
    return summary, table.orderBy("metabolite")


#: Effects and correlations below this are weak.
WEAK = 0.3


def cross_cohort_profile(a: DataFrame, b: DataFrame, labels: Sequence[str] = ("cohort_a", "cohort_b"), **options) -> tuple[dict, DataFrame]:
    """Do two cohorts share a signature?"""
    summary, table = compare_signatures(a, b, labels=labels, **options)
    rho = summary["rho"]
    summary["reading"] = "unrelated" if abs(rho) < WEAK else "shared" if rho > 0 else "inverted"
    return summary, table


def track_flow(a: DataFrame, b: DataFrame, labels: Sequence[str] = ("baseline", "on_treatment"), **options) -> tuple[dict, DataFrame]:
    """Does a signature persist over treatment, reorganise or flip?"""
    summary, table = compare_signatures(a, b, labels=labels, **options)
    rho = summary["rho"]
    summary["verdict"] = "REORGANISES" if abs(rho) < WEAK else "PERSISTS" if rho > 0 else "FLIPS"
    return summary, table
