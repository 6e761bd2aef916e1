"""Normalisation, transforms and per-pixel scores."""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from histomill.errors import InvalidParameterError, listing
from histomill.functions import vectors
from histomill.model import VALUES, Cohort


def _scaled_to(cohort: Cohort, level, target: float | None, step: str) -> Cohort:
    """Divide each pixel by its level and multiply by the target, the median level unless given.
    The median is one exact, distributed percentile that is joined as a single row."""
    pixels = cohort.pixels.withColumn("_level", level)
    if target is None:
        goal = pixels.agg(F.percentile("_level", 0.5).alias("_target"))
        pixels = pixels.crossJoin(F.broadcast(goal))  # one row
    else:
        pixels = pixels.withColumn("_target", F.lit(float(target)))
    factor = F.col("_target") / F.col("_level")
    pixels = pixels.withColumn("_factor", factor).withColumn(VALUES, F.transform(VALUES, lambda v: v * F.col("_factor")))
    return cohort.with_pixels(pixels.drop("_level", "_target", "_factor"), step, target=target)


def tic_normalize(cohort: Cohort, target_sum: float | None = None) -> Cohort:
    """Every pixel to the same total; a total of 0 counts as 1."""
    sums = vectors.total(F.col(VALUES))
    return _scaled_to(cohort, F.when(sums == 0, F.lit(1.0)).otherwise(sums), target_sum, "tic_normalize")


def median_normalize(cohort: Cohort, target_value: float | None = None) -> Cohort:
    """Every pixel to the same median of its positive values; none counts as 1."""
    middle = vectors.median(F.filter(VALUES, lambda v: v > 0))
    return _scaled_to(cohort, F.coalesce(F.when(middle != 0, middle), F.lit(1.0)), target_value, "median_normalize")


def log1p_transform(cohort: Cohort) -> Cohort:
    return cohort.with_pixels(cohort.pixels.withColumn(VALUES, F.transform(VALUES, F.log1p)), "log1p_transform")


def moments(cohort: Cohort, layer: str = VALUES) -> DataFrame:
    """One row: arrays of every feature's mean and sample standard deviation."""
    per = cohort.long(layer=layer).groupBy("feature_idx").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    ordered = F.array_sort(F.collect_list(F.struct("feature_idx", "m", "s")))  # a panel's size
    return per.agg(ordered.alias("f")).select(
        F.transform("f", lambda f: f["m"]).alias("means"), F.transform("f", lambda f: F.coalesce(F.when(f["s"] > 0, f["s"]), F.lit(1.0))).alias("sds")
    )


def scale(cohort: Cohort, max_value: float | None = 10) -> Cohort:
    """Z-scores, clipped on both sides; what was there stays as the ``log1p`` layer."""
    pixels = cohort.pixels.crossJoin(F.broadcast(moments(cohort)))  # one row
    centred = F.zip_with(F.zip_with(VALUES, "means", lambda v, m: v - m), "sds", lambda v, s: v / s)
    if max_value is not None:
        top = float(max_value)
        centred = F.transform(centred, lambda v: F.greatest(F.lit(-top), F.least(F.lit(top), v)))
    pixels = pixels.withColumn("_z", centred).withColumn(f"{VALUES}_log1p", F.col(VALUES)).withColumn(VALUES, F.col("_z"))
    return cohort.with_pixels(pixels.drop("_z", "means", "sds"), "scale", max_value=max_value)


def preprocess(cohort: Cohort, normalize: str | None = "tic", log1p: bool = True, scaled: bool = False, n_comps: int = 50, n_neighbors: int | None = None):
    """Normalise, log, scale, PCA and, if asked for, the neighbour graph: ``(cohort, edges)``."""
    from histomill.operators import reduce

    steps = {"tic": tic_normalize, "median": median_normalize, None: lambda c: c, "none": lambda c: c}
    if normalize not in steps:
        raise InvalidParameterError(f"normalize must be one of {listing(steps)}, got {normalize!r}.")
    cohort = steps[normalize](cohort)
    cohort = log1p_transform(cohort) if log1p else cohort
    cohort = scale(cohort) if scaled else cohort
    cohort = reduce.run_pca(cohort, n_comps)
    return cohort, reduce.run_neighbors(cohort, n_neighbors) if n_neighbors else None


def diversity_index(cohort: Cohort, method: str = "shannon") -> Cohort:
    """Diversity of every pixel's clipped values, as a column of that name."""
    if method not in ("shannon", "simpson"):
        raise InvalidParameterError(f"method must be shannon or simpson, got {method!r}.")
    score = (vectors.entropy if method == "shannon" else vectors.simpson)(F.col(cohort.analysis_layer()))
    return cohort.with_pixels(cohort.pixels.withColumn(f"diversity_{method}", score), "diversity_index", method=method)


def score_metabolite_set(cohort: Cohort, metabolites: Sequence[str], name: str = "set_score") -> Cohort:
    """Mean of the set's features that the panel has."""
    at = [cohort.names.index(m) for m in dict.fromkeys(metabolites) if m in cohort.names]
    if not at:
        raise InvalidParameterError(f"None of the set's {len(metabolites)} metabolites is in the panel.")
    if missing := [m for m in metabolites if m not in cohort.names]:
        warnings.warn(f"Not in the panel: {listing(missing)}.", stacklevel=2)
    layer = cohort.analysis_layer()
    mean = sum((F.get(layer, F.lit(i)) for i in at[1:]), F.get(layer, F.lit(at[0]))) / len(at)
    return cohort.with_pixels(cohort.pixels.withColumn(name, mean), "score_metabolite_set", name=name)


def nnls(dictionary: np.ndarray, targets: np.ndarray, iterations: int = 300) -> np.ndarray:
    """Non-negative least squares of every row of ``targets`` on the rows of ``dictionary``:
    projected, accelerated gradient on all rows at once, then an active-set polish."""
    gram, cross = dictionary @ dictionary.T, targets @ dictionary.T
    rate = 1 / max(np.linalg.eigvalsh(gram)[-1], 1e-300)
    w = np.zeros_like(cross)
    ahead, t = w, 1.0
    for _ in range(iterations):
        after = np.maximum(0, ahead - rate * (ahead @ gram - cross))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = after + (t - 1) / t2 * (after - w), after, t2
    active = w > 1e-9 * np.maximum(w.max(axis=1, keepdims=True), 1e-300)
    for pattern in np.unique(active, axis=0):
        if pattern.any():
            rows = np.flatnonzero((active == pattern).all(axis=1))
            solved = np.linalg.lstsq(gram[np.ix_(pattern, pattern)], cross[np.ix_(rows, np.flatnonzero(pattern))].T, rcond=None)[0].T
            fine = (solved >= 0).all(axis=1)
            w[np.ix_(rows[fine], np.flatnonzero(pattern))] = solved[fine]
    return w


def unmix_pixels(cohort: Cohort, references: Mapping[str, Mapping[str, float]]) -> Cohort:
    """Shares of reference spectra in every pixel, over the features that all of them have."""
    shared = [n for n in cohort.names if all(n in spectrum for spectrum in references.values())]
    if not references or not shared:
        raise InvalidParameterError("The panel and the reference spectra have no feature in common.")
    dictionary = np.array([[max(0.0, spectrum[n]) for n in shared] for spectrum in references.values()], float)
    layer, at = cohort.analysis_layer(), [cohort.names.index(n) for n in shared]

    @F.pandas_udf(ArrayType(DoubleType()))
    def unmix(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            if not len(s):
                yield pd.Series([], dtype=object)
                continue
            w = nnls(dictionary, np.maximum(0, np.stack(s.to_numpy())))
            whole = w.sum(axis=1, keepdims=True)
            yield pd.Series(list(w / np.where(whole == 0, 1, whole)))

    pixels = cohort.pixels.withColumn("unmixed", unmix(F.array(*[F.get(layer, F.lit(i)) for i in at])))
    return cohort.with_pixels(pixels, "unmix_pixels", references=list(references))
