"""Feature and pixel filters, label maps, regions and set operations on cohorts."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histomill.errors import InvalidParameterError, MissingRegionError, listing, require_column
from histomill.model import Cohort

# Compounds that are sold as drugs and made by any tissue.
ALSO_ENDOGENOUS = (
    "alanine arginine asparagine aspartate betaine biotin carnitine choline cholesterol citrulline creatine cysteine folate fructose "
    "galactose glucose glutamate glutamine glycine histidine inositol isoleucine lactate leucine lysine malate mannitol methionine niacin "
    "ornithine phenylalanine proline pyruvate riboflavin serine sorbitol spermidine spermine taurine threonine thiamine tryptophan tyrosine "
    "urea valine"
).split()


def background_ratios(cohort: Cohort, mode: str = "sample", epsilon: float = 1e-9) -> DataFrame:
    """``section, feature_idx, tissue, background, ratio``: masked means, an empty mask's being 0."""
    for region in ("is_tissue", "is_background"):
        require_column(cohort.pixels.columns, region, MissingRegionError)
    mean = lambda flag: F.coalesce(F.avg(F.when(F.col(flag), F.col("value"))), F.lit(0.0))
    key = F.col("section") if mode == "sample" else F.lit("all")
    long = cohort.long(key.alias("section"), "is_tissue", "is_background")
    return (
        long.groupBy("section", "feature_idx")
        .agg(mean("is_tissue").alias("tissue"), mean("is_background").alias("background"))
        .withColumn("ratio", F.col("tissue") / (F.col("background") + epsilon))
    )


def filter_background(cohort: Cohort, cutoff: float = 1.5, mode: str = "group") -> tuple[dict[str, Cohort], DataFrame]:
    """Tissue pixels with the features whose tissue mean is ``cutoff`` times their background
    mean, per section or over all of them, and the ratios. In ``group`` mode the one cohort is
    under ``all``."""
    if mode not in ("sample", "group"):
        raise InvalidParameterError(f"mode must be sample or group, got {mode!r}.")
    ratios = background_ratios(cohort, mode)
    kept = ratios.where(F.col("ratio") >= cutoff).groupBy("section").agg(F.array_sort(F.collect_set("feature_idx")).alias("at")).collect()
    tissue = cohort.with_pixels(cohort.pixels.where("is_tissue"), "filter_background", cutoff=cutoff, mode=mode)
    out = {}
    for row in kept:  # one row a section
        own = tissue if mode == "group" else tissue.with_pixels(tissue.pixels.where(F.col("section") == row.section))
        out[row.section] = own.select_features(row["at"])
    return out, ratios


def filter_by_score(cohort: Cohort, min_score: float = 0.3, score: str = "score") -> Cohort:
    """Features whose annotation score reaches ``min_score``; unknown scores do not."""
    if not 0 <= min_score <= 2:
        raise InvalidParameterError(f"min_score must be between 0 and 2, got {min_score}.")
    require_column(cohort.about, score)
    keep = [i for i, v in enumerate(cohort.about[score]) if v is not None and v == v and v >= min_score]
    return cohort.select_features(keep).record("filter_by_score", {"min_score": min_score})


def normal_name(name: Column) -> Column:
    return F.lower(F.trim(name))


def drug_matches(features: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``metabolite, endogenous`` of the features that the vocabulary (column ``name``) holds."""
    names = vocabulary.select(normal_name(F.col("name")).alias("name")).where("name IS NOT NULL").distinct()
    matched = features.join(names, normal_name(F.col("metabolite")) == F.col("name"), "left_semi")
    return matched.select("metabolite", normal_name(F.col("metabolite")).isin(ALSO_ENDOGENOUS).alias("endogenous")).orderBy("metabolite")


def without_drugs(features: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The features that the vocabulary does not hold."""
    names = vocabulary.select(normal_name(F.col("name")).alias("name")).where("name IS NOT NULL").distinct()
    return features.join(names, normal_name(F.col("metabolite")) == F.col("name"), "left_anti")


def filter_drugs(cohort: Cohort, vocabulary: DataFrame | None = None, remove_all: bool = False, drug_names: Sequence[str] = ()) -> Cohort:
    """Without the features named, or with ``remove_all`` those in the vocabulary."""
    wanted = {n.strip().lower() for n in drug_names}
    held = {n.strip().lower() for n in cohort.names}
    if unknown := sorted(wanted - held):
        warnings.warn(f"Not in the panel: {listing(unknown)}.", stacklevel=2)
    gone = wanted & held
    if remove_all:
        if vocabulary is None:
            raise InvalidParameterError("remove_all needs a vocabulary of drug names.")
        gone |= {r.metabolite.strip().lower() for r in drug_matches(cohort.features(), vocabulary).collect()}
    if own := sorted(gone & set(ALSO_ENDOGENOUS)):
        warnings.warn(f"Removed although tissue makes them too: {listing(own)}.", stacklevel=2)
    return cohort.select_features([i for i, n in enumerate(cohort.names) if n.strip().lower() not in gone]).record("filter_drugs", {"removed": len(gone)})


def subset_obs(cohort: Cohort, column: str, values: Iterable) -> Cohort:
    require_column(cohort.pixels.columns, column)
    values = [values] if isinstance(values, str) or not isinstance(values, Iterable) else list(values)
    chosen = cohort.pixels.where(F.col(column).isin(values))
    if chosen.isEmpty():
        raise InvalidParameterError(f"No pixel has {column} in {listing(values)}.")
    return cohort.with_pixels(chosen, "subset_obs", column=column, values=values)


def split_by_obs(cohort: Cohort, column: str) -> dict[object, Cohort]:
    """A lazy cohort for each value, in order."""
    require_column(cohort.pixels.columns, column)
    values = sorted(r[0] for r in cohort.pixels.select(column).distinct().collect() if r[0] is not None)
    return {v: cohort.with_pixels(cohort.pixels.where(F.col(column) == v), "split_by_obs", column=column, value=v) for v in values}


def rename_clusters(cohort: Cohort, names: Mapping, cluster_key: str = "cluster") -> Cohort:
    """New labels; labels without one stay, and the old ones are kept beside."""
    require_column(cohort.pixels.columns, cluster_key)
    old = F.col(cluster_key).cast("string")
    table = F.create_map(*[F.lit(str(x)) for pair in names.items() for x in pair])
    pixels = cohort.pixels.withColumn(f"{cluster_key}_original", F.col(cluster_key)).withColumn(cluster_key, F.coalesce(F.try_element_at(table, old), old))
    return cohort.with_pixels(pixels, "rename_clusters", key=cluster_key)


def inside(x: Column, y: Column, polygon: Sequence[tuple[float, float]]) -> Column:
    """Point in polygon by ray casting, as one expression."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(polygon, [*polygon[1:], polygon[0]], strict=True):
        if y1 == y2:
            continue
        spans = (F.lit(y1) > y) != (F.lit(y2) > y)
        crossings = crossings + F.when(spans & (x < F.lit(float(x2 - x1)) * (y - y1) / float(y2 - y1) + x1), 1).otherwise(0)
    return crossings % 2 == 1


def label_rois(cohort: Cohort, tissue: Sequence[Sequence[tuple[float, float]]], background: Sequence[Sequence[tuple[float, float]]]) -> Cohort:
    """``is_tissue`` and ``is_background`` from polygons."""
    flag = lambda polygons: F.array_contains(F.array(F.lit(False), *[inside(F.col("x"), F.col("y"), p) for p in polygons]), True)
    return cohort.with_pixels(cohort.pixels.withColumns({"is_tissue": flag(tissue), "is_background": flag(background)}), "label_rois")


def check_rois(cohorts: Sequence[Cohort]) -> None:
    lacking = [i for i, c in enumerate(cohorts) if not {"is_tissue", "is_background"} <= set(c.pixels.columns)]
    if lacking:
        raise MissingRegionError(f"Without regions: {listing(lacking)}.")


def merge_samples(cohorts: Sequence[Cohort], labels: Sequence[str], sample_col: str = "sample", join: str = "outer") -> Cohort:
    """One cohort: shared features (``inner``) or all of them, absent ones being 0 (``outer``).
    Of the columns about pixels those stay that all have."""
    if len(cohorts) != len(labels) or not cohorts:
        raise InvalidParameterError(f"{len(cohorts)} cohorts and {len(labels)} labels.")
    if join not in ("inner", "outer"):
        raise InvalidParameterError(f"join must be inner or outer, got {join!r}.")
    names = list(dict.fromkeys(n for c in cohorts for n in c.names))
    if join == "inner":
        names = [n for n in names if all(n in c.names for c in cohorts)]
    if not names:
        raise InvalidParameterError("The cohorts have no feature in common.")
    shared = [o for o in cohorts[0].observations() if all(o in c.observations() for c in cohorts) and o != sample_col]
    parts, seen = [], {}
    for cohort, label in zip(cohorts, labels, strict=True):
        seen[label] = seen.get(label, 0) + 1
        unique = label if seen[label] == 1 else f"{label}-{seen[label] - 1}"
        at = {n: i for i, n in enumerate(cohort.names)}
        values = F.array(*[F.get("values", F.lit(at[n])) if n in at else F.lit(0.0) for n in names])
        parts.append(cohort.pixels.select(
            F.lit(unique).alias("section"), F.concat(F.lit(f"{unique}_"), F.col("pixel_id").cast("string")).alias("pixel_id"), "x", "y", *shared,
            F.lit(label).alias(sample_col), values.alias("values"),
        ))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return Cohort(merged, tuple(names)).record("merge_samples", {"n": len(cohorts), "join": join})
