"""Embeddings, factorisations and batch correction. Pixels are reduced to sums of a panel's size
where they lie; the small algebra on these runs on the driver."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from histomill.errors import InvalidParameterError, NoEmbeddingError, listing, require_column
from histomill.functions import vectors
from histomill.model import VALUES, Cohort
from histomill.operators import neighbours, spatial
from histomill.operators.transform import nnls
from histomill.storage import stored

#: Rows of a block of the all-against-all neighbour search.
BLOCK = 2048


def _summed(rows: DataFrame, shape: tuple[int, ...], add) -> np.ndarray:
    """Sum over all partitions of what ``add(matrix batch)`` gives, tree-added by Spark."""
    size = int(np.prod(shape))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(shape)
        for b in batches:
            if len(b):
                total += add(b)
        yield pd.DataFrame({"s": [total.ravel().tolist()]})

    parts = rows.mapInPandas(run, "s array<double>")
    added = parts.select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size)
    for r in added:
        out[r.i] = r.v
    return out.reshape(shape)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def gram(cohort: Cohort, layer: str) -> tuple[int, np.ndarray, np.ndarray]:
    """``(n, sums, products)`` of the features: panel-sized."""
    p = len(cohort.names)

    def add(b: pd.DataFrame) -> np.ndarray:
        x = np.concatenate([np.ones((len(b), 1)), _matrix(b["v"])], axis=1)
        return x.T @ x

    whole = _summed(cohort.pixels.select(F.col(layer).alias("v")), (p + 1, p + 1), add)
    return int(whole[0, 0]), whole[0, 1:], whole[1:, 1:]


def run_pca(cohort: Cohort, n_comps: int = 50, layer: str = VALUES) -> Cohort:
    """Principal components of the centred values in column ``pca``; each loading's largest
    entry is positive."""
    p = len(cohort.names)
    if p < 2:
        raise InvalidParameterError("Components need at least two features.")
    n, sums, products = gram(cohort, layer)
    n_comps = min(n_comps, min(n, p) - 1)
    if n_comps < 1:
        raise InvalidParameterError(f"{n} pixels and {p} features have no components.")
    mean = sums / n
    values, axes = np.linalg.eigh((products - n * np.outer(mean, mean)) / (n - 1))
    order = np.argsort(values)[::-1][:n_comps]
    axes = axes[:, order]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(n_comps)])
    project = _linear(axes, -mean @ axes)
    made = cohort.with_pixels(cohort.pixels.withColumn("pca", project(layer)), "run_pca", n_comps=n_comps)
    return made


def _linear(weights: np.ndarray, offset: np.ndarray):
    @F.pandas_udf(ArrayType(DoubleType()))
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(list(_matrix(s) @ weights + offset) if len(s) else [], dtype=object)

    return apply


def knn_graph(rows: DataFrame, rep: str, k: int, metric: str = "euclidean", n_dims: int | None = None, block: int = BLOCK) -> DataFrame:
    """``i, j, d, r`` for ``rows(id, <rep>)``: exact nearest neighbours by blocks. Rows are packed
    into blocks; every pair of blocks is one matrix product that keeps ``k`` candidates a row, so
    a task holds two blocks."""
    if metric not in ("euclidean", "cosine"):
        raise InvalidParameterError(f"metric must be euclidean or cosine, got {metric!r}.")
    vector = F.slice(rep, 1, n_dims) if n_dims else F.col(rep)
    n = rows.count()
    blocks = max(1, -(-n // block))
    packed = stored(
        rows.select(F.col("id"), vector.alias("v"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("b"))
        .groupBy("b")
        .agg(F.array_sort(F.collect_list(F.struct("id", "v"))).alias("rows")),  # about ``block`` rows each
        "blocks",
    )
    pairs = packed.select("b", F.col("rows.id").alias("ids"), F.col("rows.v").alias("vs")).crossJoin(
        packed.select(F.col("rows.id").alias("ids2"), F.col("rows.v").alias("vs2"))
    )
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, vs, ids2, vs2 in zip(batch["ids"], batch["vs"], batch["ids2"], batch["vs2"], strict=True):
                a, b = np.stack(vs).astype(float), np.stack(vs2).astype(float)
                ids, ids2 = np.asarray(ids), np.asarray(ids2)
                if metric == "cosine":
                    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
                    d = 1 - unit(a) @ unit(b).T
                else:
                    d = np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T))
                d[ids[:, None] == ids2[None]] = np.inf
                m = min(k, d.shape[1])
                best = np.argsort(d, axis=1, kind="stable")[:, :m]
                out = pd.DataFrame({"i": np.repeat(ids, m), "j": ids2[best.ravel()], "d": np.take_along_axis(d, best, 1).ravel()})
                yield out[np.isfinite(out["d"])]

    near = pairs.repartition(max(1, blocks * blocks)).mapInPandas(run, f"i {kind}, j {kind}, d double")
    order = Window.partitionBy("i").orderBy("d", "j")
    return near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)


def represented(cohort: Cohort, rep: str) -> DataFrame:
    """``id, <rep>``: a pixel's id is its section and id."""
    require_column(cohort.pixels.columns, rep, NoEmbeddingError)
    return cohort.pixels.select(pixel_key().alias("id"), rep)


def pixel_key():
    return F.concat_ws("/", F.coalesce(F.col("section").cast("string"), F.lit("")), F.col("pixel_id").cast("string"))


def run_neighbors(cohort: Cohort, n_neighbors: int = 30, n_pcs: int = 30, metric: str = "cosine", rep: str = "pca") -> DataFrame:
    """Nearest neighbours in the components."""
    return knn_graph(represented(cohort, rep), rep, n_neighbors, metric, n_pcs)


def smoothed(cohort: Cohort, rep: str, alpha: float, n_neighbors: int = 6, section: str = "section") -> Cohort:
    """``rep`` mixed with its neighbours' mean, as column ``<rep>_smooth``."""
    if not 0 <= alpha <= 1:
        raise InvalidParameterError(f"alpha must be between 0 and 1, got {alpha}.")
    require_column(cohort.pixels.columns, rep, NoEmbeddingError)
    lag = spatial.lagged(cohort, neighbours.spatial_edges(cohort, n_neighbors, section), rep, section=section)
    mixed = lag.select(
        F.col("section").alias("_s"), F.col("id").alias("_i"), F.zip_with("values", "lag", lambda v, near: (1 - alpha) * v + alpha * near).alias("_m")
    )
    key = F.coalesce(F.col(section).cast("string"), F.lit(""))
    joined = cohort.pixels.join(mixed, (key == F.col("_s")) & (F.col("pixel_id") == F.col("_i")), "left")
    pixels = joined.withColumn(f"{rep}_smooth", F.coalesce("_m", rep)).drop("_s", "_i", "_m")
    return cohort.with_pixels(pixels, "smoothed", rep=rep, alpha=alpha)


def spatial_domains_kmeans(cohort: Cohort, n_domains: int = 8, alpha: float = 0.5, n_neighbors: int = 6, n_init: int = 10, seed: int = 0) -> Cohort:
    """k-means on smoothed components: the best of ``n_init`` starts, as column ``domain``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    mixed = smoothed(cohort, "pca", alpha, n_neighbors)
    rows = mixed.pixels.withColumn("_f", array_to_vector("pca_smooth")).persist()
    try:
        models = [KMeans(k=n_domains, seed=seed + i, featuresCol="_f", predictionCol="domain").fit(rows) for i in range(n_init)]
    finally:
        rows.unpersist()
    best = min(models, key=lambda m: m.summary.trainingCost)
    labelled = best.transform(mixed.pixels.withColumn("_f", array_to_vector("pca_smooth"))).drop("_f").withColumn("domain", F.col("domain").cast("string"))
    return mixed.with_pixels(labelled, "spatial_domains_kmeans", n_domains=n_domains)


def factorise(rows: DataFrame, p: int, k: int, iterations: int = 60, seed: int = 0, tolerance: float = 1e-5) -> tuple[np.ndarray, list[float]]:
    """Non-negative ``H`` (k x p) and the loss by round, for ``rows(v)``: the weights of a row are
    its least squares on ``H``; a round adds up ``W'W`` and ``W'X`` over all rows."""
    h = np.random.default_rng(seed).random((k, p)) + 0.1
    norm = float(rows.select(vectors.dot(F.col("v"), F.col("v")).alias("d")).agg(F.sum("d")).first()[0] or 0)
    losses: list[float] = []
    for _ in range(iterations):
        def add(b: pd.DataFrame, h=h) -> np.ndarray:
            x = np.maximum(0, _matrix(b["v"]))
            w = nnls(h, x, 100)
            return np.concatenate([w.T @ w, w.T @ x], axis=1)

        s = _summed(rows, (k, k + p), add)
        ww, wx = s[:, :k], s[:, k:]
        losses.append(max(0.0, norm - 2 * float((wx * h).sum()) + float((ww @ h * h).sum())))
        for _ in range(3):
            for i in range(k):
                if ww[i, i] > 1e-12:
                    h[i] = np.maximum(0, h[i] + (wx[i] - ww[i] @ h) / ww[i, i])
        if len(losses) > 1 and losses[-2] - losses[-1] <= tolerance * max(losses[0], 1e-12):
            break
    return h, losses


def cluster_nmf(cohort: Cohort, n_components: int = 10, layer: str | None = None, key: str = "nmf", n_top: int = 20, seed: int = 0) -> tuple[Cohort, DataFrame]:
    """Non-negative factors: weights in column ``nmf``, the strongest one as ``nmf_cluster``, and
    ``component, metabolite, loading, rank`` of each factor's top features."""
    layer = layer or cohort.analysis_layer()
    rows = stored(cohort.pixels.select(vectors.clipped(F.col(layer)).alias("v")), "nmf")
    h, losses = factorise(rows, len(cohort.names), n_components, seed=seed)

    @F.pandas_udf(ArrayType(DoubleType()))
    def weights(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(list(nnls(h, np.maximum(0, _matrix(s)), 300)) if len(s) else [], dtype=object)

    pixels = cohort.pixels.withColumn(key, weights(layer))
    pixels = pixels.withColumn(f"{key}_cluster", (F.array_position(key, F.array_max(key)) - 1).cast("string"))
    top = [(c, cohort.names[j], float(h[c, j]), r + 1) for c in range(n_components) for r, j in enumerate(np.argsort(-h[c], kind="stable")[:n_top])]
    table = cohort.pixels.sparkSession.createDataFrame(top, "component int, metabolite string, loading double, rank int")
    return cohort.with_pixels(pixels, "cluster_nmf", n_components=n_components, loss=losses[-1]), table


def spatially_weighted_nmf(cohort: Cohort, n_components: int = 10, alpha: float = 0.5, n_neighbors: int = 6, seed: int = 0) -> tuple[Cohort, DataFrame]:
    """Factors of values mixed with their neighbours' mean."""
    layer = cohort.analysis_layer()
    return cluster_nmf(smoothed(cohort, layer, alpha, n_neighbors), n_components, f"{layer}_smooth", "snmf", seed=seed)


def batch_mixing_score(cohort: Cohort, batch_key: str, rep: str = "pca", n_neighbors: int = 30) -> tuple[float, DataFrame]:
    """Mean inverse Simpson index of the batches among a pixel's neighbours, and each pixel's."""
    require_column(cohort.pixels.columns, batch_key)
    edges = knn_graph(represented(cohort, rep), rep, n_neighbors)
    batches = cohort.pixels.select(pixel_key().alias("j"), F.col(batch_key).cast("string").alias("batch"))
    counts = edges.join(batches, "j").groupBy("i", "batch").agg(F.count(F.lit(1)).alias("c"))
    scores = counts.groupBy("i").agg((F.sum("c") * F.sum("c") / F.sum(F.col("c") * F.col("c"))).alias("score"))
    return scores.agg(F.avg("score")).first()[0], scores.withColumnRenamed("i", "id")


def cluster_validation(cohort: Cohort, cluster_key: str = "cluster", use_rep: str = "pca", sample_size: int = 10_000, seed: int = 0) -> DataFrame:
    """``silhouette, n_pixels, n_clusters``: Euclidean silhouette of a sample, all pairs by
    blocks. Distances are added up per pixel and cluster before they meet."""
    require_column(cohort.pixels.columns, cluster_key)
    rows = cohort.pixels.select(pixel_key().alias("id"), F.col(use_rep).alias("v"), F.col(cluster_key).cast("string").alias("c"))
    rows = stored(rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample_size), "silhouette")
    blocks = max(1, -(-rows.count() // BLOCK))
    packed = rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("b")).agg(F.collect_list(F.struct("id", "v", "c")).alias("r"))  # about BLOCK rows
    pairs = packed.select(F.col("r.id").alias("ids"), F.col("r.v").alias("vs"), F.col("r.c").alias("cs")).crossJoin(
        packed.select(F.col("r.id").alias("ids2"), F.col("r.v").alias("vs2"), F.col("r.c").alias("cs2"))
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, vs, cs, vs2, cs2 in zip(batch["ids"], batch["vs"], batch["cs"], batch["vs2"], batch["cs2"], strict=True):
                a, b = np.stack(vs).astype(float), np.stack(vs2).astype(float)
                d = np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T))
                cs2 = np.asarray(cs2)
                for c in np.unique(cs2):
                    yield pd.DataFrame({"id": ids, "own": cs, "c": c, "s": d[:, cs2 == c].sum(1), "n": int((cs2 == c).sum())})

    sums = pairs.repartition(blocks * blocks).mapInPandas(run, "id string, own string, c string, s double, n long")
    sums = sums.groupBy("id", "own", "c").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    per = sums.groupBy("id").agg(
        F.max(F.when((F.col("c") == F.col("own")) & (F.col("n") > 1), F.col("s") / (F.col("n") - 1))).alias("a"), F.min(F.when(F.col("c") != F.col("own"), F.col("s") / F.col("n"))).alias("b")
    )
    score = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)))
    clusters = rows.select("c").distinct().count()
    return per.agg(F.avg(F.coalesce(score, F.lit(0.0))).alias("silhouette"), F.count(F.lit(1)).alias("n_pixels")).withColumn("n_clusters", F.lit(clusters))


def _without_nulls(cohort: Cohort, *columns: str) -> None:
    """A pixel of no batch can neither be corrected nor left out silently."""
    missing = cohort.pixels.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    if bad := [c for c in columns if missing[c]]:
        raise InvalidParameterError(f"{listing(bad)} must not be null; {max(missing[c] for c in bad)} pixels have none.")


def correct_batches(cohort: Cohort, batch_key: str, covariates: Sequence[str] = (), n_comps: int | None = None) -> Cohort:
    """ComBat (parametric empirical Bayes). A feature's model needs only its count, sum and sum
    of squares in every combination of batch and covariates; pixels are then shifted and scaled
    where they lie."""
    for c in (batch_key, *covariates):
        require_column(cohort.pixels.columns, c)
    _without_nulls(cohort, batch_key, *covariates)
    layer, p = cohort.analysis_layer(), len(cohort.names)
    keys = [batch_key, *covariates]
    cells = cohort.pixels.groupBy(*[F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(keys)]).agg(F.count(F.lit(1)).alias("n"))
    long = cohort.long(*[F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(keys)], layer=layer)
    names = [f"k{i}" for i in range(len(keys))]
    table = long.groupBy(*names, "feature_idx").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")).toPandas()
    groups = cells.toPandas().sort_values(names, ignore_index=True)  # combinations of labels
    place = {tuple(r[n] for n in names): i for i, r in groups.iterrows()}
    s, q = np.zeros((len(groups), p)), np.zeros((len(groups), p))
    at = [place[k] for k in zip(*(table[n] for n in names), strict=True)]
    s[at, table["feature_idx"]], q[at, table["feature_idx"]] = table["s"], table["q"]
    n = groups["n"].to_numpy(float)
    batches = sorted(groups["k0"].unique())
    if len(batches) < 2:
        raise InvalidParameterError(f"'{batch_key}' has one value only.")
    one_hot = np.array([[b == v for v in batches] for b in groups["k0"]], float)
    per_batch = one_hot.T @ n
    if (per_batch < 2).any():
        raise InvalidParameterError("A batch has a single pixel.")
    design = [one_hot]
    for i in range(1, len(keys)):
        levels = sorted(groups[f"k{i}"].unique())
        if len(levels) > 1:  # constant covariates go
            design.append(np.array([[g == v for v in levels[1:]] for g in groups[f"k{i}"]], float))
    design = np.concatenate(design, axis=1)
    if np.linalg.matrix_rank(design) < design.shape[1]:
        raise InvalidParameterError("Covariates cannot be told from batches.")
    beta = np.linalg.solve(design.T @ (n[:, None] * design), design.T @ s)
    mean = (per_batch / n.sum()) @ beta[: len(batches)]
    fitted = design @ beta
    var = (q - 2 * fitted * s + n[:, None] * fitted**2).sum(0) / n.sum()
    sd = np.sqrt(np.where(var > 0, var, 1))
    base = mean + design[:, len(batches) :] @ beta[len(batches) :]
    z1, z2 = (s - n[:, None] * base) / sd, (q - 2 * base * s + n[:, None] * base**2) / sd**2
    sum1, sum2 = one_hot.T @ z1, one_hot.T @ z2
    nb = per_batch[:, None]
    gamma_hat = sum1 / nb
    delta_hat = np.maximum((sum2 - nb * gamma_hat**2) / (nb - 1), 1e-12)
    gamma, delta = np.empty_like(gamma_hat), np.empty_like(delta_hat)
    for b in range(len(batches)):
        g_bar, t2 = gamma_hat[b].mean(), max(gamma_hat[b].var(ddof=1) if p > 1 else 0.0, 1e-12)
        m, v = delta_hat[b].mean(), max(delta_hat[b].var(ddof=1) if p > 1 else 0.0, 1e-12)
        a_prior, b_prior = (2 * v + m * m) / v, (m * v + m**3) / v
        g, d = gamma_hat[b].copy(), delta_hat[b].copy()
        for _ in range(200):
            g2 = (t2 * nb[b] * gamma_hat[b] + d * g_bar) / (t2 * nb[b] + d)
            d2 = (0.5 * (sum2[b] - 2 * g2 * sum1[b] + nb[b] * g2**2) + b_prior) / (nb[b] / 2 + a_prior - 1)
            change = max(np.max(np.abs(g2 - g) / np.maximum(np.abs(g), 1e-12)), np.max(np.abs(d2 - d) / np.maximum(d, 1e-12)))
            g, d = g2, d2
            if change < 1e-4:
                break
        gamma[b], delta[b] = g, d
    of = np.array([batches.index(k) for k in groups["k0"]])
    scale = 1 / np.sqrt(delta[of])
    shift = base - (base + sd * gamma[of]) * scale
    rows = [(*(r[c] for c in names), scale[i].tolist(), shift[i].tolist()) for i, r in groups.iterrows()]
    spark = cohort.pixels.sparkSession
    models = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in names) + ", _a array<double>, _b array<double>")
    same = [F.col(c).cast("string").eqNullSafe(F.col(f"k{i}")) for i, c in enumerate(keys)]
    pixels = cohort.pixels.join(F.broadcast(models) if len(rows) * p < 4_000_000 else models, same)
    flat = F.array(*[F.lit(bool(v > 0)) for v in var])
    moved = F.zip_with(F.zip_with(layer, "_a", lambda x, a: x * a), "_b", lambda x, b: x + b)
    moved = F.zip_with(F.arrays_zip(F.col(layer).alias("x"), moved.alias("y")), flat, lambda v, f: F.when(f, v["y"]).otherwise(v["x"]))
    made = cohort.with_pixels(pixels.withColumn(layer, moved).drop(*names, "_a", "_b"), "correct_batches", batch_key=batch_key)
    return run_pca(made, n_comps, layer) if n_comps else made


def run_harmony(cohort: Cohort, batch_key: str, rep: str = "pca", n_clusters: int | None = None, theta: float = 2.0, ridge: float = 1.0, sigma: float = 0.1, rounds: int = 10, seed: int = 0) -> Cohort:
    """Harmony: soft clusters that are penalised for being of one batch, then a ridge correction
    in every cluster; the corrected components are column ``pca_harmony``. A round gathers sums
    by cluster and batch only."""
    require_column(cohort.pixels.columns, rep, NoEmbeddingError)
    require_column(cohort.pixels.columns, batch_key)
    _without_nulls(cohort, batch_key)
    key = pixel_key()
    rows = stored(cohort.pixels.select(key.alias("id"), F.col(rep).alias("z"), F.col(rep).alias("y"), F.col(batch_key).cast("string").alias("b")), "harmony")
    counts = {r.b: r.n for r in rows.groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect()}
    batches, n = sorted(counts), sum(counts.values())
    if len(batches) < 2:
        raise InvalidParameterError(f"'{batch_key}' has one value only.")
    d = len(rows.select("z").first()[0])
    k = n_clusters or max(2, min(100, round(n / 30)))
    start = rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(k).collect()
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    centres = unit(np.array([r.y for r in start], float))
    k = len(centres)
    share = np.array([counts[b] / n for b in batches])
    code = {b: i for i, b in enumerate(batches)}
    penalty = np.ones((k, len(batches)))

    def soft(y: np.ndarray, b: np.ndarray, centres: np.ndarray, penalty: np.ndarray) -> np.ndarray:
        r = np.exp(-2 * (1 - unit(y) @ centres.T) / sigma) * penalty[:, b].T
        return r / np.maximum(r.sum(1, keepdims=True), 1e-300)

    for _ in range(rounds):
        for _ in range(4):
            def add(f: pd.DataFrame, centres=centres, penalty=penalty) -> np.ndarray:
                y, b = _matrix(f["y"]), f["b"].map(code).to_numpy()
                r = soft(y, b, centres, penalty)
                return np.concatenate([r.T @ unit(y), r.T @ np.eye(len(batches))[b]], axis=1)

            sums = _summed(rows, (k, d + len(batches)), add)
            centres, seen = unit(sums[:, :d]), sums[:, d:]
            penalty = ((seen.sum(1, keepdims=True) * share + 1) / (seen + 1)) ** theta

        def gather(f: pd.DataFrame, centres=centres, penalty=penalty) -> np.ndarray:
            y, z, b = _matrix(f["y"]), _matrix(f["z"]), f["b"].map(code).to_numpy()
            r = soft(y, b, centres, penalty)
            phi = np.concatenate([np.ones((len(b), 1)), np.eye(len(batches))[b]], axis=1)
            return np.concatenate([np.einsum("nk,na,nb->kab", r, phi, phi), np.einsum("nk,na,nd->kad", r, phi, z)], axis=2)

        m = len(batches) + 1
        s = _summed(rows, (k, m, m + d), gather)
        penal = ridge * np.diag([0.0] + [1.0] * len(batches))
        w = np.stack([np.linalg.pinv(s[c, :, :m] + penal) @ s[c, :, m:] for c in range(k)])
        w[:, 0] = 0

        def correct(parts: Iterator[pd.DataFrame], centres=centres, penalty=penalty, w=w) -> Iterator[pd.DataFrame]:
            for f in parts:
                if len(f):
                    y, z, b = _matrix(f["y"]), _matrix(f["z"]), f["b"].map(code).to_numpy()
                    r = soft(y, b, centres, penalty)
                    f = f.assign(y=list(z - np.einsum("nk,knd->nd", r, w[:, 1:][:, b])))
                yield f

        rows = stored(rows.mapInPandas(correct, "id string, z array<double>, y array<double>, b string"), "harmony")
    fixed = rows.select(F.col("id").alias("_k"), F.col("y").alias("pca_harmony"))
    joined = cohort.pixels.withColumn("_id", key).join(fixed, F.col("_id") == F.col("_k")).drop("_id", "_k")
    return cohort.with_pixels(joined, "run_harmony", batch_key=batch_key)


#: Most pixels that are laid out.
LAYOUT_PIXELS = 50_000


def run_umap(cohort: Cohort, edges: DataFrame, min_dist: float = 0.5, epochs: int = 200, seed: int = 0) -> DataFrame:
    """``id, u, v``: a layout of the neighbour graph for viewing, by attraction along edges and
    sampled repulsion, started from the first two components. One machine's work, so it refuses
    graphs of more than ``LAYOUT_PIXELS`` pixels; lay out a sample then."""
    rows = represented(cohort, "pca").orderBy("id").limit(LAYOUT_PIXELS + 1).collect()
    if len(rows) > LAYOUT_PIXELS:
        raise InvalidParameterError(f"A layout takes at most {LAYOUT_PIXELS} pixels; take a sample.")
    place = {r.id: i for i, r in enumerate(rows)}
    pairs = edges.select("i", "j", "d").collect()
    a, b = np.array([place[e.i] for e in pairs]), np.array([place[e.j] for e in pairs])
    at = np.array([list(r.pca[:2]) + [0.0] * (2 - len(r.pca[:2])) for r in rows])
    at = 10 * at / max(np.abs(at).max(), 1e-12)
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        rate = 1 - epoch / epochs
        gap = at[a] - at[b]
        pull = -2 * gap / (1 + (gap**2).sum(1, keepdims=True) + min_dist)
        move = np.zeros_like(at)
        np.add.at(move, a, np.clip(pull, -4, 4))
        np.add.at(move, b, -np.clip(pull, -4, 4))
        other = rng.integers(0, len(at), len(at))
        gap = at - at[other]
        d2 = (gap**2).sum(1, keepdims=True)
        move += np.clip(2 * gap / ((0.01 + d2) * (1 + d2)), -4, 4)
        at += rate * 0.1 * move
    data = [(r.id, float(x), float(y)) for r, (x, y) in zip(rows, at, strict=True)]
    return cohort.pixels.sparkSession.createDataFrame(data, "id string, u double, v double")


def explained(cohort: Cohort) -> list[float]:
    """Variance of every component."""
    d = len(cohort.pixels.select("pca").first()[0])
    row = cohort.pixels.agg(*[F.var_samp(F.get("pca", F.lit(i))).alias(f"v{i}") for i in range(d)]).first()
    return [math.nan if v is None else v for v in row]
