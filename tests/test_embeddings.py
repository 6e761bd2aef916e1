"""Decompositions, clusterings, batch correction, images: invariants and planted truths."""

import numpy as np
import pytest

from histomill.errors import InvalidParameterError
from histomill.operators import cluster, image, reduce, spatial, transform
from tests.test_statistics import cohort_of


@pytest.fixture(scope="module")
def groups(spark):
    """Two well separated groups in two batches that are shifted."""
    r = np.random.default_rng(2)
    kind, batch = np.arange(160) % 2, (np.arange(160) // 2) % 2
    v = r.normal(0, 0.3, (160, 8)) + 3 + 2 * kind[:, None] * (np.arange(8) < 4) + 1.5 * batch[:, None]
    x, y = np.arange(160) % 16, np.arange(160) // 16
    return cohort_of(spark, ["s"] * 160, x, y, v, kind=[str(k) for k in kind], batch=[f"b{b}" for b in batch]), v


def test_components(groups):
    c, v = groups
    made = reduce.run_pca(c, 5)
    scores = np.array([r.pca for r in made.pixels.orderBy("pixel_id").collect()])
    values = np.linalg.eigvalsh(np.cov(v.T))[::-1][:5]
    assert np.allclose(np.cov(scores.T), np.diag(values), atol=1e-8) and np.allclose(scores.mean(0), 0)
    assert np.allclose(reduce.explained(made), values)
    with pytest.raises(InvalidParameterError):
        reduce.run_pca(c.select_features([0]))


def test_communities_and_measures(groups):
    c, _ = groups
    made = reduce.run_pca(reduce.correct_batches(c, "batch"), 4)
    edges = reduce.run_neighbors(made, 10, 4, "euclidean")
    found = cluster.cluster(made, edges, [0.05, 1.0])
    assert {"cluster", "cluster_0_05", "cluster_1"} <= set(found.pixels.columns)
    agree = cluster.compare_clusterings(found, "cluster_0_05", "kind").first()
    assert agree.ari == pytest.approx(1) and agree.ami == pytest.approx(1)
    assert cluster.run_paga(found, edges, "cluster").where("connectivity > 1").count() == 0
    assert reduce.cluster_validation(found, "kind").first().silhouette > 0.4
    assert cluster.spatial_domains(made, 0.5).pixels.select("domain").distinct().count() >= 1


def test_batches_mix_after_correction(groups):
    c, v = groups
    before = reduce.batch_mixing_score(reduce.run_pca(c, 4), "batch", n_neighbors=15)[0]
    combat = reduce.correct_batches(c, "batch", ["kind"])
    after = reduce.batch_mixing_score(reduce.run_pca(combat, 4), "batch", n_neighbors=15)[0]
    assert before < 1.2 and after > 1.6
    fixed = np.array([r["values"] for r in combat.pixels.orderBy("pixel_id").collect()])
    b = (np.arange(160) // 2) % 2
    assert np.abs(fixed[b == 0].mean(0) - fixed[b == 1].mean(0)).max() < 0.1 * np.abs(v[b == 0].mean(0) - v[b == 1].mean(0)).max()
    harmony = reduce.run_harmony(reduce.run_pca(c, 4), "batch", n_clusters=4, rounds=4)
    assert reduce.batch_mixing_score(harmony, "batch", "pca_harmony", 15)[0] > before
    with pytest.raises(InvalidParameterError):
        reduce.correct_batches(c, "section")


def test_factors(spark):
    r = np.random.default_rng(0)
    w, h = r.random((90, 2)) * (r.random((90, 2)) < 0.7), r.random((2, 6))
    c = cohort_of(spark, ["s"] * 90, np.arange(90) % 9, np.arange(90) // 9, w @ h)
    made, top = reduce.cluster_nmf(c, 2, n_top=3)
    found = np.array([q.nmf for q in made.pixels.orderBy("pixel_id").collect()])
    assert (found >= 0).all() and top.count() == 6
    _, losses = reduce.factorise(c.pixels.selectExpr("values as v"), 6, 2)
    assert all(b <= a + 1e-9 for a, b in zip(losses, losses[1:], strict=False)) and losses[-1] < 0.01 * float(((w @ h) ** 2).sum())
    assert reduce.spatially_weighted_nmf(c, 2)[0].pixels.where("snmf_cluster is null").count() == 0
    domains = reduce.spatial_domains_kmeans(reduce.run_pca(c, 3), 3, n_init=2)
    assert domains.pixels.select("domain").distinct().count() == 3


def test_unmixing_is_exact(spark):
    a, b = np.array([1.0, 0, 2, 1]), np.array([0.0, 3, 1, 1])
    shares = [(1, 0), (0.5, 0.5), (0, 1), (0.25, 0.75)]
    c = cohort_of(spark, ["s"] * 4, range(4), range(4), [p * a + q * b for p, q in shares])
    spectra = {n: dict(zip(c.names, v, strict=True)) for n, v in (("a", a), ("b", b))}
    got = [r.unmixed for r in transform.unmix_pixels(c, spectra).pixels.orderBy("pixel_id").collect()]
    assert np.allclose(got, shares, atol=1e-9)


def test_layout(groups):
    c, _ = groups
    made = reduce.run_pca(c, 4)
    out = reduce.run_umap(made, reduce.run_neighbors(made, 8, 4), epochs=20).collect()
    assert len(out) == 160 and np.isfinite([(r.u, r.v) for r in out]).all()


def test_images(spark):
    r = np.random.default_rng(1)
    picture = r.integers(0, 255, (20, 30, 3))
    c = cohort_of(spark, ["s"] * 5, [0, 5, 29, 100, 12], [0, 7, 19, -3, 3], np.ones((5, 1)))
    got = image.extract_image_features(image.align_image(c), picture, 2).pixels.orderBy("pixel_id").collect()
    for row in got:
        cx, cy = np.clip(int(row.x), 0, 29), np.clip(int(row.y), 0, 19)
        disc = [(dy, dx) for dy in range(-2, 3) for dx in range(-2, 3) if dx * dx + dy * dy <= 4]
        want = np.mean([picture[np.clip(cy + dy, 0, 19), np.clip(cx + dx, 0, 29)] for dy, dx in disc], 0) / picture.max()
        assert np.allclose([row.image_red, row.image_green, row.image_blue], want, atol=1e-6)


def test_median_raster(spark):
    r = np.random.default_rng(3)
    grid = r.random((6, 7))
    y, x = (v.ravel() for v in np.indices((6, 7)))
    c = cohort_of(spark, ["s"] * 42, x, y, grid.reshape(-1, 1))
    got = {q.pixel_id: q["values"][0] for q in spatial.median_filtered(c, "values").pixels.collect()}
    padded = np.pad(grid, 1, mode="edge")
    flat = np.array([np.median(padded[i : i + 3, j : j + 3]) for i in range(6) for j in range(7)])
    want = np.where(flat < np.median(flat), 0, flat)
    assert np.allclose([got[i] for i in range(42)], want)
