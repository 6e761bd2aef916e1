"""Tails, ranks, group tests and planted cohorts."""

import itertools
import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from histomill.errors import InsufficientSamplesError, InvalidParameterError, PseudoreplicationWarning
from histomill.functions import special
from histomill.functions.ranks import counted_rank, with_bh
from histomill.model import Cohort
from histomill.operators import annotate, difference, neighbours, reduce, samples, spatial


def cohort_of(spark, sections, x, y, values, names=None, **obs):
    """A cohort from arrays, one entry a pixel."""
    columns = list(obs)
    rows = [
        (str(s), i, float(a), float(b), *(obs[c][i] for c in columns), [float(v) for v in row])
        for i, (s, a, b, row) in enumerate(zip(sections, x, y, values, strict=True))
    ]
    schema = "section string, pixel_id long, x double, y double" + "".join(f", {c} string" for c in columns) + ", values array<double>"
    names = names or [f"m{i:03d}" for i in range(len(values[0]))]
    return Cohort(spark.createDataFrame(rows, schema), tuple(names))


def test_exact_small_samples():
    assert special.mann_whitney(16, 4, 4, 0, True) == pytest.approx(2 / 70)
    assert special.mann_whitney(25, 5, 5, 0, True) == pytest.approx(2 / 252)
    assert special.mann_whitney(36, 6, 6, 0, True) == pytest.approx(0.00216450216)
    values = [1.5, 2.5, 3.1, 0.2, 7.0, 4.4, 5.2]
    us = [sum(values[i] > values[j] for i in a for j in range(7) if j not in a) for a in itertools.combinations(range(7), 3)]
    for u in range(13):
        want = min(1, 2 * sum(v >= max(u, 12 - u) for v in us) / len(us))
        assert special.mann_whitney(u, 3, 4, 0, True) == pytest.approx(want)


def test_normal_rank_sum_matches_the_closed_form():
    # delta of 24 samples in two arms of 12, p of the normal form with continuity correction
    for delta in (0.0, 0.25, 0.5, -0.75):
        u = (delta + 1) * 72
        z = (max(u, 144 - u) - 72 - 0.5) / math.sqrt(12 * 12 * 25 / 12)
        assert special.mann_whitney(u, 12, 12, 0, False) == pytest.approx(min(1, math.erfc(z / math.sqrt(2))))


def test_signed_ranks():
    for n, w in ((5, 2.0), (6, 0.0), (7, 11.0)):
        sums = [sum(i + 1 for i in range(n) if m >> i & 1) for m in range(1 << n)]
        low = min(w, n * (n + 1) / 2 - w)
        assert special.signed_rank(w, n, 0, False) == pytest.approx(min(1, 2 * sum(s <= low for s in sums) / (1 << n)))
    assert special.signed_rank(5, 0, 0, True) == 1


def test_tails_against_known_values():
    assert special.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05)
    assert special.chi2_sf(18.307038053275146, 10) == pytest.approx(0.05)
    assert special.f_sf(4.964602743730711, 1, 10) == pytest.approx(0.05)
    assert special.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05)
    assert special.normal_sf(1.959963984540054) == pytest.approx(0.025)
    hyper = lambda k: math.comb(5, k) * math.comb(15, 6 - k) / math.comb(20, 6)
    assert special.fisher_greater(3, 6, 5, 20) == pytest.approx(sum(map(hyper, range(3, 6))))


def test_bh(spark):
    p = [0.01, 0.02, 0.02, 0.5, None, 0.04]
    got = {r.i: r.pval_adj for r in with_bh(spark.createDataFrame(list(enumerate(p)), "i int, pval double")).collect()}
    known = sorted((v, i) for i, v in enumerate(p) if v is not None)
    want, low = {}, 1.0
    for rank in range(len(known), 0, -1):
        low = min(low, known[rank - 1][0] * len(known) / rank)
        want[known[rank - 1][1]] = low
    assert got[4] is None and all(got[i] == pytest.approx(v) for i, v in want.items()) and got[1] == got[2]


def nested(spark, n=6, effect=6.0, seed=1, pixels=40, features=30):
    r = np.random.default_rng(seed)
    rows, section, group, patient = [], [], [], []
    for g in ("R", "NR"):
        for i in range(n):
            base = r.normal(size=features) + (effect if g == "R" else 0) * (np.arange(features) < 5)
            rows.append(r.normal(base, 0.5, size=(pixels, features)))
            section += [f"{g}{i}"] * pixels
            group += [g] * pixels
            patient += [f"p{g}{i}"] * pixels
    values = np.concatenate(rows)
    x, y = np.tile(np.arange(pixels) % 8, 2 * n), np.tile(np.arange(pixels) // 8, 2 * n)
    return cohort_of(spark, section, x, y, values - values.min(), response=group, patient=patient)


def test_planted_effects_and_null(spark):
    out = difference.differential_abundance(samples.pseudobulk(nested(spark), "section"), "response", "R", "NR").collect()
    hits = {r.metabolite for r in out if r.pval_adj < 0.05}
    assert {f"m{i:03d}" for i in range(5)} <= hits and len(hits) <= 6
    assert all(r.delta > 0.8 for r in out[:5]) and [abs(r.delta) for r in out] == sorted((abs(r.delta) for r in out), reverse=True)
    null = difference.differential_abundance(samples.pseudobulk(nested(spark, effect=0), "section"), "response", "R", "NR").collect()
    assert sum(r.pval_adj < 0.05 for r in null) <= 1
    with pytest.warns(PseudoreplicationWarning):
        pixels = difference.compare_groups(nested(spark, effect=0), "response", "R", "NR").collect()
    assert sum(r.pval_adj < 0.05 for r in pixels) > 15


def test_bootstrap_is_reproducible_and_covers(spark):
    bulk = samples.pseudobulk(nested(spark), "section")
    run = lambda: {r.metabolite: r for r in difference.differential_abundance(bulk, "response", "R", "NR", bootstrap=100).collect()}
    a, b = run(), run()
    assert all(a[m].delta_ci_low == b[m].delta_ci_low for m in a)
    assert all(r.delta_ci_low <= r.delta + 1e-9 and r.delta_ci_high >= r.delta - 1e-9 for r in a.values())
    assert a["m000"].ci_excludes_zero


def test_bootstrap_draws_are_hashes_and_make_no_pairs(spark):
    r = np.random.default_rng(6)
    sizes, seed, replicates = {1: 9, 2: 7}, 11, 20
    rows = [(f"s{g}{i}", m, None if m == "holes" and i == 2 else math.nan if m == "holes" and i == 5 else float(r.integers(0, 6)), g) for g, n in sizes.items() for i in range(n) for m in ("whole", "holes")]
    long = spark.createDataFrame(rows, "sample string, metabolite string, value double, grp int")
    draws = spark.range(1, replicates + 1).select(F.col("id").cast("int").alias("rep"), F.explode(F.array(F.lit(1), F.lit(2))).alias("g"), F.explode(F.sequence(F.lit(1), F.lit(9))).alias("j"))
    table = {(q.rep, q.g, q.j): q.h for q in draws.withColumn("h", F.xxhash64(F.lit(seed), "rep", "g", "j")).collect()}
    got = {q.metabolite: (q.delta_ci_low, q.delta_ci_high) for q in difference.bootstrap_delta(long, replicates, 0.1, seed).collect()}
    order = lambda v: math.inf if math.isnan(v) else v
    for m in ("whole", "holes"):
        values = {g: [v for s, n, v, k in sorted(rows, key=lambda q: q[0]) if n == m and k == g] for g in sizes}
        deltas = []
        for rep in range(1, replicates + 1):
            a, b = ([values[g][table[rep, g, j] % n] for j in range(1, n + 1)] for g, n in sizes.items())
            deltas.append(sum((order(x) > order(y)) - (order(x) < order(y)) for x in a for y in b if x is not None and y is not None) / 63)
        assert got[m] == pytest.approx(tuple(np.quantile(deltas, [0.05, 0.95])))
    # as many pairs as 60,000 x 60,000 a replicate
    n = 60_000
    many = spark.range(2 * n).select(F.col("id").cast("string").alias("sample"), F.lit("m").alias("metabolite"), (F.col("id") * 7919 % 10007).cast("double").alias("value"), (F.col("id") % 2 + 1).cast("int").alias("grp"))
    low, high = difference.bootstrap_delta(many, 5).select("delta_ci_low", "delta_ci_high").first()
    assert -0.02 < low <= high < 0.02


def test_partitions_do_not_matter(spark):
    c = nested(spark, n=3)
    seen = []
    for n in (1, 4, 17):
        d = c.with_pixels(c.pixels.repartition(n))
        out = difference.differential_abundance(samples.pseudobulk(d, "section"), "response", "R", "NR").collect()
        seen.append([(r.metabolite, round(r.delta, 9), round(r.pval, 12)) for r in out])
    assert seen[0] == seen[1] == seen[2]


def test_carried_columns_and_small_samples(spark):
    c = nested(spark, n=3)
    c = c.with_pixels(c.pixels.where("section <> 'R0' OR pixel_id < 4").withColumn("spot", (F.col("pixel_id") % 2).cast("string")))
    with pytest.warns(UserWarning, match="Dropped 1"):
        bulk = samples.pseudobulk(c, "section")
    assert set(bulk.samples.columns) >= {"sample", "n_pixels", "response", "patient"} and "spot" not in bulk.samples.columns
    with pytest.raises(InsufficientSamplesError):
        difference.differential_abundance(bulk, "response", "R", "NR")
    with pytest.raises(InvalidParameterError, match="Did you mean 'response'"):
        difference.differential_abundance(bulk, "respons", "R", "NR")


def planted(spark, n, seed):
    """Sections with the same totals, three features gathered in a blob in one arm."""
    r = np.random.default_rng(seed)
    side, features = 16, 12
    gx, gy = np.meshgrid(np.arange(side), np.arange(side))
    gx, gy = gx.ravel() + r.uniform(-0.05, 0.05, side * side), gy.ravel() + r.uniform(-0.05, 0.05, side * side)
    rows, section, group = [], [], []
    for g in ("R", "NR"):
        for i in range(n):
            v = r.uniform(0.5, 1.5, (side * side, features))
            if g == "R":
                cx, cy = r.uniform(4, 12, 2)
                blob = np.exp(-((gx - cx) ** 2 + (gy - cy) ** 2) / 8)
                v[:, :3] = v[:, :3] * 0.3 + 3 * blob[:, None]
            v *= side * side / v.sum(0)
            rows.append(v)
            section += [f"{g}{i}"] * len(v)
            group += [g] * len(v)
    return cohort_of(spark, section, np.tile(gx, 2 * n), np.tile(gy, 2 * n), np.concatenate(rows), response=group)


@pytest.mark.parametrize("seed", [1, 2])
def test_arrangement_without_abundance(spark, seed):
    c = planted(spark, 6, seed)
    organization = spatial.spatial_organization(c, metrics=("morans_i", "entropy", "gini", "hotspot_fraction"))
    moran = difference.differential_spatial_organization(organization, "response", "R", "NR")
    found = {r.metabolite for r in moran.where("pval_adj < 0.05").collect()}
    assert {"m000", "m001", "m002"} <= found and len(found) <= 5
    abundance = difference.differential_abundance(samples.pseudobulk(c, "section"), "response", "R", "NR")
    two = difference.compare_abundance_and_organization(abundance, moran, fdr_threshold=0.05).collect()
    assert {r.metabolite for r in two[:3]} == {"m000", "m001", "m002"} and two[0].classification == "organization only"


def test_dense_spatial_statistics(spark):
    r = np.random.default_rng(4)
    n, k = 80, 6
    x, y, v = r.uniform(0, 10, n), r.uniform(0, 10, n), r.normal(size=(n, 2))
    v[:, 0] += x
    c = cohort_of(spark, ["s"] * n, x, y, v)
    d = (x[:, None] - x) ** 2 + (y[:, None] - y) ** 2
    np.fill_diagonal(d, np.inf)
    w = np.zeros((n, n))
    w[np.repeat(np.arange(n), k), np.argsort(d, 1)[:, :k].ravel()] = 1 / k
    z = v - v.mean(0)
    moran = np.einsum("if,ij,jf->f", z, w, z) / (z**2).sum(0)
    geary = (n - 1) / (2 * n) * np.array([(w * (v[:, f][:, None] - v[:, f]) ** 2).sum() for f in range(2)]) / (z**2).sum(0)
    s1, s2 = 0.5 * ((w + w.T) ** 2).sum(), ((1 + w.sum(0)) ** 2).sum()
    var = (n * n * s1 - n * s2 + 3 * n * n) / ((n * n - 1) * n * n) - 1 / (n - 1) ** 2
    got = {r.metabolite: r for r in spatial.spatial_autocorrelation(c).collect()}
    for f in range(2):
        row = got[f"m{f:03d}"]
        assert row.morans_i == pytest.approx(moran[f]) and row.geary_c == pytest.approx(geary[f])
        assert row.z_score == pytest.approx((moran[f] + 1 / (n - 1)) / math.sqrt(var))
    gi = {r.pixel_id: r.gi_star for r in spatial.getis_ord_gi(c, "m000").collect()}
    star = (w * k + np.eye(n)) / (k + 1)
    want = (star @ v[:, 0] - v[:, 0].mean()) / (v[:, 0].std() * math.sqrt((n / (k + 1) - 1) / (n - 1)))
    assert all(gi[i] == pytest.approx(want[i]) for i in range(n))
    own = z[:, 0] / v[:, 0].std()
    assert {r.pixel_id: pytest.approx(r.local_i) for r in spatial.local_moran(c, "m000").collect()} == dict(enumerate(own * (w @ own)))


def test_sections_do_not_see_each_other(spark):
    r = np.random.default_rng(0)
    v = r.random((60, 3))
    x, y = np.tile(np.arange(30) % 6, 2), np.tile(np.arange(30) // 6, 2)
    both = cohort_of(spark, ["a"] * 30 + ["b"] * 30, x, y, v)
    alone = cohort_of(spark, ["a"] * 30, x[:30], y[:30], v[:30])
    of = lambda c: {(q.sample, q.metabolite): q.value for q in spatial.spatial_organization(c, metrics=("morans_i",), min_pixels=10).values.collect()}
    a, b = of(both), of(alone)
    assert all(a[k] == pytest.approx(v) for k, v in b.items()) and len(a) == 2 * len(b)


def test_shuffled_labels_have_no_neighbourhoods(spark):
    from histomill.operators import neighbours

    r = np.random.default_rng(7)
    x, y = np.arange(400) % 20, np.arange(400) // 20
    c = cohort_of(spark, ["s"] * 400, x, y, np.ones((400, 1)), cluster=[str(v) for v in r.integers(0, 3, 400)])
    out = spatial.neighborhood_enrichment(c, neighbours.spatial_neighbors(c, 4), n_permutations=200).collect()
    assert all(abs(q.zscore) < 4 for q in out)
    halves = cohort_of(spark, ["s"] * 400, x, y, np.ones((400, 1)), cluster=["l" if v < 10 else "r" for v in x])
    out = {(q.cluster_a, q.cluster_b): q for q in spatial.neighborhood_enrichment(halves, neighbours.spatial_neighbors(halves, 4), n_permutations=100).collect()}
    assert out["l", "l"].zscore > 5 > -5 > out["l", "r"].zscore


def test_sets(spark):
    rows = [(f"c{i}", 0.9 if i < 10 else -0.9 if i < 20 else 0.0) for i in range(60)]
    result = spark.createDataFrame(rows, "metabolite string, delta double")
    sets = annotate.set_rows(spark, {"up": [f"C{i} " for i in range(8)], "down": [f"c{i}" for i in range(10, 18)], "flat": [f"c{i}" for i in range(30, 40)]})
    ora = {(r.pathway, r.direction): r for r in annotate.pathway_ora(result, sets).collect()}
    assert ora["up", "up"].pval < 1e-6 and ora["down", "down"].pval < 1e-6 and ("flat", "any") not in ora and ora["up", "up"].n_hits == 8
    gsea = {r.pathway: r for r in annotate.metabolite_set_enrichment(result, sets, n_permutations=200).collect()}
    assert gsea["down"].es < -0.7 and gsea["down"].nes < -1.2 and gsea["down"].pval < 0.2 and gsea["flat"].n_found == 10


def test_permutations_of_sets_are_made_one_at_a_time(spark, monkeypatch):
    scores, k, n = np.sort(np.random.default_rng(3).normal(size=20_000).round(3))[::-1], 300, 100
    tracemalloc.start()
    got = annotate._null_walks(scores, k, 0, n, 5)
    assert tracemalloc.get_traced_memory()[1] < n * len(scores) * 8 / 4
    tracemalloc.stop()
    draws = np.random.default_rng([5, k]).random((n, len(scores)))
    for row, es in zip(draws, got, strict=True):
        inside = np.isin(np.arange(len(scores)), row.argsort()[:k])
        path = np.where(inside, np.abs(scores) / np.abs(scores[inside]).sum(), -1 / (len(scores) - k)).cumsum()
        assert es == pytest.approx(path[np.abs(path).argmax()])
    assert annotate._null_walks(scores, k, 37, 20, 5) == got[37:57]
    assert annotate._null_walks(np.array([2.0, 1.0, -1.0]), 3, 0, 2, 5) == pytest.approx([1.0, 1.0])
    assert annotate._null_walks(np.zeros(40), 10, 0, 3, 5) == [-1.0] * 3

    result = spark.createDataFrame([(f"c{i:03d}", float(v)) for i, v in enumerate(scores[::100])], "metabolite string, delta double")
    sets = annotate.set_rows(spark, {"a": [f"c{i:03d}" for i in range(0, 60, 2)], "b": [f"c{i:03d}" for i in range(90, 120)], "c": [f"c{i:03d}" for i in range(150, 161)]})
    whole = annotate.metabolite_set_enrichment(result, sets, n_permutations=50).collect()
    monkeypatch.setattr(annotate, "STEP_DRAWS", 7 * 200)
    assert annotate.metabolite_set_enrichment(result, sets, n_permutations=50).collect() == whole and len(whole) == 3


def test_classes(spark):
    want = {
        "PC(34:1)": "Glycerophospholipid", "SM(d18:1/16:0)": "Sphingolipid", "TG(16:0_18:1_18:2)": "Glycerolipid", "Taurine": "Amino acid", "L-Alanine": "Amino acid",
        "(+)-Erysotrine": "Unclassified", "Cholesterol": "Sterol", "Lysylalanine": "Peptide", "ATP": "Nucleotide", "Spermine": "Polyamine", "Citric acid": "Organic acid",
        "Benzonitrile": "Xenobiotic", "N-acetyl-glycine": "Amino acid", "(2R,3S)-Glucose": "Carbohydrate", "Octanoylcarnitine": "Fatty acyl",
    }
    rows = annotate.classify_names(spark.createDataFrame([(k,) for k in want], "metabolite string")).collect()
    assert {r.metabolite: r.chemical_class for r in rows} == want
    c = Cohort(spark.createDataFrame([], "pixel_id long, values array<double>"), ("Taurine", "zzz", "qqq"))
    with pytest.warns(UserWarning, match="no class"):
        made = annotate.classify_compounds(c, {"ZZZ": "Alkaloid"}, {"taurine": "Amine"})
    assert made.about["chemical_class"] == ("Amine", "Alkaloid", "Unclassified")


def test_signatures(spark):
    table = lambda f: spark.createDataFrame([(f"c{i}", f(i)) for i in range(20)], "metabolite string, delta double")
    a = table(lambda i: i / 10 - 1)
    assert difference.track_flow(a, a)[0]["verdict"] == "PERSISTS"
    assert difference.track_flow(a, table(lambda i: 1 - i / 10))[0]["verdict"] == "FLIPS"
    summary, rows = difference.compare_signatures(a, table(lambda i: (i * 7 % 20) / 10 - 1), n_boot=50)
    assert summary["rho_ci_low"] <= summary["rho"] <= summary["rho_ci_high"] and rows.count() == 20
    with pytest.raises(InvalidParameterError):
        difference.compare_signatures(a, table(lambda i: 0.5))


def test_enrichment_of_graphs_too_large_to_ship(spark, monkeypatch):
    labels = ["a", "a", "b", "b", "b", "c"]
    c = cohort_of(spark, ["s"] * 6, list(range(6)), [0] * 6, np.ones((6, 1)), cluster=labels)
    links = [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (2, 5)]
    edges = spark.createDataFrame([("s", i, j) for x, y in links for i, j in ((x, y), (y, x))], "section string, i long, j long")
    monkeypatch.setattr(spatial, "SHIPPED_EDGES", 3)
    out = {(q.cluster_a, q.cluster_b): q for q in spatial.neighborhood_enrichment(c, edges).collect()}
    assert len(out) == 6
    every = list(itertools.permutations(labels))
    for pair, q in out.items():
        counts = [sum(tuple(sorted((p[i], p[j]))) == pair for i, j in links) for p in every]
        assert q.expected == pytest.approx(np.mean(counts)) and q.observed == sum(tuple(sorted((labels[i], labels[j]))) == pair for i, j in links)
        assert q.zscore == pytest.approx((q.observed - np.mean(counts)) / (np.std(counts) + 1e-9), abs=1e-6)


@pytest.mark.parametrize("place", ["lattice", "outlier", "clump", "line", "one place"])
def test_nearest_points_wherever_they_lie(spark, place):
    r = np.random.default_rng(5)
    xy = np.array([(i % 20, i // 20) for i in range(300)], float)
    if place == "outlier":
        xy = np.vstack([xy, [(1e6, 1e6)]])
    elif place == "clump":  # more points in one cell than are paired, and a few far ones
        xy = np.vstack([r.random((700, 2)) * 1e-3, r.random((90, 2)) * 1e3])
    elif place == "line":
        xy[:, 1] = 0
        xy[:, 0] = r.permutation(300)
    elif place == "one place":
        xy = xy[:60] * 0
    pts = spark.createDataFrame([("s", i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "section string, id long, x double, y double")
    got = {}
    for e in neighbours.knn(pts, 4).collect():
        got.setdefault(e.i, []).append((e.r, e.j))
    for i in range(len(xy)):
        d2 = ((xy - xy[i]) ** 2).sum(axis=1)
        want = sorted((j for j in range(len(xy)) if j != i), key=lambda j: (d2[j], j))[:4]
        assert [j for _, j in sorted(got[i])] == want


def test_moran_of_large_means_and_missing_values(spark):
    r = np.random.default_rng(6)
    n = 144
    x, y = np.arange(n) % 12, np.arange(n) // 12
    values = np.column_stack([x + r.normal(0, 2, n), 1e7 + x + r.normal(0, 2, n), np.full(n, 3.25)])
    table = {t.metabolite: t for t in spatial.spatial_autocorrelation(cohort_of(spark, ["s"] * n, x, y, values)).collect()}
    edges = {}
    for i in range(n):
        d2 = (x - x[i]) ** 2 + (y - y[i]) ** 2
        edges[i] = sorted((j for j in range(n) if j != i), key=lambda j: (d2[j], j))[:6]
    for f in (0, 1):
        z = values[:, f] - values[:, f].mean()
        want = sum(z[i] * z[edges[i]].mean() for i in range(n)) / (z @ z)
        geary = (n - 1) / (2 * n) * sum(((z[i] - z[edges[i]]) ** 2).mean() for i in range(n)) / (z @ z)
        assert table[f"m{f:03d}"].morans_i == pytest.approx(want, rel=1e-6) and table[f"m{f:03d}"].geary_c == pytest.approx(geary, rel=1e-6)
    assert table["m002"].morans_i == 0 and table["m002"].geary_c == 1


def test_batches_must_be_known(spark):
    c = cohort_of(spark, ["s"] * 4, range(4), range(4), np.ones((4, 2)), batch=["a", None, "b", "b"])
    with pytest.raises(InvalidParameterError, match="batch"):
        reduce.correct_batches(c, "batch")


def test_ranks_by_ranges(spark):
    """One feature has nearly all rows; it is ranked in several ranges, none of which holds most."""
    r = np.random.default_rng(7)
    rows = [("hot", float(v)) for v in np.unique(r.integers(0, 5000, 4000))] + [("cold", float(v)) for v in range(20)]
    rows = [(f, v, int(r.integers(1, 4))) for f, v in rows]
    table = spark.createDataFrame(rows, "f string, value double, t long")
    once = sorted(map(tuple, counted_rank(table, "f", "value", "t").collect()))
    assert sorted(map(tuple, counted_rank(table, "f", "value", "t", spread=True).collect())) == once
    held = {}
    for f, v, t, rank in once:
        assert rank == held.get(f, 0) + (t + 1) / 2
        held[f] = held.get(f, 0) + t
    ranges = table.repartitionByRange(4, "f", "value").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(ranges) > 1 and max(x["count"] for x in ranges) < 0.6 * len(rows)
