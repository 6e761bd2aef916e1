"""Reading, writing, filters, manifests, command line, streams."""

import json
import os
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from histomill import cli, manifest
from histomill.errors import AnalysisError, FileFormatError, InvalidParameterError, MissingRegionError
from histomill.operators import difference, figures, filters, samples
from histomill.sources import pathways, tables
from histomill.streaming import ingest
from tests.test_statistics import cohort_of, nested, planted

WANT = [5188.60, 4801.84, 5960.63]


def written(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_separators(spark, tmp_path, sep):
    rows = [["X", "Y", "Taurine", "Creatine", "Choline"]] + [[str(i), str(i + 1), f"{i}.5", f"{i}.25", ""] for i in range(12)]
    c = tables.read_cohort(spark, written(tmp_path / "t.csv", "\n".join(sep.join(r) for r in rows)))
    assert c.names == ("Taurine", "Creatine", "Choline")
    got = {r.pixel_id: r["values"] for r in c.pixels.collect()}
    assert got["3_4"] == [3.5, 3.25, 0.0] and len(got) == 12


@pytest.mark.parametrize(
    "numbers", [["5188.60", "4801.84", "5960.63"], ["5188,60", "4801,84", "5960,63"], ["5.188,60", "4.801,84", "5.960,63"], ["5,188.60", "4,801.84", "5,960.63"]]
)
def test_number_formats(spark, tmp_path, numbers):
    text = "x;y;m0;m1;m2\n" + "\n".join(f"{i};{i};" + ";".join(numbers) for i in range(4))
    c = tables.read_cohort(spark, written(tmp_path / "t.csv", text))
    assert c.pixels.first()["values"] == WANT


def test_hard_numbers(spark, tmp_path):
    assert tables.number_format(["1.234.567"]) == (",", ".", True)
    assert tables.number_format(["1.234", "12.345"]) == (",", ".", False)
    assert tables.number_format(["12.5", "7"]) == (".", None, True) and tables.number_format([]) == (".", None, True)
    with pytest.warns(UserWarning, match="two ways"):
        c = tables.read_cohort(spark, written(tmp_path / "a.csv", "x;y;m\n1;1;1.234\n2;2;5.678"))
    assert sorted(r["values"][0] for r in c.pixels.collect()) == [1234, 5678]
    with pytest.raises(FileFormatError, match="'m' has 1 such as 'n.d.'"):
        tables.read_cohort(spark, written(tmp_path / "b.csv", "x,y,m\n1,1,2.5\n2,2,n.d."))
    with pytest.raises(FileFormatError):
        tables.read_cohort(spark, written(tmp_path / "c.doc", "x"))
    with pytest.raises(FileNotFoundError):
        tables.read_cohort(spark, str(tmp_path / "none.csv"))
    with pytest.raises(AnalysisError):
        tables.read_cohort(spark, written(tmp_path / "d.csv", "a,b,m\n1,1,2.5\n2,2,3.5"))


def test_folder_pairs_regions(spark, tmp_path):
    head = "x,y,a,b\n"
    written(tmp_path / "s1_tissue.csv", head + "\n".join(f"{i},{i},{i}.5,1.5" for i in range(5)))
    written(tmp_path / "s1_bg.csv", "x,y,a,c\n" + "\n".join(f"{i},{i},0.5,2.5" for i in range(3)))
    written(tmp_path / "other.csv", head + "1,2,3.5,4.5\n2,2,3.5,4.5")
    found = tables.load_from_folder(spark, str(tmp_path))
    assert set(found) == {"s1", "other"} and found["s1"].names == ("a", "b", "c")
    assert found["s1"].pixels.groupBy("is_tissue").count().orderBy("is_tissue").collect()[0][1] == 3
    filters.check_rois([found["s1"]])
    with pytest.raises(MissingRegionError):
        filters.check_rois([found["other"]])
    kept, _ = filters.filter_background(found["s1"], 1.5)
    assert kept["all"].names == ("a", "b")


def test_stored_cohorts(spark, tmp_path):
    c = nested(spark, n=1).describe_features("score", [0.5] * 29 + [None]).record("step", {"k": 1})
    paths = tables.save_spatial_data([c], str(tmp_path), "sec")
    back = tables.load_cohort(spark, paths[0])
    assert back.names == c.names and back.about == c.about and back.provenance()[0]["step"] == "step"
    assert manifest.data_fingerprint(back)["values_sha256"] == manifest.data_fingerprint(c)["values_sha256"]
    assert filters.filter_by_score(back, 0.3).names == c.names[:29]
    scores = spark.createDataFrame([("m001", 0.9), ("m001", 0.2), ("zzz", 0.6)], "Compound string, `Identification Score` double")
    assert tables.load_annotation_scores(c, scores.coalesce(1)).about["score"][:3] == (None, 0.2, None)


def test_drugs(spark, tmp_path):
    path = str(tmp_path / "v.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE drug_compounds(name TEXT)")
        db.execute("CREATE TABLE drug_synonyms(synonym TEXT)")
        db.executemany("INSERT INTO drug_compounds VALUES (?)", [("Aspirin",), ("Taurine",)])
        db.execute("INSERT INTO drug_synonyms VALUES ('ASA ')")
    words = pathways.drug_vocabulary(spark, path)
    c = cohort_of(spark, ["s"], [0], [0], [[1, 2, 3, 4]], ["aspirin ", "Taurine", "asa", "Alanine"])
    matches = {r.metabolite: r.endogenous for r in filters.drug_matches(c.features(), words).collect()}
    assert matches == {"aspirin ": False, "Taurine": True, "asa": False}
    with pytest.warns(UserWarning, match="tissue makes"):
        assert filters.filter_drugs(c, words, remove_all=True).names == ("Alanine",)
    with pytest.warns(UserWarning, match="Not in the panel"):
        assert filters.filter_drugs(c, drug_names=["ASA", "none"]).names == ("aspirin ", "Taurine", "Alanine")
    labels = spark.createDataFrame([("Aspirin", "ASAcid"), ("Q123", "bad"), ("abc", "x"), ("Codeine", "Aspirin")], "name string, synonym string")
    names, synonyms = pathways.build_vocabulary(labels)
    assert {r.name for r in names.collect()} == {"Aspirin", "Codeine"} and {r.synonym for r in synonyms.collect()} == {"ASAcid"}


def test_pathway_tables(spark, tmp_path, monkeypatch):
    lines = ["AMetabolism", "B  Global and overview maps", "C    01100  All", "B  Amino acid", "C    00330  Arg", "AHuman Diseases", "B  Cancer", "C    05200  Cancer", "AMetabolism", "C    00480  GSH"]
    tree = spark.createDataFrame(list(enumerate(lines)), "line_no int, value string")
    kept = pathways.metabolic_pathways(tree)
    assert {r.pathway for r in kept.collect()} == {"map00330", "map00480"}
    links = spark.createDataFrame([("cpd:C1", "path:map00330"), ("cpd:C2", "path:map05200"), ("cpd:C1", "path:ko00330"), ("cpd:C3", "path:map00480")], "compound string, pathway string")
    names = spark.createDataFrame([("map00330", "Arg")], "pathway string, name string")
    assert {tuple(r) for r in pathways.pathway_sets(links, names, kept).collect()} == {("Arg", "C1"), ("map00480", "C3")}
    monkeypatch.setenv("HISTOMILL_CACHE", str(tmp_path))
    calls = []
    answer = lambda batch: calls.append(batch) or json.dumps({"Query": list(batch), "KEGG": ["C1", None], "HMDB": [None, None]})
    for _ in range(2):
        rows = pathways.fetch_mapping(spark, ["a", "b"], answer).collect()
    assert len(calls) == 1 and [(r.query, r.kegg) for r in rows] == [("a", "C1"), ("b", None)] and pathways.clear_cache() == 1
    ids = pathways.map_compound_ids(spark.createDataFrame([("a",), ("z",)], "metabolite string"), spark.createDataFrame([(r.query, r.kegg) for r in rows], "query string, kegg string")).collect()
    assert [(r.query, r.matched) for r in ids] == [("a", True), ("z", False)]


def test_manifest_and_tampering(spark, tmp_path):
    c = nested(spark, n=2)
    result = difference.differential_abundance(samples.pseudobulk(c, "section"), "response", "R", "NR", min_samples=2)
    path = manifest.export_manifest(str(tmp_path / "m"), c, {"da": result})
    assert path.endswith("m.json")
    status = lambda **k: {r.check: r.status for r in manifest.verify_manifest(spark, path, **k).collect()}
    good = status(cohort=c.with_pixels(c.pixels.repartition(3)), results={"da": result})
    assert set(good.values()) == {"pass"} and status()["data"] == "skipped"
    assert status(cohort=c.select_features(range(29)))["data.values_sha256"] == "fail"
    changed = status(results={"da": result.withColumn("delta", F.col("delta") + 0.001)})
    assert changed["results.da"] == "fail"
    document = json.load(open(path))
    document["notes"] = "better"
    json.dump(document, open(path, "w"))
    with pytest.raises(FileFormatError):
        manifest.verify_manifest(spark, path)


def test_command_line(spark, tmp_path, capsys):
    c = planted(spark, 3, 1)
    c = c.with_pixels(c.pixels.withColumn("patient", F.col("section")))
    tables.save_cohort(c, str(tmp_path / "data"))
    config = tmp_path / "c.yaml"
    config.write_text(f"input:\n  path: {tmp_path}/data\noutput:\n  dir: {tmp_path}/out\nanalysis:\n  organization_metrics: [morans_i]\n")
    results = cli.run(spark, cli.load_config(str(config)))
    assert {"differential_abundance", "differential_morans_i", "two_axis", "class_enrichment"} <= set(results)
    assert {"differential_abundance.csv", "two_axis.csv", "manifest.json"} <= set(os.listdir(tmp_path / "out"))
    config.write_text("analysis:\n  organisation: true\n")
    with pytest.raises(InvalidParameterError, match="Did you mean 'organization'"):
        cli.load_config(str(config))
    assert cli.main(["template"]) == 0 and "sample_key" in capsys.readouterr().out


def test_running_profiles(spark, tmp_path):
    c = nested(spark, n=1)
    c.pixels.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = ingest.running_pseudobulk(ingest.pixel_stream(spark, str(tmp_path / "in"), c.pixels.schema, 1))
    q = stream.writeStream.format("memory").queryName("profiles").outputMode("complete").start()
    try:
        q.processAllAvailable()
        got = {(r.sample, r.feature_idx): r["mean"] for r in spark.table("profiles").collect()}
    finally:
        q.stop()
    want = samples.pseudobulk(c, "section").values.collect()
    assert all(got[r.sample, c.names.index(r.metabolite)] == pytest.approx(r.value) for r in want)


def test_figures(spark):
    c = nested(spark, n=2)
    c = c.with_pixels(c.pixels.withColumns({"is_tissue": F.col("response") == "R", "is_background": F.col("response") == "NR", "cluster": F.col("patient")}))
    assert figures.qc_fold_changes(c).agg(F.sum("n")).first()[0] == 30
    assert figures.spatial_map(c, "m001").count() == 160 and figures.marker_violin(c, "response", "m001").count() == 160
    result = difference.differential_abundance(samples.pseudobulk(c, "section"), "response", "R", "NR", min_samples=2)
    assert figures.volcano(result).count() == 30 and figures.effect_forest(result, 5).count() == 5
    bulk = samples.pseudobulk(c, "section")
    assert figures.organization_matrix(bulk.values, bulk.samples, "response", 3, result).count() == 12
    assert np.isclose(figures.composition(c, "response").agg(F.sum("percent")).first()[0], 200)


def test_pathways_of_a_result(spark):
    from histomill.operators import annotate

    result = spark.createDataFrame([(f"n{i}", 0.9 if i < 4 else 0.0) for i in range(20)], "metabolite string, delta double")
    ids = spark.createDataFrame([(f"n{i}", f"C{i}" if i < 18 else None) for i in range(20)], "query string, kegg string")
    links = spark.createDataFrame([(f"c{i}", "map1" if i < 4 else "map2") for i in range(18)], "compound string, pathway string")
    names = spark.createDataFrame([("map1", "first")], "pathway string, name string")
    rows = annotate.annotate_pathways(result, ids, links, names).collect()
    assert [(r.pathway, r.direction, r.n_hits) for r in rows] == [("first", "any", 4), ("first", "up", 4)] and rows[0].pval < 0.001
    with pytest.raises(InvalidParameterError):
        annotate.annotate_pathways(result, ids.where("kegg is null"), links, names)
