"""Command line: run a configured analysis, write a template, verify a manifest."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from histomill import manifest
from histomill.errors import AnalysisError, InvalidParameterError, listing, require_column
from histomill.operators import annotate, difference, filters, samples, spatial, transform
from histomill.sources import pathways, tables

DEFAULTS: dict = {
    "input": {"path": "./data", "sample_key": "patient", "section_key": "section", "group_key": "response", "groups": ["R", "NR"]},
    "preprocess": {"filter_background": False, "background_cutoff": 1.5, "min_annotation_score": 0.0, "remove_drugs": False, "drug_vocabulary": None, "normalize": "tic", "log1p": True},
    "analysis": {
        "abundance": True,
        "organization": True,
        "organization_metrics": ["morans_i", "entropy", "gini"],
        "classify_compounds": True,
        "pathways": False,
        "pathway_tables": None,
        "bootstrap": 0,
    },
    "output": {"dir": "./results", "manifest": True},
    "runtime": {"seed": 0},
}


def template() -> str:
    import yaml

    return "# Analysis configuration; every key may be left out.\n" + yaml.safe_dump(DEFAULTS, sort_keys=False)


def load_config(path: str) -> dict:
    """The file's settings over the defaults. Unknown keys are refused."""
    import yaml

    if not os.path.exists(path):
        raise InvalidParameterError(f"There is no configuration '{path}'.")
    with open(path, encoding="utf-8") as f:
        given = yaml.safe_load(f) or {}
    if not isinstance(given, dict):
        raise InvalidParameterError(f"'{path}' is no configuration.")
    out = {k: dict(v) for k, v in DEFAULTS.items()}
    for part, settings in given.items():
        require_column(DEFAULTS, part)
        for key, value in (settings or {}).items():
            require_column(DEFAULTS[part], key)
            if value is not None:
                out[part][key] = value
    return out


def run(spark: SparkSession, config: dict) -> dict:
    """The whole analysis; the result tables by name."""
    source, prepare, analysis, output = config["input"], config["preprocess"], config["analysis"], config["output"]
    path = source["path"]
    if os.path.splitext(path)[1] or os.path.exists(os.path.join(path, "meta.json")):
        cohort = tables.read_cohort(spark, path)
    else:
        found = tables.load_from_folder(spark, path)
        if not found:
            raise InvalidParameterError(f"'{path}' has nothing that is read.")
        cohort = filters.merge_samples(list(found.values()), list(found), source["sample_key"]) if len(found) > 1 else next(iter(found.values()))
    for key in ("sample_key", "section_key", "group_key"):
        require_column(cohort.pixels.columns, source[key])
    if prepare["filter_background"]:
        kept, _ = filters.filter_background(cohort, prepare["background_cutoff"])
        if "all" not in kept:
            raise InvalidParameterError("No feature exceeds the background.")
        cohort = kept["all"]
    if prepare["min_annotation_score"]:
        cohort = filters.filter_by_score(cohort, prepare["min_annotation_score"])
    if prepare["remove_drugs"]:
        cohort = filters.filter_drugs(cohort, pathways.drug_vocabulary(spark, prepare["drug_vocabulary"]), remove_all=True)
    ways = {"tic": transform.tic_normalize, "median": transform.median_normalize, "none": lambda c: c}
    require_column(ways, prepare["normalize"])
    cohort = ways[prepare["normalize"]](cohort)
    cohort = transform.log1p_transform(cohort) if prepare["log1p"] else cohort
    cohort = cohort.record("run", {"config": config})
    group, (one, two) = source["group_key"], source["groups"]
    results = {}
    if analysis["abundance"] or analysis["organization"]:
        profiles = samples.pseudobulk(cohort, source["sample_key"])
        results["differential_abundance"] = difference.differential_abundance(profiles, group, one, two, bootstrap=analysis["bootstrap"], random_state=config["runtime"]["seed"])
        results["sample_profiles"] = profiles.values.orderBy("sample", "metabolite")
    if analysis["organization"]:
        arrangement = spatial.spatial_organization(cohort, source["section_key"], analysis["organization_metrics"])
        for metric in analysis["organization_metrics"]:
            results[f"differential_{metric}"] = difference.differential_spatial_organization(arrangement, group, one, two, metric)
        first = results[f"differential_{analysis['organization_metrics'][0]}"]
        results["two_axis"] = difference.compare_abundance_and_organization(results["differential_abundance"], first)
    if analysis["classify_compounds"] and "differential_abundance" in results:
        cohort = annotate.classify_compounds(cohort)
        results["class_enrichment"] = annotate.class_enrichment(results["differential_abundance"], cohort.features())
    if analysis["pathways"]:
        given = analysis["pathway_tables"]
        if not given:
            raise InvalidParameterError("Pathways need pathway_tables: a folder with mapping, links and names as Parquet.")
        read = lambda n: spark.read.parquet(f"{given}/{n}")
        ids = pathways.map_compound_ids(cohort.features(), read("mapping"))
        results["pathways"] = annotate.annotate_pathways(results["differential_abundance"], ids, read("links"), read("names"))
    os.makedirs(output["dir"], exist_ok=True)
    for name, table in results.items():
        tables.save_results(table, os.path.join(output["dir"], f"{name}.csv"))
    if output["manifest"]:
        manifest.export_manifest(os.path.join(output["dir"], "manifest.json"), cohort, {k: v for k, v in results.items() if k != "sample_profiles"})
    return results


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="histomill", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("run", help="run an analysis").add_argument("config")
    commands.add_parser("template", help="print a configuration")
    commands.add_parser("verify", help="verify a manifest").add_argument("manifest")
    commands.add_parser("info", help="print versions")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "template":
        print(template(), end="")
        return 0
    spark = SparkSession.builder.appName("histomill").getOrCreate()
    try:
        if args.command == "info":
            print(manifest.environment(spark))
        elif args.command == "verify":
            rows = manifest.verify_manifest(spark, args.manifest).collect()
            print("\n".join(f"{r.status:8} {r.check} {r.detail}" for r in rows))
            return int(any(r.status == "fail" for r in rows))
        else:
            print("Wrote " + listing(run(spark, load_config(args.config)), 20) + ".")
    except AnalysisError as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
