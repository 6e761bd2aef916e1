"""Fingerprints and sealed manifests."""

from __future__ import annotations

import hashlib
import importlib.metadata
import json
import platform
import subprocess
from collections.abc import Mapping
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histomill.errors import FileFormatError
from histomill.model import VALUES, Cohort

MANIFEST_VERSION = 1
_UNIT, _RECORD = "\x1f", "\x1e"


def _digest(*parts: str) -> str:
    h = hashlib.sha256()
    for p in parts:
        h.update(p.encode())
        h.update(_RECORD.encode())
    return h.hexdigest()


def data_fingerprint(cohort: Cohort, layer: str | None = None) -> dict:
    """Shape, columns and digests of a cohort. Every pixel is digested where it lies, values
    rounded to 6 places; pixel digests are added up as four numbers, so neither the order of
    rows nor partitions matter."""
    column = layer or VALUES
    values = F.transform(column, lambda v: F.format_string("%.6f", F.when(F.round(v, 6) == 0, F.lit(0.0)).otherwise(F.round(v, 6))))
    line = F.concat_ws(_UNIT, F.coalesce(F.col("section").cast("string"), F.lit("")), F.col("pixel_id").cast("string"), F.array_join(values, _UNIT))
    hexed = F.sha2(line.cast("binary"), 256)
    part = lambda i: F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{i}")
    row = cohort.pixels.select(hexed.alias("h")).agg(F.count(F.lit(1)).alias("n"), *[part(i) for i in range(4)]).first()
    return {
        "n_pixels": row.n,
        "n_features": len(cohort.names),
        "observations": sorted(cohort.observations()),
        "features_sha256": _digest(_UNIT.join(cohort.names)),
        "values_sha256": _digest(*[str(row[f"s{i}"] or 0) for i in range(4)]),
        "scheme": 1,
    }


def result_fingerprint(table: DataFrame) -> dict:
    """Digest of a result: columns by name, numbers rounded to 6 places, rows in their order."""
    columns = sorted(table.columns)
    spell = lambda v: "" if v is None else f"{round(v, 6) + 0.0:.6f}" if isinstance(v, float) else str(v)
    lines = [_UNIT.join(spell(row[c]) for c in columns) for row in table.toLocalIterator()]  # results are small
    return {"n_rows": len(lines), "columns": columns, "sha256": _digest(_UNIT.join(columns), *lines)}


def environment(spark: SparkSession) -> dict:
    versions = {}
    for name in ("pyspark", "pyarrow", "pandas", "numpy"):
        try:
            versions[name] = importlib.metadata.version(name)
        except importlib.metadata.PackageNotFoundError:
            versions[name] = None
    try:
        commit = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, timeout=5).stdout.strip() or None
    except (OSError, subprocess.SubprocessError):
        commit = None
    java = spark.sparkContext._jvm.System.getProperty("java.version")
    return {"python": platform.python_version(), "java": java, "spark": spark.version, "packages": versions, "commit": commit}


def _seal(document: dict) -> str:
    return hashlib.sha256(json.dumps({k: v for k, v in document.items() if k != "seal"}, sort_keys=True).encode()).hexdigest()


def export_manifest(path: str, cohort: Cohort, results: Mapping[str, DataFrame] | None = None, notes: str = "") -> str:
    """Write a sealed manifest; its path, with ``.json`` at the end."""
    path = path if path.endswith(".json") else path + ".json"
    document = {
        "version": MANIFEST_VERSION,
        "created": datetime.now(UTC).isoformat(),
        "environment": environment(cohort.pixels.sparkSession),
        "data": data_fingerprint(cohort),
        "provenance": cohort.provenance(),
        "results": {k: result_fingerprint(v) for k, v in sorted((results or {}).items())},
        "notes": notes,
    }
    document["seal"] = _seal(document)
    with open(path, "w", encoding="utf-8") as out:
        json.dump(document, out, indent=2, sort_keys=True)
    return path


def verify_manifest(spark: SparkSession, path: str, cohort: Cohort | None = None, results: Mapping[str, DataFrame] | None = None, strict_environment: bool = False) -> DataFrame:
    """``check, status, detail``: whether data and results are those of a manifest."""
    with open(path, encoding="utf-8") as f:
        document = json.load(f)
    if document.get("seal") != _seal(document):
        raise FileFormatError(f"'{path}' was changed after it was sealed.")
    rows = [("seal", "pass", "")]
    now = environment(spark)
    for k, v in document["environment"].items():
        same = now.get(k) == v
        rows.append((f"environment.{k}", "pass" if same else "fail" if strict_environment else "info", "" if same else f"{v} then, {now.get(k)} now"))
    if cohort is None:
        rows.append(("data", "skipped", "no cohort given"))
    else:
        found = data_fingerprint(cohort)
        rows += [(f"data.{k}", "pass" if found.get(k) == v else "fail", "" if found.get(k) == v else f"{v} then, {found.get(k)} now") for k, v in document["data"].items()]
    for k, v in document["results"].items():
        if not results or k not in results:
            rows.append((f"results.{k}", "skipped", "no result given"))
        else:
            same = result_fingerprint(results[k]) == v
            rows.append((f"results.{k}", "pass" if same else "fail", "" if same else "the result differs"))
    return spark.createDataFrame(rows, "check string, status string, detail string")
