"""Readers and writers of cohorts."""

from __future__ import annotations

import csv
import json
import os
import re
import warnings
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histomill.errors import FileFormatError, InvalidParameterError, MissingSpatialError, listing, require_column
from histomill.model import STRUCTURAL, Cohort

# Names that exporters give to coordinates, and suffixes that are read.
X_ALIASES = ("x", "x_pos", "xpos", "x_coord", "column", "col")
Y_ALIASES = ("y", "y_pos", "ypos", "y_coord", "row")
TEXT_SUFFIXES = (".csv", ".tsv", ".txt")
SUFFIXES = (*TEXT_SUFFIXES, ".parquet", ".pq", ".xlsx", ".xlsm", ".xls", ".rds", ".rda", ".h5ad")
SEPARATORS = (",", ";", "\t", "|")
SNIFFED_BYTES, SAMPLED_ROWS = 65_536, 400


def coordinate_names(columns: Sequence[str]) -> dict[str, str]:
    """Renamings that give a table ``x`` and ``y``."""
    names, out = {c.lower(): c for c in columns}, {}
    for target, aliases in (("x", X_ALIASES), ("y", Y_ALIASES)):
        if target not in columns and (found := next((names[a] for a in aliases if a in names and names[a] not in out), None)):
            out[found] = target
    return out


def _width(line: str, separator: str) -> int:
    """Number of a row's fields."""
    return sum(1 for _ in next(csv.reader([line], delimiter=separator)))


def sniff_delimiter(head: str) -> str:
    """The separator of a text table: what the csv module recognises, or else the one that cuts
    the header and the first row into equally many fields, the most of all."""
    try:
        known = csv.Sniffer().sniff(head, delimiters="".join(SEPARATORS))
    except csv.Error:
        header, row = ([*filter(str.strip, head.splitlines()), "", ""])[:2]
        widths = [(_width(header, s), s) for s in SEPARATORS if header and s in header and (not row or _width(header, s) == _width(row, s))]
        if not widths:
            raise FileFormatError(f"No separator of {listing(map(repr, SEPARATORS))} gives equal rows.") from None
        return max(widths, key=lambda w: w[0])[1]
    return known.delimiter


def number_format(tokens: Sequence[str]) -> tuple[str, str | None, bool]:
    """``(decimal mark, thousands mark, sure)`` of numbers as text.

    A token with both marks has its decimal mark last. A mark that repeats in a token groups
    thousands, and one before other than three digits is a decimal mark. If all tokens look
    like ``1.234`` they are read as grouped, which is not sure."""
    grouped = {".": 0, ",": 0}
    decimal = {".": 0, ",": 0}
    other = {".": ",", ",": "."}
    for t in tokens:
        marks = [m for m in ".," if m in t]
        if len(marks) == 2:
            last = max(".,", key=t.rfind)
            return last, other[last], True
        if not marks:
            continue
        mark = marks[0]
        if not re.fullmatch(rf"[+-]?\d{{1,3}}(?:{re.escape(mark)}\d{{3}})+", t.strip()):
            decimal[mark] += 1
        elif t.count(mark) > 1:
            return other[mark], mark, True
        else:
            grouped[mark] += 1
    used = [m for m in ".," if grouped[m] + decimal[m]]
    if len(used) == 1:
        return (used[0], None, True) if decimal[used[0]] else (other[used[0]], used[0], False)
    return ".", None, True


def read_text_table(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """A delimited file with every column as text, numbers in plain notation."""
    lines = spark.read.text(path).limit(SAMPLED_ROWS + 1)
    head = "\n".join(r.value for r in lines.collect())[:SNIFFED_BYTES]
    table = spark.read.csv(path, sep=sep or sniff_delimiter(head), header=True, inferSchema=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    table = table.withColumnsRenamed(coordinate_names(table.columns))
    measured = [c for c in table.columns if c not in ("x", "y")]
    sample = table.select(*[F.col(f"`{c}`") for c in measured]).limit(SAMPLED_ROWS).collect()
    tokens = [v for row in sample for v in row if v and not re.fullmatch(r"[+-]?\d+", v.strip()) and re.search(r"\d", v)]
    decimal, thousands, sure = number_format(tokens)
    if not sure:
        warnings.warn(f"Numbers like {tokens[0]} can be read in two ways; '{thousands}' is taken to group thousands.", stacklevel=2)

    def plain(c: str):
        v = F.col(f"`{c}`")
        v = F.replace(v, F.lit(thousands), F.lit("")) if thousands else v
        return (F.replace(v, F.lit(decimal), F.lit(".")) if decimal != "." else v).alias(c)

    return table.select(*[plain(c) for c in table.columns])


def numbers(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as doubles: blank is 0, text that is no number is an error that names the
    worst columns."""
    cast = {c: F.col(f"`{c}`").try_cast("double") for c in columns}
    text = [c for c in columns if dict(table.dtypes)[c] == "string"]
    if text:
        bad = lambda c: cast[c].isNull() & (F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))) != "")
        found = table.agg(*[F.struct(F.count_if(bad(c)).alias("n"), F.max(F.when(bad(c), F.col(f"`{c}`"))).alias("e")).alias(f"c{i}") for i, c in enumerate(text)]).first()
        worst = sorted(((found[i].n, c, found[i].e) for i, c in enumerate(text) if found[i].n), reverse=True)[:3]
        if worst:
            raise FileFormatError("Not numbers: " + "; ".join(f"'{c}' has {n} such as {e!r}" for n, c, e in worst) + ".")
    return table.withColumns({c: F.coalesce(v, F.lit(0.0)) for c, v in cast.items()})


def from_dataframe(table: DataFrame, x: str = "x", y: str = "y", sample: str | None = None, obs: Sequence[str] = ()) -> Cohort:
    """A cohort of a wide table: every column but coordinates and ``obs`` is a feature. Pixels are
    named ``x_y``."""
    for c in (x, y):
        require_column(table.columns, c, MissingSpatialError)
    table = table.withColumnsRenamed({x: "x", y: "y"})
    names = [c for c in table.columns if c not in ("x", "y", *obs)]
    if not names:
        raise FileFormatError("The table has coordinates only.")
    table = numbers(table, [*names, "x", "y"])
    whole = lambda c: F.col(c).cast("long").cast("string")
    pixels = table.select(
        F.lit(sample or "").alias("section"), F.concat_ws("_", whole("x"), whole("y")).alias("pixel_id"), "x", "y", *obs,
        *([F.lit(sample).alias("sample")] if sample else []), F.array(*[F.col(f"`{c}`") for c in names]).alias("values"),
    )
    return Cohort(pixels, tuple(names))


def read_cohort(spark: SparkSession, path: str) -> Cohort:
    """A cohort from a table or a stored cohort, by suffix."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if not suffix and _exists(spark, f"{path.rstrip('/')}/meta.json"):
        return load_cohort(spark, path)
    if suffix not in SUFFIXES:
        raise FileFormatError(f"'{suffix}' is none of the suffixes that are read: {listing(SUFFIXES, 12)}.")
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    if suffix in TEXT_SUFFIXES:
        table = read_text_table(spark, path)
    elif suffix in (".parquet", ".pq"):
        table = spark.read.parquet(path)
    elif suffix in (".xlsx", ".xlsm", ".xls"):
        import pandas as pd

        try:
            table = spark.createDataFrame(pd.read_excel(path))
        except ImportError as e:
            raise ImportError("Reading workbooks needs openpyxl or python-calamine; or save the sheet as csv.") from e
    elif suffix == ".h5ad":
        return _read_h5ad(spark, path)
    else:
        table = _read_rds(spark, path)
    table = table.withColumnsRenamed(coordinate_names(table.columns))
    made = from_dataframe(table)
    return replace(made, about={}).record("read", {"source_file": os.path.basename(path)})


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _listed(spark: SparkSession, folder: str) -> list[str]:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(target):
        raise FileNotFoundError(folder)
    return sorted(s.getPath().getName() for s in files.listStatus(target))


def _read_rds(spark: SparkSession, path: str) -> DataFrame:
    try:
        import pyreadr
    except ImportError as e:
        raise ImportError("Reading R files needs pyreadr; or save the data frame as csv.") from e
    frames = list(pyreadr.read_r(path).values())
    if not frames:
        raise FileFormatError(f"'{path}' has no data frame.")
    return spark.createDataFrame(frames[0])


def _read_h5ad(spark: SparkSession, path: str) -> Cohort:
    try:
        import anndata
    except ImportError as e:
        raise ImportError("Reading h5ad files needs anndata; or convert the file to a Parquet table.") from e
    held = anndata.read_h5ad(path)
    frame = held.to_df()
    if "spatial" in held.obsm:
        frame["x"], frame["y"] = held.obsm["spatial"][:, 0], held.obsm["spatial"][:, 1]
    elif {"x", "y"} <= set(held.obs.columns):
        frame["x"], frame["y"] = held.obs["x"], held.obs["y"]
    else:
        raise FileFormatError(f"'{path}' has no coordinates.")
    obs = [c for c in held.obs.columns if c not in frame.columns]
    for c in obs:
        frame[c] = held.obs[c].to_numpy()
    return from_dataframe(spark.createDataFrame(frame), obs=obs).record("read", {"source_file": os.path.basename(path)})


def region_of(stem: str) -> str:
    """``tissue``, ``background`` or ``unknown`` by the words of a file's name."""
    for region, words in (("tissue", "tissue"), ("background", "background|bg")):
        if re.search(rf"(^|[_-])({words})([_-]|$)", stem.lower()):
            return region
    return "unknown"


def pair_name(stem: str) -> str:
    """A file's name without the words for regions."""
    return re.sub(r"[_-]?(tissue|background|bg)[_-]?", "", stem.lower()).strip("_-")


def load_from_folder(spark: SparkSession, folder: str) -> dict[str, Cohort]:
    """Cohorts of a folder by name; tables of tissue and background of one name become one
    cohort with region columns, features that one lacks being 0 there."""
    from histomill.operators.filters import merge_samples

    files = {f: os.path.splitext(f) for f in _listed(spark, folder)}
    files = {f: (stem, s.lower()) for f, (stem, s) in files.items() if s.lower() in SUFFIXES}
    if not files:
        warnings.warn(f"'{folder}' has no file with one of the suffixes {listing(SUFFIXES, 12)}.", stacklevel=2)
    groups: dict[str, dict[str, str]] = {}
    out = {}
    for f, (stem, _) in files.items():
        region = region_of(stem)
        if region == "unknown":
            out[stem] = read_cohort(spark, f"{folder}/{f}")
        else:
            first = groups.setdefault(pair_name(stem), {}).setdefault(region, f)
            if first != f:
                raise FileFormatError(f"'{first}' and '{f}' are both the {region} of '{pair_name(stem)}'.")
    for name, pair in groups.items():
        if len(pair) < 2:
            out |= {os.path.splitext(f)[0]: read_cohort(spark, f"{folder}/{f}") for f in pair.values()}
            continue
        parts = []
        for region in ("tissue", "background"):
            c = read_cohort(spark, f"{folder}/{pair[region]}")
            parts.append(c.with_pixels(c.pixels.withColumns({"is_tissue": F.lit(region == "tissue"), "is_background": F.lit(region == "background")})))
        merged = merge_samples(parts, ["tissue", "background"], "_region")
        out[name] = merged.with_pixels(merged.pixels.drop("_region").withColumn("section", F.lit(name)))
    return out


def load_annotation_scores(cohort: Cohort, table: DataFrame, compound_col: str = "Compound", score_col: str = "Identification Score", target: str = "score", order_col: str | None = None) -> Cohort:
    """Annotation scores about the features, by exact name. Of several rows of a name the last
    holds: by ``order_col``, or in the table's order."""
    for c in (compound_col, score_col):
        require_column(table.columns, c)
    place = F.col(f"`{order_col}`") if order_col else F.monotonically_increasing_id()
    rows = table.select(F.col(f"`{compound_col}`").alias("metabolite"), F.col(f"`{score_col}`").cast("double").alias("s"), place.alias("o"))
    last = rows.join(F.broadcast(cohort.features().select("metabolite")), "metabolite", "left_semi").groupBy("metabolite").agg(F.max_by("s", "o").alias("s"))
    found = {r.metabolite: r.s for r in last.collect()}
    return cohort.describe_features(target, [found.get(n) for n in cohort.names])


def save_cohort(cohort: Cohort, path: str, overwrite: bool = False) -> None:
    """Write ``pixels``, ``features`` and ``meta.json``."""
    mode = "overwrite" if overwrite else "errorifexists"
    cohort.pixels.write.mode(mode).partitionBy("section").parquet(f"{path}/pixels")
    cohort.features().coalesce(1).write.mode(mode).parquet(f"{path}/features")
    meta = json.dumps({"names": cohort.names, "about": cohort.about, "steps": cohort.steps})
    cohort.pixels.sparkSession.createDataFrame([(meta,)], "value string").coalesce(1).write.mode(mode).text(f"{path}/meta.json")


def load_cohort(spark: SparkSession, path: str) -> Cohort:
    """Read what :func:`save_cohort` wrote."""
    meta = json.loads(spark.read.text(f"{path}/meta.json").first().value)
    pixels = spark.read.parquet(f"{path}/pixels").withColumn("section", F.col("section").cast("string"))
    first = [c for c in STRUCTURAL if c in pixels.columns]
    pixels = pixels.select(*first, *[c for c in pixels.columns if c not in first])
    return Cohort(pixels, tuple(meta["names"]), {k: tuple(v) for k, v in meta["about"].items()}, tuple(meta["steps"]))


def save_spatial_data(cohorts: Sequence[Cohort], folder: str, prefix: str = "section") -> list[str]:
    """Write cohorts as ``<prefix>_1``, ``<prefix>_2`` and so on."""
    paths = [f"{folder.rstrip('/')}/{prefix}_{i}" for i in range(1, len(cohorts) + 1)]
    for cohort, path in zip(cohorts, paths, strict=True):
        save_cohort(cohort, path)
    return paths


def save_results(table: DataFrame, path: str) -> None:
    """A result table as one csv file with header. Results have a row a feature or a pair of
    groups, so they are written by the driver."""
    if not path.endswith(".csv"):
        raise InvalidParameterError("Results are written as .csv.")
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", newline="", encoding="utf-8") as out:
        writer = csv.writer(out)
        writer.writerow(table.columns)
        writer.writerows(tuple("" if v is None else v for v in row) for row in table.toLocalIterator())


def load_image(path: str):
    """A TIFF, PNG or NumPy image as float32 in [0, 1]."""
    import numpy as np

    from histomill.operators.image import scaled_image

    if path.endswith(".npy"):
        return scaled_image(np.load(path))
    try:
        from PIL import Image
    except ImportError as e:
        raise ImportError("Reading images needs Pillow; or save the array as .npy.") from e
    return scaled_image(np.asarray(Image.open(path)))
