"""Compound identifiers, pathway tables and drug vocabularies."""

from __future__ import annotations

import hashlib
import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from histomill.errors import InvalidParameterError, NetworkError

IDENTIFIERS = ("hmdb", "kegg", "pubchem", "chebi", "metlin", "smiles")
BATCH_NAMES = 200
WAIT_S = 1.5


def cache_dir() -> str:
    path = os.environ.get("HISTOMILL_CACHE") or os.path.join(os.path.expanduser("~"), ".cache", "histomill")
    os.makedirs(path, exist_ok=True)
    return path


def cache_path(key: str) -> str:
    """A request's file: its name is the digest of the request, so that it is found again."""
    return os.path.join(cache_dir(), hashlib.sha256(key.encode()).hexdigest() + ".txt")


def clear_cache() -> int:
    """Delete all cached answers; how many there were."""
    files = [f for f in os.listdir(cache_dir()) if f.endswith(".txt")]
    for f in files:
        os.remove(os.path.join(cache_dir(), f))
    return len(files)


def request(url: str, data: bytes | None = None, timeout: float = 30, retries: int = 3, opener: Callable | None = None) -> str:
    """A service's answer; waits longer after every failure."""
    opener = opener or urllib.request.urlopen
    for attempt in range(1, retries + 1):
        try:
            with opener(urllib.request.Request(url, data), timeout=timeout) as answer:
                return answer.read().decode()
        except (urllib.error.URLError, OSError) as e:
            if attempt == retries:
                raise NetworkError(f"{url} did not answer in {retries} attempts: {e}") from e
            time.sleep(WAIT_S * attempt)
    raise NetworkError(url)


def cached(key: str, fetch: Callable[[], str], use: bool = True) -> str:
    path = cache_path(key)
    if use and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            return f.read()
    text = fetch()
    if use:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    return text


def map_compound_ids(names: DataFrame, mapping: DataFrame) -> DataFrame:
    """``query``, the identifiers, and ``matched`` for every name (column ``metabolite``) from a
    mapping table (``query`` or ``match`` and identifiers). Names without an entry stay."""
    have = [c for c in IDENTIFIERS if c in mapping.columns]
    blank = lambda c: F.when(~F.upper(F.trim(F.col(c).cast("string"))).isin("", "NA", "NAN"), F.trim(F.col(c).cast("string")))
    rows = mapping.select(F.lower(F.trim("query")).alias("_q"), *[blank(c).alias(c) for c in have]).groupBy("_q").agg(*[F.max(c).alias(c) for c in have])
    out = names.select(F.col("metabolite").alias("query")).distinct().join(rows, F.lower(F.trim("query")) == F.col("_q"), "left").drop("_q")
    lacking = [F.lit(None).cast("string").alias(c) for c in IDENTIFIERS if c not in have]
    out = out.select("*", *lacking)
    return out.select("query", *IDENTIFIERS, (F.col("hmdb").isNotNull() | F.col("kegg").isNotNull()).alias("matched")).orderBy("query")


def fetch_mapping(spark: SparkSession, names: Sequence[str], post: Callable[[Sequence[str]], str]) -> DataFrame:
    """A mapping table from a service: ``post`` answers a batch of names with a JSON object of
    lists. Answers are cached by batch."""
    rows: list[dict] = []
    for at in range(0, len(names), BATCH_NAMES):
        batch = list(names[at : at + BATCH_NAMES])
        answer = json.loads(cached("map\x1f" + "\x1f".join(batch), lambda b=batch: post(b)))
        columns = {k.lower(): v for k, v in answer.items() if isinstance(v, list)}
        size = max(map(len, columns.values()), default=0)
        rows += [{k: (None if i >= len(v) or v[i] is None else str(v[i])) for k, v in columns.items()} for i in range(size)]
    fields = ["query", *IDENTIFIERS]
    return spark.createDataFrame([tuple(r.get(c) for c in fields) for r in rows], ", ".join(f"{c} string" for c in fields))


def metabolic_pathways(hierarchy: DataFrame) -> DataFrame:
    """``pathway`` ids (``map...``) under the heading of metabolism, without global maps, from the
    numbered lines (``line_no, value``) of a hierarchy text: headings are carried down."""
    mark, rest = F.substring("value", 1, 1), F.trim(F.substring("value", 2, 1 << 20))
    order = Window.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)  # one text of some hundred lines
    top = F.last(F.when(mark == "A", F.struct(F.col("line_no"), rest.alias("t"))), ignorenulls=True).over(order)
    sub = F.last(F.when(mark == "B", F.struct(F.col("line_no"), rest.alias("t"))), ignorenulls=True).over(order)
    lines = hierarchy.where(F.trim("value") != "").select(mark.alias("mark"), rest.alias("rest"), top.alias("top"), sub.alias("sub"))
    under = F.when(F.col("sub.line_no") > F.col("top.line_no"), F.col("sub.t")).otherwise("")
    kept = lines.where((F.col("mark") == "C") & (F.col("rest") != "") & F.lower("top.t").startswith("metabolism") & ~F.lower(F.coalesce(under, F.lit(""))).contains("global and overview"))
    return kept.select(F.concat(F.lit("map"), F.regexp_extract("rest", r"^(\S+)", 1)).alias("pathway")).distinct()


def pathway_sets(links: DataFrame, names: DataFrame, metabolic: DataFrame | None = None, compounds: DataFrame | None = None) -> DataFrame:
    """``set_name, member`` from ``links(compound, pathway)`` and ``names(pathway, name)``, prefixes
    like ``path:`` going; only ``map`` pathways, those of ``metabolic``, and ``compounds(kegg)``."""
    bare = lambda c: F.regexp_replace(F.col(c), r"^\w+:", "")
    rows = links.select(bare("compound").alias("member"), bare("pathway").alias("pathway")).where(F.col("pathway").startswith("map"))
    if metabolic is not None:
        rows = rows.join(metabolic, "pathway", "left_semi")
    if compounds is not None:
        rows = rows.join(compounds.select(F.upper("kegg").alias("_k")), F.upper("member") == F.col("_k"), "left_semi")
    named = names.select(bare("pathway").alias("pathway"), "name")
    return rows.join(named, "pathway", "left").select(F.coalesce("name", "pathway").alias("set_name"), "member").distinct()


def drug_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """``name``: names and synonyms of a vocabulary, folded. A folder has the tables
    ``drug_compounds`` and ``drug_synonyms``; a ``.db`` file has them in SQLite; any other file is
    a table with a column ``name``."""
    if path.endswith(".db"):
        import sqlite3

        if not os.path.exists(path):
            raise FileNotFoundError(path)
        with sqlite3.connect(path) as db:
            rows = db.execute("SELECT name FROM drug_compounds UNION SELECT synonym FROM drug_synonyms").fetchall()
        return vocabulary(spark.createDataFrame(rows, "name string"))
    if path.endswith(".csv"):
        return vocabulary(spark.read.csv(path, header=True).select("name"))
    if path.endswith(".parquet"):
        return vocabulary(spark.read.parquet(path).select("name"))
    compounds = spark.read.parquet(f"{path}/drug_compounds").select("name")
    return vocabulary(compounds, spark.read.parquet(f"{path}/drug_synonyms").select("synonym"))


def vocabulary(compounds: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    names = compounds.select("name") if synonyms is None else compounds.select("name").union(synonyms.select("synonym"))
    return names.select(F.lower(F.trim("name")).alias("name")).where("name IS NOT NULL AND name <> ''").distinct()


def build_vocabulary(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(drug_compounds, drug_synonyms)`` of ``labels(name, synonym)``: names of 4 to 119
    characters that are no item numbers, and synonyms that are no names."""
    fit = lambda c: F.length(c).between(4, 119) & ~F.col(c).startswith("Q")
    names = labels.select("name").where(fit("name")).distinct()
    synonyms = labels.where(fit("name") & F.length("synonym").between(4, 119)).select("synonym").distinct()
    return names, synonyms.join(names, F.lower("synonym") == F.lower("name"), "left_anti")


def require_vocabulary(table: DataFrame | None) -> DataFrame:
    if table is None:
        raise InvalidParameterError("No drug vocabulary is bundled; give one.")
    return table
