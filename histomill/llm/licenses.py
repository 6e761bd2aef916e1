"""License scans by canonical digest.

A text is brought to a canonical form: case and punctuation go, statements of copyright go,
equivalent spellings become one, white space collapses. The SHA-256 of the whole canonical text
is hash-joined to the digests of known licences. Documents also carry one-line notices, so
lines are texts of their own: those as long as some known text enter the same hash join.

The known licences are the texts of ``license_texts`` (see :func:`registry`) and ``NOTICES``.

Defined results: null or empty text, and one that is nothing but a statement of copyright, has the
digest of the empty string and no licence; a very long text is one text like any other; repeated
rows are looked up each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from histomill.llm.common import clashless, materialise, small_side

# Equivalent spellings, each pair (pattern, canonical form).
SPELLINGS = [
    (r"licence", "license"),
    (r"organis(ation|e|ing)", "organiz$1"),
    (r"per\s?cent|%", " percent "),
    (r"&", " and "),
    (r"https?://(?:www\.)?", ""),
    (r"copyright holders?|copyright owners?", "copyright holder"),
    (r"sub-?licens", "sublicens"),
    (r"merchantab[a-z]+", "merchantability"),
]
#: A statement of copyright: a sign or year, then whose it is, up to the words that begin a grant
#: or the end of the line; where the line goes on for long, up to the end of the sentence.
_WHOSE = r"(?:[^\n]{0,120}?(?=\b(?:permission is|permission to|redistribution and|licensed under|released under|everyone is|this (?:software|program|work|library|file|document|license)|all rights reserved)\b)|[^\n]{0,120}$|[^\n]*?(?:[.!?](?=\s)|$))"
COPYRIGHT = [
    rf"(?m)(?:\bcopyright\s*(?:\(c\)|©|:?\s*[0-9]{{4}}|<year>)|\(c\)\s*[0-9]{{4}}|©){_WHOSE}",
    r"\ball rights reserved\b[.]?",
]

#: Usual one-line notices (SPDX identifier, text).
NOTICES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
]
TEXTS = Path(__file__).parent / "license_texts"


@lru_cache(maxsize=4)
def registry(folder: Path = TEXTS) -> tuple[tuple[str, str], ...]:
    """``(SPDX identifier, text)`` of every known text: each file of the folder whole, without its
    title, without what follows the end of its terms, and without both, all as they stand and in
    one line (statements of copyright end elsewhere there); and the notices."""
    out: list[tuple[str, str]] = []
    for file in sorted(folder.glob("*.txt")):
        text = file.read_text(encoding="utf-8")
        terms = re.split(r"(?m)^\s*END OF TERMS AND CONDITIONS", text)[0]
        ends = re.match(r"(?s).*^\s*END OF TERMS AND CONDITIONS", text, re.M)
        for variant in dict.fromkeys([text, ends[0] if ends else text, terms]):
            title, _, rest = variant.strip().partition("\n")
            out += [(file.stem, variant), *([(file.stem, rest)] if "\n" in rest.strip() and re.search("licen[cs]e", title, re.I) else [])]
    in_lines = [(name, " ".join(text.split())) for name, text in out]
    return (*out, *in_lines, *NOTICES)


def canonical_lines(text: Column) -> Column:
    """The canonical, non-empty lines of a text."""
    t = F.lower(F.coalesce(text, F.lit("")))
    for statement in COPYRIGHT:
        t = F.regexp_replace(t, statement, " ")
    for pattern, plain in SPELLINGS:
        t = F.regexp_replace(t, pattern, plain)
    t = F.regexp_replace(t, r"[^\p{L}\p{N}\n]+", " ")
    return F.filter(F.transform(F.split(t, "\n"), lambda line: F.trim(line)), lambda line: line != "")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def known_texts(spark: SparkSession, known: list[tuple[str, str]]) -> DataFrame:
    """``(digest, license, n)``; of texts with equal canonical form the first name holds."""
    rows = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(known)], "i int, license string, text string")
    whole = F.array_join(canonical_lines(F.col("text")), " ")
    return (
        rows.select("i", "license", whole.alias("text"))
        .where("text <> ''")
        .groupBy(digest(F.col("text")).alias("digest"))
        .agg(F.min_by("license", "i").alias("license"), F.first(F.length("text")).alias("n"))
    )


def scan(documents: DataFrame, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """``doc_id, digest, license, notices, n_notices``: the licence whose whole text a document
    is, and the names (sorted, comma-joined) and number of its lines that are known texts."""
    spark = documents.sparkSession
    texts = materialise(known_texts(spark, list(registry() if known is None else known)), "known")
    lengths = [r.n for r in texts.select("n").distinct().collect()]  # the registry's size is the parameter's
    lines = F.col("lines")
    rows = (
        clashless(documents, "doc_id", "text")
        .select("doc_id", canonical_lines(F.col("text")).alias("lines"))
        .select("doc_id", digest(F.array_join(lines, " ")).alias("digest"), F.filter(lines, lambda line: F.length(line).isin(lengths)).alias("lines"))
    )
    rows = materialise(rows, "lines")
    names = texts.select("digest", "license")
    # rows with equal id and equal whole text have equal lines: they are looked up once
    noticed = (
        rows.where(F.size("lines") > 0)
        .dropDuplicates(["doc_id", "digest"])
        .select("doc_id", "digest", F.explode("lines").alias("line"))
        .join(small_side(names.select(F.col("digest").alias("known"), "license")), digest(F.col("line")) == F.col("known"))
        .groupBy("doc_id", "digest")
        .agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"), F.count(F.lit(1)).alias("n_notices"))
    )
    noticed = materialise(noticed, "noticed")
    same = F.col("r.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("r.digest") == F.col("n.digest"))
    return (
        rows.select("doc_id", "digest")
        .join(small_side(names), "digest", "left")
        .alias("r")
        .join(small_side(noticed).alias("n"), same, "left")
        .select("r.doc_id", "r.digest", "r.license", F.coalesce("n.notices", F.lit("")).alias("notices"), F.coalesce("n.n_notices", F.lit(0)).cast("long").alias("n_notices"))
    )
