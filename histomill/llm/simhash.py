"""SimHash near-duplicates through pivot distance tables.

Every distinct fingerprint gets a table of its Hamming distances to reference fingerprints: the
origin, for each of ``GROUPS`` groups of bits the masks of its first bits, and ``PIVOTS`` random
ones. Two fingerprints within ``BITS`` bits differ by at most ``BITS`` in every coordinate
(triangle inequality), and one differing bit changes only its own group's coordinates, beside
the origin's. So fingerprints within two bits agree in the coordinates, less the origin's, of
at least two of four groups: each is filed in the cells that its coordinates of every two
groups name. Of the pairs that share a cell those whose largest coordinate difference is
greater than ``BITS`` are discarded, and the exact distance verifies the rest.

A cell of more than ``CROWD`` fingerprints (large groups of near copies) makes no pairs: each of
its members is filed under every reference at distance 0 or 1 of it, of which two members
within two bits share one, and at most 65 share any. So all links are found in a number of rows
linear in the members.

Defined results: null or blank text has fingerprint zero and links like any other; equal texts
share a fingerprint; repeated rows are returned each; rows without ``doc_id`` link but do not
name a component (null where a component has no id); ids that are no whole numbers count as
null; an empty table gives no rows; other columns are ignored, and kept by :func:`keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histomill.llm.common import clashless, join_hot, materialise, small_side
from histomill.llm.graph import components

SHINGLE = 3
SEED = 42
BITS = 2
#: Groups of bits whose coordinates are told apart, and random references besides.
GROUPS, WIDTH, PIVOTS = 4, 16, 16
#: Most fingerprints of a cell that are paired.
CROWD = 32
#: Most keys of dropped documents that are broadcast (16 bytes each); beyond it they are joined.
LOOKED_UP = 500_000


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-shingle] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], seed) for s, e in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = np.array(hashes[at : at + 65_536], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def digest(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fingerprints(documents: DataFrame) -> DataFrame:
    """``(doc_id, digest, fp)`` of every row: a digest of the text and its fingerprint, as longs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = np.array([fingerprint(t if isinstance(t, str) else None) for t in b["text"].array], np.uint64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "digest": b["digest"], "fp": fps.view(np.int64)})

    # ids pass through as text: pandas would turn longs beside nulls into floats
    rows = clashless(documents, "doc_id", "text").select(F.col("doc_id").cast("string").alias("doc_id"), digest(F.col("text")).alias("digest"), "text")
    return rows.mapInPandas(run, "doc_id string, digest long, fp long").withColumn("doc_id", F.col("doc_id").try_cast("long"))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def references() -> list[int]:
    """The reference fingerprints: origin, first bits of each group, random ones."""
    firsts = [((1 << n) - 1) << (WIDTH * g) for g in range(GROUPS) for n in range(1, WIDTH + 1)]
    return [0, *firsts, *(xxhash.xxh64_intdigest(i.to_bytes(8, "little"), SEED) for i in range(PIVOTS))]


def pivot_table(fps: DataFrame) -> DataFrame:
    """``fp`` with ``p``, its distances to the reference fingerprints."""
    return fps.select("fp", F.array(*[F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(r)))).cast("byte") for r in references()]).alias("p"))


def cells(table: DataFrame) -> DataFrame:
    """``(fp, key)``: the cells of every fingerprint, one for every two groups."""
    less_origin = lambda i: F.get("p", F.lit(i)) - F.get("p", F.lit(0))
    of_group = [F.xxhash64(*[less_origin(1 + WIDTH * g + n) for n in range(WIDTH)]) for g in range(GROUPS)]
    told = table.select("fp", *[h.alias(f"g{g}") for g, h in enumerate(of_group)])
    return told.select("fp", F.explode(F.array(*[F.xxhash64(F.lit(t), f"g{i}", f"g{j}") for t, (i, j) in enumerate(combinations(range(GROUPS), 2))])).alias("key"))


def cell_pairs(shared: DataFrame, table: DataFrame) -> DataFrame:
    """``(a, b, pa, pb)``: fingerprints that share a cell, with their distances."""
    near = shared.join(table, "fp")
    return (
        near.alias("x")
        .join(near.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")))
        .select(F.col("y.fp").alias("a"), F.col("x.fp").alias("b"), F.col("y.p").alias("pa"), F.col("x.p").alias("pb"))
    )


def furthest() -> Column:
    """Largest coordinate difference of a pair."""
    return F.array_max(F.zip_with("pa", "pb", lambda x, y: F.abs(x - y)))


def links(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``(a, b)``: links that connect exactly the fingerprints that chains of steps of at most
    ``BITS`` bits connect. ``fps`` holds each fingerprint once."""
    filed = materialise(cells(pivot_table(fps)), "cells")
    sizes = materialise(filed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    shared = materialise(join_hot(filed, sizes, "key", "n").select("fp", "key", "n"), "shared")

    few = shared.where(F.col("n") <= crowd).select("fp", "key")
    pairs = (
        cell_pairs(few, pivot_table(few.select("fp").distinct()))
        .where(furthest() <= BITS)
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS)
        .select("a", "b")
    )
    crowded = shared.where(F.col("n") > crowd).select("fp").distinct()
    around = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)])
    stars = (
        crowded.select("fp", F.explode(around).alias("z"))
        .groupBy("z")
        .agg(F.min("fp").alias("b"), F.collect_list("fp").alias("members"))  # 65 members at most
        .where(F.size("members") > 1)
        .select(F.explode("members").alias("a"), "b")
        .where("a <> b")
    )
    return pairs.unionByName(stars)


def steps(fps: DataFrame, crowd: int = CROWD) -> dict[str, int]:
    """What each step leaves of the pairs of a table: ``all``, ``cells``, ``furthest``, ``verified``."""
    filed = cells(pivot_table(fps))
    few = filed.join(filed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, crowd)), "key").select("fp", "key")
    told = cell_pairs(few, pivot_table(few.select("fp").distinct())).distinct()
    exact = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS
    row = told.agg(F.count(F.lit(1)).alias("cells"), F.count_if(furthest() <= BITS).alias("furthest"), F.count_if((furthest() <= BITS) & exact).alias("verified")).first()
    n = fps.count()
    return {"all": n * (n - 1) // 2, **row.asDict()}


def _labelled(documents: DataFrame) -> DataFrame:
    """``doc_id, digest, fp, component_id, stays`` of every row; ``stays`` is the id and digest that
    stand for its component: the smallest id, or no id, and the smallest digest."""
    rows = materialise(fingerprints(documents), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "digest"))
    distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), first.alias("first"), F.count(F.lit(1)).alias("n")), "distinct")
    labels = components(links(distinct.select("fp")))
    named = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"), F.min("first").alias("stays"))
    named = materialise(named.join(least, "label").select("fp", "n", "component_id", "stays"), "components")
    return join_hot(rows, named, "fp", "n").select("doc_id", "digest", "fp", "component_id", "stays")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """``doc_id, digest, fp, component_id`` of every row: the smallest id that links reach."""
    return _labelled(documents).drop("stays")


def keep_one(documents: DataFrame) -> DataFrame:
    """The documents, with all their columns, of which one row of each component stays: that with
    the smallest id (any rather than none) and, of equal ids, the smallest digest."""
    found = materialise(_labelled(documents), "labelled")
    kept = F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("digest") == F.col("stays.digest"))
    # what goes is a small part of what stays, and a key of two longs: texts are shuffled only
    # where even these are too many to be looked up
    gone = materialise(found.where(~kept).select("doc_id", "digest").distinct(), "gone")
    own_id = F.col("t.doc_id").try_cast("long") if "doc_id" in documents.columns else F.lit(None)
    same = lambda side: own_id.eqNullSafe(F.col(f"{side}.doc_id")) & (digest(F.col("t.text")) == F.col(f"{side}.digest"))
    stays = documents.alias("t").join(small_side(gone, LOOKED_UP).alias("g"), same("g"), "left_anti")
    repeated = materialise(found.where(kept).groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "digest"), "repeated")
    if repeated.isEmpty():
        return stays
    # rows that are repeated with id and text: one of each
    sides = [stays.alias("t").join(small_side(repeated, LOOKED_UP).alias("r"), same("r"), how) for how in ("left_anti", "left_semi")]
    one = sides[1].withColumn("\0key", F.struct(own_id.alias("doc_id"), digest(F.col("t.text")).alias("digest"))).dropDuplicates(["\0key"]).drop("\0key")
    return sides[0].unionByName(one)
