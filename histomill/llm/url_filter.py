"""URL rules in a sorted digest array.

Every rule ``(host, path, verdict)`` is filed under the 64-bit XXH64 of its text. Rules come as a
table of any size: Spark sorts it by digest into range-partitioned parts in the shared folder, and
every executor fetches the parts, whose digests, strings and verdicts its workers map into memory.
A url stands for few keys: each suffix of its host at a dot, with each length of path that some
rule has. All keys of a batch are looked up by vectorised binary search, first for the part, then
within it, and a hit counts only if the stored string equals the key, so colliding digests cannot
decide anything. The longest rule found decides; a url that no rule fits is looked up, whole, in
a second array of blocked ``host + path`` strings. The driver holds neither table.

Defined results: a null url or one without ``://`` has empty host and path and fits no rule; very
long urls are taken whole; repeated rows are judged each; equal rules count once, and of rules with
equal host and path ``block`` wins; rules with a null host or path and null blocked strings are
ignored; an empty rule table leaves every verdict to the blocked strings, an empty table of those
allows; an empty table of pages gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from histomill.llm.common import ascii_lower, clashless
from histomill.storage import claim

#: Strings in a part of a digest array.
PART_ROWS = 2_000_000
ALLOW, BLOCK = "allow", "block"
SEED = 42  # that of Spark's xxhash64, by which the parts are ranged


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def digests(strings: list[bytes]) -> np.ndarray:
    """Digests as signed longs, as Spark has them."""
    return np.array([xxhash.xxh64_intdigest(s, SEED) for s in strings], np.uint64).view(np.int64)


class DigestArray:
    """Sorted digests of strings, mapped from a file, with the strings for confirmation and a
    value of each."""

    def __init__(self, path: str):
        n, blob = (int(x) for x in np.fromfile(path, "<i8", 2))
        at = 16
        self.keys = np.memmap(path, "<i8", "r", at, (n,)) if n else np.empty(0, np.int64)
        at += 8 * n
        self.ends = np.memmap(path, "<i8", "r", at, (n + 1,))
        at += 8 * (n + 1)
        self.values = np.memmap(path, np.uint8, "r", at, (n,)) if n else np.empty(0, np.uint8)
        self.blob = np.memmap(path, np.uint8, "r", at + n, (blob,)) if blob else np.empty(0, np.uint8)

    @staticmethod
    def write(path: str, strings: list[bytes], values: Sequence[int] = ()) -> None:
        keys = digests(strings)
        order = np.argsort(keys, kind="stable")
        ends = np.concatenate(([0], np.cumsum([len(strings[i]) for i in order], dtype=np.int64))).astype("<i8")
        with open(path, "wb") as out:
            out.write(np.array([len(strings), int(ends[-1])], "<i8").tobytes())
            out.write(keys[order].astype("<i8").tobytes())
            out.write(ends.tobytes())
            out.write((np.asarray(values, np.uint8) if len(values) else np.zeros(len(strings), np.uint8))[order].tobytes())
            out.writelines(strings[i] for i in order)

    def find(self, strings: list[bytes], wanted: np.ndarray | None = None) -> np.ndarray:
        """Place of each string in the array, -1 where it isn't."""
        wanted = digests(strings) if wanted is None else wanted
        at = np.searchsorted(self.keys, wanted)
        out = np.full(len(strings), -1)
        inside = at < len(self.keys)
        for i in np.flatnonzero(inside)[self.keys[at[inside]] == wanted[inside]]:
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == wanted[i]:  # digests that collide
                if self.string(j) == strings[i]:
                    out[i] = j
                    break
                j += 1
        return out

    def string(self, place: int) -> bytes:
        return self.blob[self.ends[place] : self.ends[place + 1]].tobytes()


class RangedArrays:
    """Digest arrays of one table, whose ranges of digests follow each other."""

    def __init__(self, arrays: list[DigestArray]):
        self.arrays = sorted((a for a in arrays if len(a.keys)), key=lambda a: int(a.keys[0]))
        self.firsts = np.array([a.keys[0] for a in self.arrays], np.int64)

    def find(self, strings: list[bytes]) -> np.ndarray:
        """Value of each string, -1 where it isn't there."""
        out = np.full(len(strings), -1)
        if not strings or not self.arrays:
            return out
        wanted = digests(strings)
        part = np.searchsorted(self.firsts, wanted, "right") - 1
        for k in np.unique(part[part >= 0]):
            of = np.flatnonzero(part == k)
            places = self.arrays[k].find([strings[i] for i in of], wanted[of])
            hit = places >= 0
            out[of[hit]] = self.arrays[k].values[places[hit]]
        return out


def suffixes(host: str) -> list[str]:
    """The host and every part of it behind a dot."""
    return [host, *(host[i + 1 :] for i, c in enumerate(host) if c == ".")] if host else []


def _ship(strings: DataFrame) -> list[str]:
    """Write a table ``(s, value)`` of different strings in parts by range of their digests, from
    where every executor fetches them; the parts' names."""
    spark = strings.sparkSession
    parts = max(1, -(-strings.count() // PART_ROWS))
    path = claim(spark, f"digests-{uuid.uuid4().hex}")
    strings.select("s", F.col("value").cast("int").alias("value"), F.xxhash64("s").alias("k")).repartitionByRange(parts, "k").select("s", "value").write.parquet(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listed = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    files = [f.getPath() for f in listed if f.getPath().getName().startswith("part-")]
    for f in files:
        spark.sparkContext.addFile(f.toString())
    return [f.getName() for f in files]


def _mapped(names: list[str]) -> RangedArrays:
    """The arrays of a table's parts on this executor; the first worker lays each out for mapping
    beside the file that Spark has fetched."""
    arrays = []
    for name in names:
        fetched = SparkFiles.get(name)
        if not os.path.exists(path := f"{fetched}.digests"):
            part = pq.read_table(fetched)
            own = f"{path}-{uuid.uuid4().hex}"
            DigestArray.write(own, [s.encode() for s in part["s"].to_pylist()], part["value"].to_numpy())
            os.replace(own, path)
        arrays.append(DigestArray(path))
    return RangedArrays(arrays)


def _spell(host: str, path: str) -> bytes:
    return f"{host}\n{path}".encode()


def judge(pages: DataFrame, rules: DataFrame | Sequence[tuple[str, str, str]], blocked: DataFrame | Sequence[str] = ()) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row. ``rules`` has the columns ``host``,
    ``path``, ``verdict``, and ``blocked`` the column ``url`` with ``host + path``."""
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "host string, path string, verdict string")
    if not isinstance(blocked, DataFrame):
        blocked = spark.createDataFrame([(b,) for b in blocked], "url string")
    rows = clashless(pages, "page_id", "url").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rules = rules.where("host IS NOT NULL AND path IS NOT NULL").select(ascii_lower(F.col("host")).alias("host"), "path", (F.col("verdict") == BLOCK).alias("bad"))
    lengths = sorted(r.n for r in rules.select(F.length("path").alias("n")).distinct().collect())  # no more than paths are long
    spelled = F.concat_ws("\n", "host", "path")
    filed = _ship(rules.groupBy(spelled.alias("s")).agg(F.max(F.coalesce("bad", F.lit(True))).cast("int").alias("value")))
    listed = _ship(blocked.where("url IS NOT NULL").select(F.col("url").alias("s"), F.lit(1).alias("value")).distinct())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        array, urls = _mapped(filed), _mapped(listed)
        for b in batches:
            hosts, paths = b["host"].tolist(), b["path"].tolist()
            of, keys = [], []
            for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
                for suffix in suffixes(host):
                    for n in lengths:
                        if n > len(path):
                            break
                        of.append(i)
                        keys.append((suffix, path[:n]))
            best: dict[int, tuple] = {}
            found = array.find([_spell(*k) for k in keys])
            for j in np.flatnonzero(found >= 0):
                host, path = keys[j]
                best[of[j]] = max(best.get(of[j], ()), (len(host) + len(path), len(host), BLOCK if found[j] else ALLOW, host + path))
            open_ = [i for i in range(len(hosts)) if i not in best]
            bad = dict(zip(open_, (urls.find([(hosts[i] + paths[i]).encode() for i in open_]) >= 0).tolist(), strict=True))
            b["rule"] = [best[i][3] if i in best else None for i in range(len(b))]
            b["verdict"] = [best[i][2] if i in best else BLOCK if bad[i] else ALLOW for i in range(len(b))]
            yield b

    kind = pages.schema["page_id"].dataType
    judged = rows.withColumn("page_id", F.col("page_id").cast("string")).mapInPandas(
        run, "page_id string, host string, path string, rule string, verdict string"
    )
    return judged.withColumn("page_id", F.col("page_id").cast(kind))
