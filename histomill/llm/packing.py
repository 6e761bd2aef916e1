"""Best-fit packing of tokenised documents into sequences of bounded length.

Documents are tokenised where they lie and cut only where they exceed a sequence. Each
partition then packs its pieces best-fit, longest first, emits the nearly full bins and hands
every underfull one up a tree, where it is an item. A node of the tree takes the underfull
bins of ``FAN_IN`` nodes below, packs them best-fit, and again emits what is nearly full, until
one node is left.

However many bins go up, no task holds those of a node: bins of one fill are alike, so a node
packs numbers of bins by fill, of which there are fewer than ``capacity``. Its packing says
which ranks of which fill share which bins, and the bins find their places by their rank in a
join whose keys hold at most ``CHUNK`` rows.

Defined results: null text is empty, and an empty document is the end token alone; very long texts
are cut like others; repeated rows are packed each; a null ``doc_id``, and one that is no whole
number, is null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from base64 import b64decode
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from histomill.llm.common import clashless, materialise

CAPACITY = 1024
END_ID = 2
#: Bins with less room than this are nearly full.
SLACK = 8
ITEMS_A_TASK = 65_536
FAN_IN = 8
#: Most bins of a node that are ranked in one task.
CHUNK = 65_536
#: Distinct words whose ids a worker keeps.
CACHED_WORDS = 250_000

_RECORD = np.dtype([("doc", "<i8"), ("known", "u1"), ("piece", "<i4"), ("start", "<i8"), ("length", "<i4"), ("crc", "<i8")])

# Fixed values of the vocabulary: the pattern that cuts a text into words before merging.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same cut in the standard library's dialect, right for texts without ``_UNSAFE``.
_PLAIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_UNSAFE = re.compile("[^\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]")


class Encoder(dict):
    """Ids of texts as little-endian unsigned 32-bit bytes. A dictionary of word to bytes that
    encodes what it misses."""

    def __init__(self, ranks_path: str, tokens_path: str):
        import regex
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        with open(tokens_path, encoding="utf-8") as tokens:
            added = {t["content"]: t["id"] for t in json.load(tokens)["added_tokens"]}
        self.core = tiktoken.Encoding("words", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.added = {text: np.array([i], "<u4").tobytes() for text, i in added.items()}
        self.split_added = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.words = regex.compile(WORDS)

    def __missing__(self, word: str) -> bytes:
        ids = array("I", self.core.encode_single_piece(word.encode())).tobytes()
        if len(self) < CACHED_WORDS:
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if self.split_added and any(a in text for a in self.added):
            return b"".join(self.added.get(part) or self.encode_plain(part) for part in self.split_added.split(text))
        return self.encode_plain(text)

    def encode_plain(self, text: str) -> bytes:
        words = self.words if _UNSAFE.search(text) else _PLAIN_WORDS
        return b"".join([self[w] for w in words.findall(text)])


@lru_cache(maxsize=2)
def encoder(ranks_path: str, tokens_path: str) -> Encoder:
    """One encoder a worker."""
    return Encoder(ranks_path, tokens_path)


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """``(start, length)`` of a document's pieces: whole pieces, the first may be shorter."""
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


def pieces(documents: DataFrame, ranks_path: str, tokens_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``(fill, members, done)``: each piece as a bin of its own; full ones are done."""
    end = np.array([end_id], "<u4").tobytes()

    def tokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(ranks_path, tokens_path).encode
        for batch in batches:
            fills, members = [], []
            for doc, text in zip(batch["doc_id"].array, batch["text"].array, strict=True):
                known = not pd.isna(doc)
                ids = encode(text if isinstance(text, str) else "") + end
                for i, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    members.append(np.array([(int(doc) if known else 0, known, i, start, length, crc)], _RECORD).tobytes())
                    fills.append(length)
            yield pd.DataFrame({"fill": fills, "members": members, "done": [f == capacity for f in fills]})

    rows = clashless(documents, "doc_id", "text").select(F.col("doc_id").try_cast("long").cast("string").alias("doc_id"), "text")
    return rows.mapInPandas(tokenise, "fill int, members binary, done boolean")


def best_fit(fills: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of item numbers, each item put where it leaves least room, in the order given."""
    room_of: list[int] = []
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for item, fill in enumerate(fills):
        if fits := rooms >> fill:
            room = fill + (fits & -fits).bit_length() - 1
            bin_ = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[bin_].append(item)
        else:
            bin_, room = len(bins), capacity
            bins.append([item])
            room_of.append(capacity)
        room_of[bin_] = left = room - fill
        if left:
            by_room[left].append(bin_)
            rooms |= 1 << left
    return bins


def best_fit_of_counts(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """What :func:`best_fit` does with ``counts[fill]`` items of each fill, longest first, as
    ``(fill, low, high, per_bin, first_bin, place)``: of the items of that fill, numbers ``low``
    to ``high`` (exclusive) go ``per_bin`` at a time into the bins from ``first_bin`` on, behind
    ``place`` items. Equal items meet equal bins, so there are few such lines whatever the counts."""
    alike: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]  # by room: first bin, bins, items in each
    rooms = opened = 0
    out = []
    for fill in sorted(counts, reverse=True):
        low, left = 0, counts[fill]
        while left:
            if fits := rooms >> fill:
                room = fill + (fits & -fits).bit_length() - 1
                first, bins, held = alike[room].pop()
                if not alike[room]:
                    rooms &= ~(1 << room)
            else:
                room, first, bins, held = capacity, opened, left, 0
            per = min(left, room // fill)
            used = min(bins, left // per)
            if room == capacity and first == opened:
                opened, bins = opened + used, used
            out.append((fill, low, low + used * per, per, first, held))
            low, left = low + used * per, left - used * per
            for rest, group in ((room - per * fill, (first, used, held + per)), (room, (first + used, bins - used, held))):
                if rest and group[1]:
                    alike[rest].append(group)
                    rooms |= 1 << rest
    return out


_BINS = "node long, chunk long, nth long, fill int, members binary, done boolean"


def pack_pieces(bins: DataFrame, partitions: int, capacity: int = CAPACITY, slack: int = SLACK) -> DataFrame:
    """One best-fit in each of ``partitions`` tasks: the leaves of the tree. ``nth`` numbers the
    bins of one fill in a chunk of a node."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = [x for b in batches for x in zip(b["fill"].tolist(), b["members"].tolist(), strict=True)]
        items.sort(key=lambda x: (-x[0], x[1]))
        found = best_fit([f for f, _ in items], capacity)
        fills = [sum(items[i][0] for i in bin_) for bin_ in found]
        out = pd.DataFrame({"fill": fills, "members": [b"".join(items[i][1] for i in bin_) for bin_ in found]})
        out["done"] = out["fill"] > capacity - slack
        out["node"], out["chunk"] = TaskContext.get().partitionId(), np.arange(len(out)) // CHUNK
        out["nth"] = out.groupby(["chunk", "fill"]).cumcount()
        yield out[["node", "chunk", "nth", "fill", "members", "done"]]

    return bins.repartition(partitions).mapInPandas(run, _BINS)


def pack_node(bins: DataFrame, capacity: int = CAPACITY, slack: int = SLACK) -> DataFrame:
    """The next level of the tree: underfull bins of ``FAN_IN`` nodes packed as items. ``bins`` is
    a stored table of underfull bins."""
    bins = bins.withColumn("up", F.floor(F.col("node") / FAN_IN)).drop("done")
    key = ["up", "node", "chunk", "fill"]
    counts = bins.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("up", "fill").orderBy("node", "chunk")) - F.col("n")

    def plan(of_node: pd.DataFrame) -> pd.DataFrame:
        lines = best_fit_of_counts(dict(zip(of_node["fill"].tolist(), of_node["n"].tolist(), strict=True)), capacity)
        out = pd.DataFrame(lines, columns=["fill", "low", "high", "per", "first", "place"])
        out.insert(0, "up", of_node["up"].iloc[0])
        return out

    plans = counts.groupBy("up", "fill").agg(F.sum("n").alias("n")).groupBy("up").applyInPandas(
        plan, "up long, fill int, low long, high long, per long, first long, place long"
    )
    # the lines that a chunk's ranks of one fill meet
    meets = (F.col("low") < F.col("before") + F.col("n")) & (F.col("high") > F.col("before"))
    lines = (
        counts.withColumn("before", before)
        .join(plans, ["up", "fill"])
        .where(meets)
        .groupBy(*key)
        .agg(F.first("before").alias("before"), F.collect_list(F.struct("low", "high", "per", "first", "place")).alias("lines"))
    )
    rank = F.col("before") + F.col("nth")
    line = F.filter("lines", lambda x: (x["low"] <= rank) & (rank < x["high"]))[0]
    told = bins.join(lines, key).select("up", "fill", "members", rank.alias("rank"), line.alias("line"))
    behind = F.col("rank") - F.col("line.low")
    told = told.select("up", "fill", "members", (F.col("line.first") + F.floor(behind / F.col("line.per"))).alias("bin"), (F.col("line.place") + behind % F.col("line.per")).alias("place"))
    merged = told.groupBy("up", "bin").agg(
        F.sum("fill").cast("int").alias("fill"), F.array_sort(F.collect_list(F.struct("place", "members"))).alias("of")  # at most ``capacity`` items
    )
    chunk = F.floor(F.col("bin") / CHUNK)
    nth = F.row_number().over(Window.partitionBy("node", "chunk", "fill").orderBy("bin")) - 1
    members = F.aggregate("of.members", F.lit(b""), lambda a, m: F.concat(a, m))
    placed = merged.select(F.col("up").alias("node"), chunk.alias("chunk"), "bin", "fill", members.alias("members"))
    return placed.select("node", "chunk", nth.cast("long").alias("nth"), "fill", "members", (F.col("fill") > capacity - slack).alias("done"))


def pack(documents: DataFrame, ranks_path: str, tokens_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece."""
    level = materialise(pieces(documents, ranks_path, tokens_path, capacity, end_id), "pieces")
    return lay_out(pack_bins(level, capacity))


def pack_bins(level: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``fill, members`` of every sequence, from stored pieces."""
    sequences = level.where("done").select("fill", "members")
    open_bins = level.where("NOT done")
    nodes = max(1, -(-open_bins.count() // ITEMS_A_TASK))
    level = materialise(pack_pieces(open_bins, nodes, capacity), "bins")
    while nodes > 1:
        sequences = sequences.unionByName(level.where("done").select("fill", "members"))
        nodes = -(-nodes // FAN_IN)
        level = materialise(pack_node(level.where("NOT done"), capacity), "bins")
    return sequences.unionByName(level.select("fill", "members"))


def lay_out(sequences: DataFrame) -> DataFrame:
    """A row a piece, with its sequence and its place there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            blobs = b["members"].tolist()
            rows = np.frombuffer(b"".join(blobs), _RECORD)
            counts = np.array([len(x) // _RECORD.itemsize for x in blobs])
            before = np.cumsum(rows["length"], dtype=np.int64) - rows["length"]
            firsts = np.repeat(before[np.cumsum(counts) - counts], counts)
            docs = pd.array(rows["doc"], dtype="Int64")
            docs[rows["known"] == 0] = pd.NA
            yield pd.DataFrame({
                "doc_id": docs,
                "piece": rows["piece"],
                "start": rows["start"],
                "length": rows["length"].astype(np.int64),
                "ids_crc32": rows["crc"],
                "sequence_id": np.repeat(b["sequence_id"].to_numpy(), counts),
                "offset": before - firsts,
            })

    return sequences.select("members", F.monotonically_increasing_id().alias("sequence_id")).mapInPandas(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
