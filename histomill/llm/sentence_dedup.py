"""Substring dedup over sliding spans of sentences.

A text is cut into sentences, without losing a character. Sentences over ``LONGEST`` words are cut
at commas, and what is still longer behind words that a hash names: such a cut depends on the word
alone, so a passage is cut alike wherever it stands in a longer sentence. The shortest run of at
least ``SENTENCES`` sentences and ``WORDS`` words from every sentence and up to every sentence is
hashed; together they cover what all longer runs would. Runs are joined globally on the hash: the
first occurrence (by ``doc_id``, then text, then place) stays, and sentences under any other
occurrence are removed. A hash has 96 bits, of which 64 find equal runs and 32 confirm them.

Signs of scripts that are written without spaces count as words of their own.

Defined results: null text stays null and has no sentences; texts shorter than a run are left
alone, and one very long text is one text like any other; rows that repeat ``doc_id`` and text
count as one document and keep what its first occurrence keeps; rows without ``doc_id`` come
last, each a document of its own, so of equal ones all but one lose their passages; ids that are
no whole numbers count as null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histomill.llm.common import clashless, join_hot, materialise

SENTENCES = 2
WORDS = 20
LONGEST = 16
#: One word in so many is one behind which long sentences are cut.
EVERY = 8
#: Words of which a worker keeps whether the hash names them.
CACHED_WORDS = 250_000
#: Documents that a worker holds at a time: their runs take many times the memory of their texts.
ROWS = 200
_STOPS = ".!?\n。！？｡"
_MARKS = ",;:、，；："
_SENTENCE = re.compile(rf"[^{_STOPS}]*[{_STOPS}]+\s*|[^{_STOPS}]+\Z")
_CLAUSE = re.compile(rf"[^{_MARKS}]*[{_MARKS}]+\s*|[^{_MARKS}]+\Z")
_SIGN = "⺀-⿟぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"  # no spaces between words
_WORD = re.compile(rf"\s*(?:[{_SIGN}]|[^\s{_SIGN}]+)\s*")
_HAS_SIGN = re.compile(f"[{_SIGN}]")
_LAST = (1 << 63) - 1


def has_signs(text: str) -> bool:
    return not text.isascii() and _HAS_SIGN.search(text) is not None


def words_of(part: str, signs: bool) -> list[str]:
    """The words of a part of a text, lower-cased; ``signs`` tells whether the text has signs."""
    return [w.strip().lower() for w in _WORD.findall(part)] if signs else part.lower().split()


def _long(part: str, signs: bool) -> bool:
    return (signs or part.count(" ") >= LONGEST) and len(words_of(part, signs)) > LONGEST


class _Anchors(dict):
    """Whether the hash names a word, with the space around it."""

    def __missing__(self, word: str) -> bool:
        named = zlib.crc32(word.strip().lower().encode()) % EVERY == 0
        if len(self) < CACHED_WORDS:
            self[word] = named
        return named


_ANCHORS = _Anchors()


def _at_anchors(part: str) -> list[str]:
    """A part cut behind the words that the hash names."""
    out, held = [], []
    for w in _WORD.findall(part):
        held.append(w)
        if _ANCHORS[w]:
            out.append("".join(held))
            held.clear()
    return [*out, "".join(held)] if held else out


def sentences(text: str) -> list[str]:
    """Parts that make up the text when joined."""
    signs = has_signs(text)
    out = []
    for s in _SENTENCE.findall(text):
        if not _long(s, signs):
            out.append(s)
            continue
        for c in _CLAUSE.findall(s):
            out += _at_anchors(c) if _long(c, signs) else [c]
    return out


def runs(text: str) -> list[tuple[bytes, int, int]]:
    """``(hash, place, number of sentences)`` of the shortest run from every sentence and of the
    shortest run up to every sentence. Of a longer run that is found elsewhere, every sentence
    lies in one of these that is found there too."""
    signs = has_signs(text)
    words = [words_of(s, signs) for s in sentences(text)]
    full = [i for i, w in enumerate(words) if w]
    joined = [" ".join(words[i]).encode() for i in full]
    ends, end, held = [], 0, 0  # where the shortest run from each sentence ends
    for start in range(len(full)):
        while end < len(full) and (held < WORDS or end - start < SENTENCES):
            held += len(words[full[end]])
            end += 1
        if held < WORDS or end - start < SENTENCES:
            break
        ends.append(end)
        held -= len(words[full[start]])
    out = []
    for start, end in enumerate(ends):
        run = xxhash.xxh3_128(b" ".join(joined[start:end]))
        out.append((run.digest(), full[start], full[end - 1] - full[start] + 1))
        # ends that the next sentence's run does not reach: the shortest runs up to them start here
        for last in range(end, ends[start + 1] - 1 if start + 1 < len(ends) else len(full)):
            run.update(b" " + joined[last])
            out.append((run.digest(), full[start], full[last] - full[start] + 1))
    return out


def _slices(batches: Iterator[pd.DataFrame], rows: int = ROWS) -> Iterator[pd.DataFrame]:
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.iloc[at : at + rows]


def spans(documents: DataFrame) -> DataFrame:
    """``(h, g, doc, digest, place, n)`` of every run: 64 and 32 bits of its hash, its document
    (the largest long for null ids), place and number of sentences."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _slices(batches):
            found = [runs(t) for t in b["text"].array]
            times = [len(x) for x in found]
            hashes = np.frombuffer(b"".join(h for x in found for h, _, _ in x), ">u8").reshape(-1, 2)
            yield pd.DataFrame({
                "h": hashes[:, 1].astype(np.uint64).view(np.int64),
                "g": (hashes[:, 0] & 0xFFFFFFFF).astype(np.uint32).view(np.int32),
                "doc": np.repeat(b["doc"].to_numpy(), times),
                "digest": np.repeat(b["digest"].to_numpy(), times),
                "place": np.array([p for x in found for _, p, _ in x], np.int32),
                "n": np.array([n for x in found for _, _, n in x], np.int32),
            })

    rows = clashless(documents, "doc_id", "text").select(*_key(), "text").where("text IS NOT NULL")
    return rows.mapInPandas(run, "h long, g int, doc long, digest long, place int, n int")


def _key() -> list:
    return [F.coalesce(F.col("doc_id").try_cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("digest")]


def _numbered(documents: DataFrame) -> DataFrame:
    """``doc_id, text, doc, digest, copy``; ``copy`` holds for all but one of equal rows without id."""
    texts = clashless(documents, "doc_id", "text").select(F.col("doc_id").try_cast("long").alias("doc_id"), "text")
    named, nameless = texts.where("doc_id IS NOT NULL").select("*", *_key(), F.lit(False).alias("copy")), texts.where("doc_id IS NULL")
    if nameless.isEmpty():
        return named
    rows = materialise(nameless.select("*", *_key(), F.monotonically_increasing_id().alias("row")), "nameless")
    first = materialise(rows.groupBy("digest").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("rows")), "firsts")
    told = join_hot(rows, first, "digest", "rows")
    return named.unionByName(told.select("doc_id", "text", "doc", "digest", (F.col("row") != F.col("first")).alias("copy")))


def deduplicate(documents: DataFrame) -> DataFrame:
    """``doc_id, text, n_sentences, n_removed, removed`` of every row: the text without repeated
    passages and the removed sentences' numbers as ``first-last`` ranges."""
    found = materialise(spans(documents), "spans")
    # most runs occur once: they leave before places are carried anywhere
    repeated = materialise(found.groupBy("h").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "repeated")
    again = materialise(join_hot(found, repeated, "h", "times").select("h", "g", "doc", "digest", "place", "n"), "again")
    first = again.groupBy("h", "g").agg(F.min(F.struct("doc", "digest")).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    first = materialise(first.withColumnRenamed("g", "first_g"), "first")
    here = F.col("first") == F.struct("doc", "digest")
    covered = (
        join_hot(again, first, "h", "times")
        .where("g = first_g")
        .select("doc", "digest", F.struct("place", "n", "h", here.alias("own")).alias("run"))
        .groupBy("doc", "digest")
        .agg(F.collect_set("run").alias("runs"))  # at most two a sentence of the document
    )
    joined = _numbered(documents).join(covered, ["doc", "digest"], "left").select(
        F.col("doc_id").cast("string").alias("doc_id"), "text", "copy", F.col("runs.place").alias("place"), F.col("runs.n").alias("n"), F.col("runs.h").alias("h"), F.col("runs.own").alias("own")
    )

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _slices(batches):
            out = []
            for doc, text, copy, *held in zip(*(b[c].array for c in ("doc_id", "text", "copy", "place", "n", "h", "own")), strict=True):
                if not isinstance(text, str):
                    out.append((doc, None, 0, 0, ""))
                    continue
                parts = sentences(text)
                gone = bytearray(len(parts))
                seen = set()
                found = zip(*(x.tolist() for x in held), strict=True) if held[0] is not None else ()
                for p, k, name, own in sorted(found):
                    if own and name not in seen and not copy:
                        seen.add(name)  # the first occurrence of all
                        continue
                    gone[p : p + k] = b"\1" * k
                kept = "".join(s for s, g in zip(parts, gone, strict=True) if not g)
                ranges = ",".join(f"{m.start()}-{m.end() - 1}" for m in re.finditer(b"\1+", bytes(gone)))
                out.append((doc, kept, len(parts), sum(gone), ranges))
            yield pd.DataFrame(out, columns=["doc_id", "text", "n_sentences", "n_removed", "removed"])

    cleaned = joined.mapInPandas(clean, "doc_id string, text string, n_sentences long, n_removed long, removed string")
    return cleaned.withColumn("doc_id", F.col("doc_id").cast("long"))
