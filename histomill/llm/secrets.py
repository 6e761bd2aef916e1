"""Secret scans: fixed patterns plus sliding-window entropy.

The patterns (kinds ``assign``, ``access``, ``hex``) are found leftmost and without overlaps.
Besides, candidate strings are runs of letters and digits, and runs that also hold the signs
of base64, each of a character class. A window of its class's length slides along a candidate;
its Shannon entropy is kept up by incremental counts. Windows above the class's threshold that
no allow-list entry suppresses are merged, and the merged ones are spans (kind ``entropy``); what
is left of the candidate beside them goes in where it is too short for a window. The allow-list
never removes a pattern's span.

Offsets are code points, ends exclusive. Defined results: null text is empty; very long texts and
candidates take time linear in their length; repeated rows are scanned each; an empty table gives
no rows; other columns are ignored (and kept by :func:`mask_documents`).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histomill.llm.common import clashless

# Fixed values of the operator's contract: patterns and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "entropy")

#: Characters of a window and bits a character that it must exceed, by class. Measured on random
#: keys (95 of 100 exceed it from the shortest length on) and on paths and identifiers.
CLASSES = {"hex": (20, 3.0), "one case": (20, 3.5), "alphanumeric": (20, 3.7), "letters": (24, 3.9), "base64": (24, 4.0)}
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}")
ALPHANUMERIC = re.compile(r"[A-Za-z0-9]{20,}")
#: What suppresses a window that holds it: placeholders, alphabets, dates, two words between separators.
ALLOWED = re.compile(
    r"(?i:example|placeholder|changeme|dummy|xxxx|0123456|1234567|7654321|abcdefg|hijklmn|mnopqrs|qrstuvw|tuvwxyz|qwerty|asdfgh)"
    r"|[12][0-9]{3}-[01][0-9]-[0-3][0-9]"
    r"|(?:^|[^A-Za-z0-9])(?:[A-Za-z][a-z]{2,}|[A-Z]{3,})(?=[^A-Za-z0-9])(?:.*[^A-Za-z0-9])(?:[A-Za-z][a-z]{2,}|[A-Z]{3,})(?:$|[^A-Za-z0-9])"
)
#: What suppresses a whole candidate: UUIDs, and words that are written together (of whose runs of
#: small letters at most a quarter are single letters, and which are long enough on average).
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
SMALL_LETTERS = re.compile("[a-z]+")
LONG_ENOUGH = 2.5
PLACEHOLDER = "[SECRET]"


def joined_words(run: str) -> bool:
    lengths = [len(m) for m in SMALL_LETTERS.findall(run)]
    return 4 * lengths.count(1) <= len(lengths) and sum(lengths) >= LONG_ENOUGH * len(lengths)


def character_class(run: str) -> str | None:
    """The class whose window and threshold hold for a run; None if it is words or a number."""
    digit, upper, lower = (re.search(p, run) is not None for p in ("[0-9]", "[A-Z]", "[a-z]"))
    if not run.isalnum():
        return "base64" if digit and upper and lower else None
    if digit and re.fullmatch("[0-9a-f]+|[0-9A-F]+", run) and (upper or lower):
        return "hex"
    if upper and lower:
        return None if joined_words(run) else "alphanumeric" if digit else "letters"
    return "one case" if digit and (upper or lower) else None


def entropies(run: str, window: int) -> Iterator[float]:
    """Shannon entropy, in bits a character, of every window of a run, from left to right."""
    cost = [0.0, *(n * math.log2(n) for n in range(1, window + 1))]
    counts: dict[str, int] = {}
    total = 0.0  # sum of n log2 n over the window's characters
    for i, c in enumerate(run):
        if i >= window:
            n = counts[out := run[i - window]]
            total += cost[n - 1] - cost[n]
            counts[out] = n - 1
        n = counts.get(c, 0)
        total += cost[n + 1] - cost[n]
        counts[c] = n + 1
        if i >= window - 1:
            yield math.log2(window) - total / window


def random_parts(run: str) -> list[tuple[int, int]]:
    """``(start, end)`` of what looks random in a candidate."""
    kind = character_class(run)
    if not kind or UUID.fullmatch(run):
        return []
    window, threshold = CLASSES[kind]
    merged: list[list[int]] = []
    for i, bits in enumerate(entropies(run, window)):
        part = run[i : i + window] if bits > threshold else ""
        if not part or ALLOWED.search(part) or kind == "base64" and character_class(part) is None:
            continue
        if merged and i <= merged[-1][1]:
            merged[-1][1] = i + window
        else:
            merged.append([i, i + window])
    if merged:
        merged[0][0] = 0 if merged[0][0] < window else merged[0][0]
        merged[-1][1] = len(run) if len(run) - merged[-1][1] < window else merged[-1][1]
    return [tuple(m) for m in merged]


def entropy_spans(text: str) -> list[tuple[int, int]]:
    """Spans of a text that look random: in runs of letters and digits, and in the runs around
    them that hold other signs, overlapping ones merged."""
    found: list[tuple[int, int]] = []
    for m in CANDIDATE.finditer(text):
        inner = [(m.start() + a.start() + s, m.start() + a.start() + e) for a in ALPHANUMERIC.finditer(m[0]) for s, e in random_parts(a[0])]
        outer = [] if m[0].isalnum() else [(m.start() + s, m.start() + e) for s, e in random_parts(m[0])]
        for start, end in sorted(inner + outer):
            if found and start < found[-1][1]:
                found[-1] = (found[-1][0], max(end, found[-1][1]))
            else:
                found.append((start, end))
    return found


def scan(text: str | None) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` in order; ``kind`` counts into ``KINDS``."""
    text = text or ""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    found += [(start, 3, end) for start, end in entropy_spans(text)]
    return sorted(found)


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find_secrets(documents: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_entropy, base_spans, spans`` of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            spans = [scan(t if isinstance(t, str) else None) for t in b["text"].array]
            out = {"doc_id": b["doc_id"]}
            for kind, name in enumerate(KINDS):
                out[f"n_{name}"] = [sum(s[1] == kind for s in found) for found in spans]
            out["base_spans"] = [spell([s for s in found if s[1] < 3]) for found in spans]
            out["spans"] = [spell(found) for found in spans]
            yield pd.DataFrame(out)

    rows = clashless(documents, "doc_id", "text").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    kind = documents.schema["doc_id"].dataType
    counts = ", ".join(f"n_{name} long" for name in KINDS)
    found = rows.mapInPandas(run, f"doc_id string, {counts}, base_spans string, spans string")
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def mask(text: str | None) -> str | None:
    """The text with every run of overlapping spans replaced by a placeholder."""
    if not text or not (spans := scan(text)):
        return text
    out, at, end = [], 0, 0
    for start, _, stop in spans:
        if start >= end:
            out += [text[at:start], PLACEHOLDER] if start >= at else []
        end = max(end, stop)
        at = end
    return "".join(out) + text[at:]


def mask_documents(documents: DataFrame) -> DataFrame:
    """All documents, with all their columns, with secrets masked and ``n_chars`` renewed where
    there is such a column."""

    place = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(place)
            yield b.set_column(place, b.schema.field(place), pa.array([mask(t) for t in text.to_pylist()], text.type))

    masked = documents.mapInArrow(run, documents.schema)
    if "n_chars" in documents.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return masked
