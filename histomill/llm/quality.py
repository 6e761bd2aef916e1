"""Quality classifier from weak labels.

Overlapping heuristic labellers vote on every document: good, bad or no vote. Votes are
counted by pattern over all documents (at most 3 to the number of labellers rows), and
expectation-maximisation on these counts estimates each labeller's accuracy and every
pattern's posterior. The posteriors label a bounded sample, on which a linear scorer over
hashed features is trained; the scorer judges every document.

Features are transitions between runs of character classes, counted over the whole text, and
the labellers' measures in steps, hashed to ``DIMENSIONS``.

A text without spaces between words is measured by its signs. The labeller that looks for known
function words does not vote on other scripts than Latin and Cyrillic.

Defined results: null or blank text has no votes, gets the score of its (empty) features and
is kept or rejected like any other; very long texts are measured whole; repeated rows are judged
each; ids that are no whole numbers become null in the result; an empty table gives no rows;
other columns are ignored, and kept by :func:`keep_good`.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histomill.llm.common import clashless, materialise

DIMENSIONS = 1024
#: Most rows on which the scorer is trained, drawn by hash.
TRAINING_ROWS = 20_000
ITERATIONS = 100
#: A document is rejected if its probability of being good is below this.
THRESHOLD = 0.5

# Frequent function words of the languages that the labellers know.
FUNCTION_WORDS = frozenset(
    "the of and to a in is it that for on with as was be by are this at from or an not "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als "
    "le la les de des et à un une du en que qui dans pour par sur est au pas avec "
    "el los las y en que de un una con no por para se del al su lo es "
    "di il che non per sono della un è si het een van dat niet op te zijn não uma os do da em com mais "
    "i w na z do nie to jest się że и в не на с что как по это но из за от для он она они к у же бы ve bir bu da için".split()
)
_SYMBOLS = "#$%&*@^~<>{}[]\\=+_`"

#: Labellers (name, measure, bad from, good below); between the two there is no vote.
LABELLERS = [
    ("symbols", 0, 0.05, 0.005),
    ("separators", 1, 0.15, 0.02),
    ("capitals", 2, 0.5, 0.2),
    ("exclamations", 3, 0.3, 0.05),
    ("repeats", 4, 0.2, 0.05),
    ("sameness", 5, 0.7, 0.45),
    ("strangeness", 6, 0.97, 0.9),
]
LEAST_WORDS = 8
_LETTER, _CAPITAL, _DIGIT, _SPACE, _OTHER = 1, 2, 3, 4, 5


def _classes() -> np.ndarray:
    table = np.full(0x250, _OTHER, np.int64)
    for c in range(0x250):
        s = chr(c)
        table[c] = _SPACE if s.isspace() else _DIGIT if s.isdigit() else _CAPITAL if s.isupper() else _LETTER if s.isalpha() else _OTHER
    for i, c in enumerate(range(33, 127)):
        if not chr(c).isalnum():
            table[c] = 6 + i
    return table


_CLASS = _classes()
_STEP = 128
_HASHED = np.array([xxhash.xxh32_intdigest(i.to_bytes(4, "little")) % DIMENSIONS for i in range(_STEP * _STEP)], np.int64)


_SIGN = r"[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]"  # no spaces between words
_WORD, _HAS_SIGN = re.compile(rf"{_SIGN}|[^\s\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]+"), re.compile(_SIGN)
#: Words in which repetition is measured, so that it does not grow with a text's length.
STRETCH = 100


def sameness(words: list[str]) -> float:
    """Share of words that have occurred before in their stretch of the text."""
    n = len(words)
    stretches = max(1, n // STRETCH)  # the last one is longer
    ends = [*range(STRETCH, STRETCH * stretches, STRETCH), n]
    return 1 - sum(len(set(words[s:e])) for s, e in zip([0, *ends], ends, strict=False)) / n


def measures(text: str) -> list[float] | None:
    """The labellers' measures; None if the text has too few words to vote on."""
    signs = _HAS_SIGN.search(text) is not None
    words = _WORD.findall(text) if signs else text.split()
    n = len(words)
    if n < LEAST_WORDS:
        return None
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    kind = _CLASS[np.minimum(codes, 0x24F)]
    letters = max(1, int(((kind == _LETTER) | (kind == _CAPITAL)).sum()))  # all signs from 0x24F on among them
    known = int((((kind == _LETTER) | (kind == _CAPITAL)) & (codes < 0x24F) | (codes >= 0x400) & (codes < 0x530)).sum())
    lowered = [w.strip(".,;:!?").lower() for w in words]
    return [
        sum(map(text.count, _SYMBOLS)) / len(text),
        sum(1 for w in words if len(w) <= 2 and not w.isalnum() and not w[0].isalnum()) / n,
        int((kind == _CAPITAL).sum()) / letters,
        sum(w.endswith("!") for w in words) / n,
        sum(map(operator.eq, lowered, lowered[1:])) / n,
        sameness(lowered) if n >= 40 else 0.5,
        1 - sum(map(FUNCTION_WORDS.__contains__, lowered)) / n if n >= 20 and 2 * known > letters else 0.95,
    ]


def vote(found: list[float] | None) -> str:
    """One character a labeller: ``+`` good, ``-`` bad, ``0`` no vote."""
    if found is None:
        return "0" * len(LABELLERS)
    return "".join("-" if found[i] >= bad else "+" if found[i] < good else "0" for _, i, bad, good in LABELLERS)


def features(text: str, found: list[float] | None) -> tuple[list[int], list[float]]:
    """Hashed features: places and values."""
    out = np.zeros(DIMENSIONS)
    if text:
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
        kind = _CLASS[np.minimum(codes, 0x24F)]
        runs = kind[np.concatenate(([True], kind[1:] != kind[:-1]))]
        if len(runs) > 1:
            out += np.bincount(_HASHED[runs[:-1] * _STEP + runs[1:]], minlength=DIMENSIONS) / (len(runs) - 1)
    for i, value in enumerate(found or ()):
        out[xxhash.xxh32_intdigest(f"{i}:{int(value * 20)}".encode()) % DIMENSIONS] += 1
    at = np.flatnonzero(out)
    return at.tolist(), out[at].tolist()


def describe(documents: DataFrame) -> DataFrame:
    """``doc_id, digest, votes, at, value`` of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t if isinstance(t, str) else "" for t in b["text"].array]
            found = [measures(t) for t in texts]
            hashed = [features(t, m) for t, m in zip(texts, found, strict=True)]
            yield pd.DataFrame({
                "doc_id": b["doc_id"],
                "digest": b["digest"],
                "votes": [vote(m) for m in found],
                "at": [at for at, _ in hashed],
                "value": [value for _, value in hashed],
            })

    # ids pass through as text: pandas would turn longs beside nulls into floats
    rows = clashless(documents, "doc_id", "text").select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64("text").alias("digest"), "text")
    described = rows.mapInPandas(run, "doc_id string, digest long, votes string, at array<int>, value array<float>")
    return described.withColumn("doc_id", F.col("doc_id").try_cast("long"))


def estimate(patterns: dict[str, int], iterations: int = ITERATIONS) -> tuple[dict[str, float], np.ndarray]:
    """``(posterior of good by pattern, P(vote is good | class) as class x labeller)`` by
    expectation-maximisation, started from the majority of votes. A labeller that does not vote
    says nothing about the class, so a pattern without votes has the prior."""
    names = sorted(patterns)
    if not names:
        return {}, np.zeros((2, len(LABELLERS)))
    votes = np.array([["-0+".index(v) for v in p] for p in names])
    bad, fine = (votes == 0).astype(float), (votes == 2).astype(float)
    count = np.array([patterns[p] for p in names], float)
    good = np.where(bad.any(axis=1), 0.2, 0.9)
    for _ in range(iterations):
        prior = np.clip((count * good).sum() / count.sum(), 0.01, 0.99)
        given = np.stack([((count * w) @ fine + 1) / ((count * w) @ (fine + bad) + 2) for w in (1 - good, good)])
        logs = fine @ np.log(given).T + bad @ np.log(1 - given).T + np.log([1 - prior, prior])
        good = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -50, 50)))
    if given[1].mean() < given[0].mean():  # the good class is the one for which labellers vote
        good, given = 1 - good, given[::-1]
    return dict(zip(names, good.tolist(), strict=True)), given


@dataclass(frozen=True)
class Model:
    """Weights of the scorer, its intercept, and what was estimated on the way."""

    weights: np.ndarray
    intercept: float
    posteriors: dict[str, float]
    accuracies: np.ndarray

    def score(self, at: list[int], value: list[float]) -> float:
        z = float(np.dot(self.weights[np.asarray(at, int)], np.asarray(value, float))) + self.intercept
        return 1 / (1 + np.exp(-max(-50.0, min(50.0, z))))


def train(rows: list[tuple[list[int], list[float], float]], steps: int = 300, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on posterior labels by accelerated gradient steps."""
    if not rows:
        return np.zeros(DIMENSIONS), 0.0
    x = np.zeros((len(rows), DIMENSIONS + 1), np.float32)
    y = np.array([label for *_, label in rows], np.float32)
    for i, (at, value, _) in enumerate(rows):
        x[i, at] = value
    x[:, -1] = 1
    rate = 4 / max(1e-6, float((x * x).sum(axis=1).max()))
    w, speed = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32)
    for k in range(steps):
        ahead = w + k / (k + 3) * speed
        gap = 1 / (1 + np.exp(-np.clip(x @ ahead, -50, 50))) - y
        after = ahead - rate * (x.T @ gap / len(y) + ridge * ahead)
        w, speed = after, after - w
    return w[:-1].astype(float), float(w[-1])


def fit(described: DataFrame, training_rows: int = TRAINING_ROWS) -> Model:
    """The model from stored rows of :func:`describe`."""
    patterns = {r.votes: r.n for r in described.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    posteriors, accuracies = estimate(patterns)
    # a share by hash first: otherwise every task would send the driver a whole sample
    steps = 1 << 24
    share = min(steps, -(-steps * 2 * training_rows // max(1, sum(patterns.values()))))
    key = F.xxhash64("doc_id", "digest")
    drawn = described.where(F.pmod(key, F.lit(steps)) < share).select("at", "value", "votes", key.alias("k"))
    sample = drawn.orderBy("k", "votes").limit(training_rows).collect()
    weights, intercept = train([(r["at"], r["value"], posteriors[r.votes]) for r in sample])
    return Model(weights, intercept, posteriors, accuracies)


def classify(documents: DataFrame, threshold: float = THRESHOLD, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """``doc_id, votes, weak_label, score, keep`` of every row."""
    described = materialise(describe(documents), "described")
    model = fit(described, training_rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            scores = [model.score(at, value) for at, value in zip(b["at"], b["value"], strict=True)]
            yield pd.DataFrame({
                "doc_id": b["doc_id"],
                "votes": b["votes"],
                "weak_label": [model.posteriors[v] for v in b["votes"]],
                "score": scores,
                "keep": [s >= threshold for s in scores],
            })

    rows = described.withColumn("doc_id", F.col("doc_id").cast("string"))
    judged = rows.mapInPandas(run, "doc_id string, votes string, weak_label double, score double, keep boolean")
    return judged.withColumn("doc_id", F.col("doc_id").cast("long"))


def keep_good(documents: DataFrame, threshold: float = THRESHOLD, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """The documents, with all their columns, that the scorer does not reject."""
    model = fit(materialise(describe(documents), "described"), training_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            yield b.filter(pa.array([model.score(*features(t, measures(t))) >= threshold for t in texts], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
