"""The corpus pipeline: stages over the documents, each written and read again by the next.

Every stage is ``f(spark, docs, sf_dir)``; all but the last return the columns of documents, in
their order and types, whatever other columns there are. An empty table stays one in every stage,
and gives no pieces; a very long text is one text like any other. What else is odd is defined by
stage below.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from histomill.llm import decontam, packing, quality, secrets, simhash
from histomill.llm.common import materialise
from histomill.llm.queries import RANKS, TOKENS, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. A null or blank text is judged by its empty
    features; repeated rows are judged alike."""
    return quality.keep_good(docs)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates stays: the smallest id, a null id last,
    and of equal ids the smallest digest of the text. Null and blank texts are one group. Of rows that
    repeat id and text one stays."""
    return simhash.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark window occurs go. Null and blank texts stay."""
    return decontam.clean_only(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays, and ``n_chars`` is renewed. A null text stays null."""
    return secrets.mask_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in their training sequences. A null text is empty: its end token alone."""
    return packing.pack(docs, public_tokenizers.path(RANKS), public_tokenizers.path(TOKENS))


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontaminate", drop_benchmark_leaks),
    ("secrets", mask_secrets),
    ("pack", pack),
]

#: A trained scorer and a tokenizer cannot be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
