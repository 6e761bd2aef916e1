"""Every operator on odd documents and on none: whole results, defined values."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from histomill.llm import decontam, html_text, licenses, packing, quality, secrets, sentence_dedup, simhash, spotsigs, url_filter

RANKS, TOKENS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


def bench(spark):
    rows = [(1, "stone cloud garden window letter market bridge tree river stone cloud"), (2, None), (3, "  "), (None, "one"), (1, "one")]
    return spark.createDataFrame(rows, "item_id long, text string")


PER_ROW = {
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "secrets": lambda s, d: secrets.find_secrets(d),
    "spotsigs": lambda s, d: spotsigs.fingerprint(d),
    "spotsigs_classes": lambda s, d: spotsigs.near_duplicates(d),
    "licenses": lambda s, d: licenses.scan(d),
    "quality": lambda s, d: quality.classify(d),
    "sentence_dedup": lambda s, d: sentence_dedup.deduplicate(d),
    "decontam": lambda s, d: decontam.decontaminate(d, bench(s)),
    "html": lambda s, d: html_text.main_text(d.select(F.col("doc_id").alias("page_id"), F.col("lang").alias("url"), F.col("text").alias("html"), "n")),
    "urls": lambda s, d: url_filter.judge(d.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), "n"), [("a.org", "/", "block")]),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_a_row_for_every_row(spark, odd, texts, name):
    out = PER_ROW[name](spark, odd).collect()
    ids = sorted(str(r[0]) for r in out)
    assert ids == sorted(str(r[0]) for r in texts)


@pytest.mark.parametrize("name", PER_ROW)
def test_empty_table(spark, none, name):
    assert PER_ROW[name](spark, none).count() == 0


FILTERS = {
    "simhash": lambda s, d: simhash.keep_one(d),
    "quality": lambda s, d: quality.keep_good(d),
    "decontam": lambda s, d: decontam.clean_only(d, bench(s)),
    "secrets": lambda s, d: secrets.mask_documents(d),
}


@pytest.mark.parametrize("name", FILTERS)
def test_filters_keep_columns(spark, odd, none, name):
    assert FILTERS[name](spark, odd).columns == odd.columns
    assert FILTERS[name](spark, none).count() == 0


def test_packing_odd_rows(spark, odd, none, texts):
    rows = packing.pack(odd, RANKS, TOKENS).collect()
    firsts = [r for r in rows if r.piece == 0]
    assert sorted(str(r.doc_id) for r in firsts) == sorted(str(t[0]) for t in texts)
    assert [r.length for r in rows if r.doc_id == 2] == [1]
    assert packing.pack(none, RANKS, TOKENS).count() == 0


def test_defined_values(spark, odd):
    by = {r.doc_id: r for r in simhash.near_duplicates(odd).collect()}
    assert by[1].fp == by[2].fp == by[3].fp == 0 and by[3].component_id == 1
    assert by[5].fp == by[6].fp and by[6].component_id == by[5].component_id
    found = {r.doc_id: r for r in decontam.decontaminate(odd, bench(spark)).collect()}
    assert found[4]["items"] == ["1", "null"] and found[4].n_hit == 1
    assert found[1].n_words == found[2].n_words == 0 and not found[2].contaminated
    prints = {r.doc_id: r for r in spotsigs.fingerprint(odd).collect()}
    assert prints[5].sigs == prints[6].sigs and prints[2].n_chars == 0
    classes = {r.doc_id: r.class_id for r in spotsigs.near_duplicates(odd).collect()}
    assert classes[5] == classes[6] == classes[7] == 5
    scans = {r.doc_id: r for r in secrets.find_secrets(odd).collect()}
    assert scans[1].base_spans == scans[2].base_spans == "" and scans[10].n_access == 1
    empty = hashlib.sha256(b"").hexdigest()
    assert {r.digest for r in licenses.scan(odd).where("doc_id in (1, 2, 3)").collect()} == {empty}


def test_decontamination_beyond_the_broadcast(spark, odd, monkeypatch):
    want = sorted(map(str, decontam.decontaminate(odd, bench(spark), slop=2).collect()))
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)  # every join shuffles
    assert sorted(map(str, decontam.decontaminate(odd, bench(spark), slop=2).collect())) == want


@pytest.mark.parametrize("empty", [False, True])
def test_odd_documents_through_the_pipeline(spark, odd, none, tmp_path, empty):
    """Stages keep columns and types whatever the rows hold, with ``text`` in any place."""
    import corpus_pipeline

    docs = (none if empty else odd).select("n", "lang", "doc_id", "digest", "text", "fp", "votes", "w", F.length("text").alias("n_chars"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["n", "lang", "doc_id", "digest", "text", "fp", "votes", "w", "n_chars"], name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.count() <= before and docs.where("text IS NOT NULL AND n_chars <> length(text)").isEmpty(), name
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert (not rows) if empty else {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}


def test_ids_that_are_no_numbers(spark):
    docs = spark.createDataFrame([("a", "one two three"), ("7", "one two three"), (None, "x")], "doc_id string, text string")
    assert {r.doc_id for r in packing.pack(docs, RANKS, TOKENS).collect()} == {None, 7}
    assert {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).where("digest IS NOT NULL").collect()} >= {(7, 7), (None, 7)}
    assert {r.doc_id for r in quality.classify(docs).collect()} == {r.doc_id for r in sentence_dedup.deduplicate(docs).collect()} == {None, 7}
    assert spotsigs.fingerprint(docs).count() == 3 == decontam.decontaminate(docs, bench(spark)).count() == secrets.find_secrets(docs).count()
    assert simhash.keep_one(docs).count() == 2
