"""Queries with SQL give the SQL's rows; the pipeline gives what its stages give one by one."""

import duckdb
import pytest

import corpus_pipeline
from histomill.llm import decontam, licenses, queries, secrets


@pytest.mark.parametrize("name", queries.ORACLES)
def test_query_equals_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got = queries.QUERIES[name](spark, data).toPandas()
    want = con.execute(queries.ORACLES[name]).df()
    spell = lambda f: sorted(tuple(map(str, row)) for row in f[sorted(f.columns)].astype(object).where(f[sorted(f.columns)].notna(), None).values)
    assert sorted(got.columns) == sorted(want.columns) and spell(got) == spell(want)


def test_near_matches(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "x b a d c e g f h j i x"), (3, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "a b c d e f g h i j")], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.decontaminate(docs, bench, slop=3).collect()}
    assert got[1].contaminated and got[1].near_items == ["7"]
    assert not got[2].contaminated and got[2].near_items == ["7"] and got[3].near_items == []


def test_licences(spark):
    isc = dict(reversed(licenses.registry()))["ISC"].upper().replace("LICENSE", "LICENCE") + "\nCopyright (c) 2020 Somebody. All rights reserved"
    rows = [(1, isc), (2, "text\nReleased under the MIT licence!\nmore"), (3, "about licences")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].license, got[2].license, got[3].license) == ("ISC", None, None)
    assert (got[2].notices, got[3].notices) == ("MIT", "")


def test_pipeline(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    before = docs.count()
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data).cache()
        sizes.append(docs.count())
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert before > sizes[0] > sizes[1] > sizes[2] == sizes[3]
    rows = docs.collect()
    assert all(r.n_chars == len(r.text) and not secrets.scan(r.text) for r in rows)
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    assert decontam.decontaminate(docs, bench).where("contaminated").count() == 0
    packed = corpus_pipeline.run(spark, data).select("doc_id", "piece", "length", "ids_crc32").collect()
    again = corpus_pipeline.STAGES[-1][1](spark, docs, data).select("doc_id", "piece", "length", "ids_crc32").collect()
    assert sorted(map(tuple, packed)) == sorted(map(tuple, again))
    assert {r.doc_id for r in packed} == {r.doc_id for r in rows}
