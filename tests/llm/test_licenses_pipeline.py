import importlib

import duckdb
import pytest

from tarnwick.llm import licenses


def test_texts_and_notices(spark, odd_docs, no_docs):
    mit = dict(licenses.TEXTS[:1])["MIT"]
    wrapped = "Copyright (c) 2020 Some Body\nAll rights reserved.\n\n" + mit.replace("sublicense", "sub-license").replace(" ", "\n  ").upper()
    rows = [(1, mit), (2, wrapped), (3, mit + " And more."), (4, "prose\nLicenced under CC BY-NC 4.0\nmore"), (5, "Licensed under CC BY-NC 4.0 or so"), (6, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.license_id, r.notices) for r in licenses.scan_licenses(docs).collect()}
    assert got[1][0] == got[2][0] == "MIT" and got[3] == (None, [])
    assert got[4] == (None, ["CC-BY-NC-4.0"]) and got[5] == (None, []) and got[6] == (None, []) and got[7] == (None, [])
    named = {r.notices[0] for r in licenses.scan_licenses(spark.createDataFrame([(1, "x\n* Released under the MIT Licence\ny")], "doc_id long, text string")).collect()}
    assert named == {"MIT"}
    assert licenses.scan_licenses(odd_docs).count() == odd_docs.count() and licenses.scan_licenses(no_docs).count() == 0


def test_sql_gives_the_same(spark):
    con = duckdb.connect()
    con.sql("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    want = sorted(con.sql(licenses.scan_sql()).fetchall())
    rows = licenses.scan_licenses(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    assert sorted((r.doc_id, r.digest, r.license_id, ",".join(r.notices)) for r in rows) == want


def test_pipeline_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {r.doc_id for r in docs.collect()}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        ids = {r.doc_id for r in out.collect()}
        assert ids and ids <= seen
        docs, seen = out, ids
    rows = pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == seen


def test_entry_has_every_query():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert "pipeline" in names and sum(n.startswith("op") for n in names) == 10
    assert set(entry.oracle_sql()) <= set(names)
