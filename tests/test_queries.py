"""Every registered query against the same query in SQL on another engine."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as contract
from srcatlas.plans.catalog import QUERIES
from srcatlas.plans.oracle import SQL

duckdb = pytest.importorskip("duckdb")
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for table in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    picked = [tuple(v[i] for i in order) for v in values]
    return sorted(picked, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, other, name):
    want = other.execute(SQL[name])
    names = [c[0] for c in want.description]
    df = QUERIES[name](spark, SF_DIR)
    assert sorted(df.columns) == sorted(names)
    types = {"VARCHAR": "string", "BIGINT": "bigint", "BOOLEAN": "boolean"}
    assert {c[0]: types[str(c[1])] for c in want.description} == {
        f.name: f.dataType.simpleString() for f in df.schema.fields
    }
    expected = rows(names, want.fetchall())
    assert expected, "the query must find something"
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == expected


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_derived_corpus_is_made_again_when_cleared(spark, monkeypatch):
    from srcatlas.plans import bridge

    first = bridge.code_files(spark, SF_DIR).count()
    monkeypatch.setattr(bridge, "_WRITTEN", {k: v + "-gone" for k, v in bridge._WRITTEN.items()})
    assert bridge.code_files(spark, SF_DIR).count() == first


def test_derived_files_hold_every_word(spark):
    from pyspark.sql import functions as F

    from srcatlas.plans import bridge

    assert all("$x" in pattern for family in bridge.LINE_PATTERNS for pattern in bridge.whole(family))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(60).collect()}
    files = bridge.code_files(spark, SF_DIR).withColumn("doc_id", F.regexp_extract("path", r"doc_(\d+)", 1).cast("bigint"))
    for row in files.where(F.col("doc_id").isin(list(docs))).collect():
        text = row.content.decode()
        words = set(docs[row.doc_id].replace(".", " ").split())
        assert all(w in text for w in words)


def test_streams_run_in_batches(spark, tmp_path):
    from srcatlas.plans.catalog import _document_stream
    from srcatlas.streaming import jobs

    out = str(tmp_path / "todos")
    stream = jobs.start_extraction(_document_stream(spark, SF_DIR), "todos", out, out + "-progress")
    stream.awaitTermination()
    assert len({p["batchId"] for p in stream.recentProgress if p["numInputRows"]}) >= 2
