from __future__ import annotations

import os
import re

import pytest

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def item_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF_DIR):
        pytest.skip("test tables are not there")
    return SF_DIR


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with extra columns whose names the operators use inside."""

    def build(rows, key="doc_id BIGINT"):
        full = [(i, text, "x", 7, None, "o") for i, text in rows]
        return spark.createDataFrame(full, f"{key}, text STRING, id STRING, fp INT, n INT, others STRING")

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, blank and very long texts, repeated rows."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    return [
        (1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one two"), (6, "One two THREE four five six seven"), (6, "One two THREE four five six seven"),
        (7, long), (8, long + " end"), (None, "one two three four five six seven"), (9, "é ñ ß 日本   z"), (10, "a" * 50_000), (11, "  spaced   out  "),
    ]
