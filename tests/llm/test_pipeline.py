from __future__ import annotations

import pytest
from test_simhash import brute_components, brute_print
from test_words import brute_hits, brute_kept

import __spark_entry__ as contract
import corpus_pipeline
from srcatlas.llm import queries


def test_stages_against_brute_force(spark, sf_dir, documents):
    import public_tokenizers

    from srcatlas.llm import bpe_prefix

    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    left = sorted((i, t) for i, t in documents if any(c.isalpha() for c in t or ""))
    names = brute_components([brute_print(t) for _, t in left])
    left = [row for at, row in enumerate(left) if names[at] == at]
    kept = {k: (gone, text) for k, _, gone, text in brute_kept(left)}
    left = [(k, kept[k][1] if kept[k][0] else t) for k, t in left]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    hit = {k for k, _, n, _ in brute_hits(left, items) if n}
    left = [row for row in left if row[0] not in hit]
    codec = bpe_prefix.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = codec.encode([t for _, t in left])
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.text, r.ids.encode()) for r in out) == [(k, t, i) for (k, t), i in zip(left, ids, strict=True)]
    assert hit and len(left) < table.count()


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1], ids=lambda s: s[0])
def test_columns_stay(spark, sf_dir, stage):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert stage[1](spark, docs, sf_dir).dtypes == docs.dtypes


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_odd_documents(spark, sf_dir, stage):
    rows = [
        (1, None, None, None, None), (2, "", "en", "s", 0), (3, "the the the", None, "s", 11), (3, "the the the", None, "s", 11),
        (None, "words of a text without a key", "en", None, None), (4, "der Hund " * 5000, "de", "s", 45000), (5, "12 34", "en", "s", 5),
    ]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")
    out = stage[1](spark, docs, sf_dir)
    assert out.count() <= len(rows) and out.where("doc_id = 4").count() == 1 and out.where("doc_id IS NULL").count() == 1
    assert stage[1](spark, docs.where("false"), sf_dir).count() == 0


def test_registration():
    assert [name.split("_")[0] for name in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert set(queries.QUERIES) | {"pipeline"} <= set(contract.queries()) and len(corpus_pipeline.STAGES) == 5
    assert set(queries.SQL) <= set(contract.oracle_sql())
