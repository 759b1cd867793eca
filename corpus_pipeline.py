"""The corpus pipeline: documents through language ID, deduplication, decontamination and encoding.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; its result is written and
read again as the next stage's documents. All but the last return the columns of documents. What an operator does with
nulls, empty texts and repeated rows is said in its module.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from srcatlas.llm import bpe_prefix, decontaminate, langid, simhash, substring
from srcatlas.llm.common import held_out, read
from srcatlas.session import materialize


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; texts that are null or have no letters go."""
    return langid.accepted(docs, langid.fit(docs, ~held_out()))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest key."""
    return simhash.deduplicate(docs, shingle=3, max_bits=2)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without words under windows of 20 that start earlier."""
    return substring.without_repeats(docs, window=20)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"), window=10)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, in decimal joined by one space, and the text that they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    decoded = bpe_prefix.decode(bpe_prefix.encode(docs, path), path)
    return decoded.selectExpr("doc_id", "n_tokens", "ids", "cast(decoded as string) AS text")


STAGES = [
    ("language ID", language_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", benchmark_stage),
    ("byte-level BPE", encoding_stage),
]

#: The stages can't be put in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
