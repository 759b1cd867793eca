"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcatlas.llm import (
    bpe_prefix,
    decontaminate,
    exact,
    htmltext,
    langid,
    lexical,
    neighbours,
    quality,
    runs,
    simhash,
    substring,
    token_count,
    toxicity,
)
from srcatlas.llm.common import held_out, read, sha256_hex
from srcatlas.llm.oracle import SQL


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near copies of every document."""
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth one."""
    return neighbours.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that benchmark windows cover."""
    found = decontaminate.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    digest = sha256_hex(F.array_join("items", ","))
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document without those that repeat an earlier window."""
    found = substring.dedup_substrings(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", sha256_hex("kept").alias("kept_sha256"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return htmltext.extract(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return token_count.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, as digests."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe_prefix.encode(read(spark, sf_dir, "documents"), path)
    return bpe_prefix.decode(encoded, path).select(
        "doc_id", "n_tokens", sha256_hex("ids").alias("ids_sha256"), sha256_hex("decoded").alias("decoded_sha256")
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs = read(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs)).select("doc_id", "score", "posterior", "keep")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = read(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(docs, ~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous", "rejected")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), ~held_out("id"))
    return toxicity.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, a tenth of them with repeats made by rule."""
    found = runs.periodic_runs(runs.with_repeats(read(spark, sf_dir, "documents"))).withColumn("top", runs.longest_run(F.col("runs")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "top.start",
        "top.length",
        "top.period",
        F.expr("1000 * top.length DIV top.period").alias("exponent_milli"),
        runs.runs_digest(F.col("runs")).alias("runs_sha256"),
        sha256_hex("collapsed").alias("collapsed_sha256"),
    )


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best documents of every benchmark item."""
    found = lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", "doc_id", "score")


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of equal texts of every document."""
    found = exact.deduplicate(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_nearest": op2_nearest,
    "op3_decontamination": op3_decontamination,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_main_text": op5_main_text,
    "op6_token_counts": op6_token_counts,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_quality": op8_quality,
    "op9_language_id": op9_language_id,
    "op10_toxicity": op10_toxicity,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_lexical_search": op12_lexical_search,
    "op13_exact_dedup": op13_exact_dedup,
}

__all__ = ["QUERIES", "SQL"]
