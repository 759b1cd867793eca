"""Corpus, tracked-path and status tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcatlas.schema import FILES, STATUS, TRACKED, require_columns


def read_corpus(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The ``files`` table. Content is read only by queries that use it."""
    return require_columns(spark.read.format(fmt).load(path), FILES).select(*FILES.names)


def read_tracked(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """(repo, path) of tracked files, such as a saved index listing."""
    reader = spark.read.format(fmt)
    if fmt in ("csv", "json"):
        reader = reader.schema(TRACKED)
    return require_columns(reader.load(path), TRACKED).select(*TRACKED.names)


def read_status(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return require_columns(spark.read.format(fmt).load(path), STATUS).select(*STATUS.names)


def read_binary_files(spark: SparkSession, path: str, repo: str) -> DataFrame:
    """Convenience reader on the built-in binary file source.

    That source leaves out every name that starts with a dot or an underscore
    and follows links; use ``scan_dirs`` where those matter.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return from_binary_files(found, path, repo)


def from_binary_files(found: DataFrame, root: str, repo: str) -> DataFrame:
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    full = F.regexp_replace("path", r"^[a-z0-9]+:/+", "")
    return found.select(
        F.lit(repo).alias("repo"),
        F.substring(full, len(base) + 2, 1 << 30).alias("path"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("mtime"),
        F.lit(False).alias("is_symlink"),
        F.lit(False).alias("is_dir"),
        F.col("content"),
    )
