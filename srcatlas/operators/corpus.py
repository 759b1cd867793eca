"""Shared front end of the extractors: gates, text and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcatlas.functions import names, text


def within_size_cap(size: Column, cap: int) -> Column:
    return size <= cap


def has_known_extension(canon_ext: Column) -> Column:
    return canon_ext.isNotNull()


# What a file row says besides its content.
NAMED = ["size_bytes", "mtime", "is_symlink", "is_dir"]


def with_text(files: DataFrame, max_file_size: int | None = None, every: bool = False) -> DataFrame:
    """Files that can be extracted from: known extension, valid UTF-8.

    Gives (repo, path, canon_ext, text). Files of any size pass unless
    ``max_file_size`` names a limit. The size and name gates stand below the
    content read, so a columnar scan prunes on them first. With ``every`` no
    file is left out: what can't be extracted from has a NULL text, and the
    columns of ``NAMED`` stay.
    """
    canon = names.canonical_ext(names.file_ext(F.col("path")))
    gated = files
    if every:
        readable = canon.isNotNull() & ~F.col("is_symlink")
        if max_file_size is not None:
            readable = readable & within_size_cap(F.col("size_bytes"), max_file_size)
        plain = files.where(~F.coalesce(F.col("is_dir"), F.lit(False)))
        return plain.select(
            "repo", "path", *NAMED, canon.alias("canon_ext"), F.when(readable, F.col("content")).alias("content")
        ).select("repo", "path", *NAMED, "canon_ext", F.explode(F.array(text.decoded(F.col("content")))).alias("text"))
    if "is_dir" in files.columns:
        gated = gated.where(~F.coalesce(F.col("is_dir"), F.lit(False)))
    if "is_symlink" in files.columns:
        gated = gated.where(~F.coalesce(F.col("is_symlink"), F.lit(False)))
    if max_file_size is not None:
        gated = gated.where(within_size_cap(F.col("size_bytes"), max_file_size))
    return (
        gated.select("repo", "path", "content", canon.alias("canon_ext"))
        .where(has_known_extension(F.col("canon_ext")))
        .select(
            "repo",
            "path",
            "canon_ext",
            F.explode(F.array_compact(F.array(text.decoded(F.col("content"))))).alias("text"),
        )
    )


def source_lines(files: DataFrame, **gates: int | None) -> DataFrame:
    """(repo, path, canon_ext, line, content): one row per line, numbered from 1."""
    return (
        with_text(files, **gates)
        .select("repo", "path", "canon_ext", F.posexplode(text.lines(F.col("text"))))
        .select("repo", "path", "canon_ext", (F.col("pos") + 1).alias("line"), F.col("col").alias("content"))
    )
