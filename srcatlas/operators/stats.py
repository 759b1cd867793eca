"""Counts by extension, language, directory and module."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcatlas.functions import names
from srcatlas.functions.text import count_lines
from srcatlas.operators import filters, tour
from srcatlas.operators.imports import CATEGORIES
from srcatlas.operators.todos import MARKERS


def countable_files(files: DataFrame, show_hidden: bool = False) -> DataFrame:
    """Plain files that statistics look at: no links, no ``.git``, hidden ones on request."""
    path = F.col("path")
    kept = files.where(filters.not_symlink(F.col("is_symlink")) & filters.outside_git_dir(path))
    return kept if show_hidden else kept.where(filters.not_hidden(path))


def extension_counts(files: DataFrame, with_lines: bool = True) -> DataFrame:
    """(repo, ext, files, lines).

    Without lines the content column is not read at all. A file too large to
    count adds no lines but counts as a file.
    """
    plain = files.where(~F.coalesce(F.col("is_dir"), F.lit(False)))
    ext = names.file_ext(F.col("path")).alias("ext")
    if not with_lines:
        return plain.select("repo", ext).groupBy("repo", "ext").agg(F.count("*").alias("files"))
    lines = count_lines(F.col("content"), F.col("size_bytes")).alias("lines")
    return (
        plain.select("repo", ext, lines)
        .groupBy("repo", "ext")
        .agg(F.count("*").alias("files"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"))
    )


def language_extensions(files: DataFrame, with_lines: bool = True) -> DataFrame:
    """(repo, language, ext, files, lines): one row per extension, however many a language has.

    The language lookup runs after the aggregation, on few rows, and its table has a fixed size.
    """
    by_ext = extension_counts(files, with_lines)
    table = F.broadcast(names.language_table(files.sparkSession))
    named = by_ext.join(table, "ext", "left").withColumn(
        "language", F.coalesce("language", F.lit(names.UNKNOWN_LANGUAGE))
    )
    lines = F.col("lines") if with_lines else F.lit(None).cast("bigint")
    return named.select("repo", "language", "ext", "files", lines.alias("lines"))


def language_stats(files: DataFrame, with_lines: bool = True) -> DataFrame:
    """(repo, language, files, lines)."""
    return _by_language(language_extensions(files, with_lines))


def _by_language(extensions: DataFrame, *more: Column) -> DataFrame:
    return extensions.groupBy("repo", "language").agg(F.sum("files").alias("files"), F.sum("lines").alias("lines"), *more)


def listed_language_stats(extensions: DataFrame) -> DataFrame:
    """(repo, language, files, lines, extensions) with a language's extensions as one list, as a printed report has it.

    For output only: "Other" holds every odd ending of a repository.
    """
    dotted = F.when(F.col("ext") != "", F.concat(F.lit("."), F.col("ext")))
    return _by_language(extensions, F.array_sort(F.collect_set(dotted)).alias("extensions"))


def directories(files: DataFrame, with_root: bool = False) -> DataFrame:
    """(repo, path) of every directory: listed ones and all ancestors of any entry.

    One pass: paths shrink to distinct parents before the ancestors are
    spelled out, and both steps drop repeats before they shuffle.
    """
    path = F.col("path")
    seen = F.array(
        F.when(F.col("is_dir"), path), names.parent_path(path), F.lit("") if with_root else F.lit(None)
    )
    own = files.select("repo", F.explode(F.array_distinct(F.array_compact(seen))).alias("path")).distinct()
    spelled = F.concat(names.ancestors(path, include_root=False), F.array(path))
    every = own.select("repo", F.explode(spelled).alias("path")).distinct()
    return every if with_root else every.where(path != "")


def codebase_totals(files: DataFrame, with_lines: bool = True) -> DataFrame:
    """(repo, files, directories, total_lines); the root directory is not counted."""
    by_ext = extension_counts(files, with_lines)
    lines = F.sum("lines") if with_lines else F.lit(None).cast("bigint")
    totals = by_ext.groupBy("repo").agg(F.sum("files").alias("files"), lines.alias("total_lines"))
    dirs = directories(files).groupBy("repo").agg(F.count("*").alias("directories"))
    return totals.join(dirs, "repo", "full").select(
        "repo",
        F.coalesce("files", F.lit(0)).alias("files"),
        F.coalesce("directories", F.lit(0)).alias("directories"),
        "total_lines",
    )


def listing_counts(nodes: DataFrame) -> DataFrame:
    """(repo, directories, files) of a listing; the root is not counted."""
    is_dir = F.col("node_type") == "dir"
    return nodes.groupBy("repo").agg(
        F.count_if(is_dir & (F.col("depth") > 0)).alias("directories"),
        F.count_if(~is_dir).alias("files"),
    )


def directory_rollup(files: DataFrame, extra: dict[str, str] | None = None) -> DataFrame:
    """(repo, path, dirs, files, bytes, …) of every directory's whole subtree.

    Files are summed per parent first, so a directory with very many files costs one row per partition; a
    walk in preorder then adds the directories up (``tour``). ``extra`` maps an output name to a column of whole numbers
    to be summed too.
    """
    path = F.col("path")
    sums = {"bytes": "size_bytes", **(extra or {})}
    is_dir = F.coalesce(F.col("is_dir"), F.lit(False))
    own = (
        files.select("repo", F.when(is_dir, path).otherwise(names.parent_path(path)).alias("path"), is_dir.alias("is_dir"), *sums.values())
        .where(path.isNotNull())
        .groupBy("repo", "path")
        .agg(
            F.count_if(~F.col("is_dir")).alias("files"),
            *[F.coalesce(F.sum(F.when(~F.col("is_dir"), F.col(c))), F.lit(0)).cast("bigint").alias(n) for n, c in sums.items()],
        )
    )
    zero = F.lit(0).cast("bigint")
    # Every directory counts itself once, wherever the ranges of the walk are cut.
    every = tour.closed_directories(own).select("repo", "path", F.lit(1).cast("bigint").alias("dirs"), *[zero.alias(n) for n in ("files", *sums)])
    rows = every.unionByName(own.select("repo", "path", zero.alias("dirs"), "files", *sums))
    totals = tour.subtree_sums(rows, ["dirs", "files", *sums])
    return totals.withColumn("dirs", F.col("dirs") - 1)


def stats_rollup(files: DataFrame, with_lines: bool = True) -> DataFrame:
    """Totals per (repo, language), per repo and overall, told apart by ``level``.

    Built on the counts per extension, so the rollup expands few rows.
    """
    by_ext = extension_counts(files, with_lines)
    lines = F.sum("lines") if with_lines else F.lit(None).cast("bigint")
    named = by_ext.withColumn("language", names.language_of(F.col("ext")))
    return named.rollup("repo", "language").agg(
        F.grouping_id().cast("int").alias("level"), F.sum("files").alias("files"), lines.alias("lines")
    )


def todos_by_marker(todos: DataFrame) -> DataFrame:
    """(repo, language, one column per marker): task counts."""
    language = names.language_of(names.file_ext(F.col("path")))
    return (
        todos.select("repo", language.alias("language"), "marker")
        .groupBy("repo", "language")
        .pivot("marker", MARKERS)
        .count()
        .na.fill(0, MARKERS)
    )


def todos_per_file(todos: DataFrame) -> DataFrame:
    return todos.groupBy("repo", "path").agg(F.count("*").alias("todos"))


def import_usage(wide_imports: DataFrame) -> DataFrame:
    """(category, module, imports, files): how often and by how many files a module is used.

    Each statement counts as an import; one more row per distinct module of a
    file counts the file. Both are plain sums with map-side partial results,
    even for a module that everyone imports.
    """
    def rows(category: str, statement: int):
        items = F.col("imports")[category]
        return F.transform(
            items if statement else F.array_distinct(items),
            lambda m: F.struct(
                F.lit(category).alias("category"),
                m.alias("module"),
                F.lit(statement).alias("imports"),
                F.lit(1 - statement).alias("files"),
            ),
        )

    every = F.concat(*[rows(c, s) for c in CATEGORIES for s in (1, 0)])
    return (
        wide_imports.select(F.explode(every).alias("u"))
        .select("u.*")
        .groupBy("category", "module")
        .agg(F.sum("imports").alias("imports"), F.sum("files").alias("files"))
    )


def symbols_by_language(signatures: DataFrame) -> DataFrame:
    """(language, symbols, files); file counts come from the per-file sums."""
    per_file = signatures.groupBy("repo", "path").agg(F.count("*").alias("n"))
    return (
        per_file.select(names.language_of(names.file_ext(F.col("path"))).alias("language"), "n")
        .groupBy("language")
        .agg(F.sum("n").alias("symbols"), F.count("*").alias("files"))
    )


def top_files(files: DataFrame, measure: str, k: int) -> DataFrame:
    """The k files with the highest measure; ties by repo and path."""
    return files.orderBy(F.desc(measure), "repo", "path").limit(k)


def languages_by_files(stats: DataFrame) -> DataFrame:
    """Language statistics in report order with a rank per repository.

    A repository has at most as many rows as there are languages.
    """
    by = Window.partitionBy("repo").orderBy(F.desc("files"), "language")
    return stats.withColumn("rank", F.row_number().over(by))
