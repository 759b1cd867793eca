"""Listings: nodes, sibling flags, ranks and branch prefixes."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcatlas.functions import names
from srcatlas.operators import filters, ignore
from srcatlas.operators.skew import number_rows, spread_join
from srcatlas.operators.stats import directories

# Branch glyphs.
BRANCH_OPEN = "│   "
BRANCH_CLOSED = "    "
CONNECTOR = "├── "
LAST_CONNECTOR = "└── "


PLAIN_COLUMNS = ["repo", "path", "size_bytes", "mtime", "is_symlink", "is_dir"]


def _listable(files: DataFrame, ignore_names: Sequence[str]) -> DataFrame:
    """Entries but links, ``.git`` and those left out by name."""
    path = F.col("path")
    return files.where(
        filters.not_symlink(F.col("is_symlink")) & filters.outside_git_dir(path) & filters.not_ignored_by_name(path, ignore_names)
    )


def listed_files(
    files: DataFrame,
    *,
    rules: DataFrame | None = None,
    tracked: DataFrame | None = None,
    show_all: bool = False,
    ignore_names: Sequence[str] = (),
    newer: dt.datetime | str | None = None,
    older: dt.datetime | str | None = None,
    max_depth: int | None = None,
    with_todos: DataFrame | None = None,
) -> DataFrame:
    """The rows of ``files``, with all columns, that a listing with these wishes shows.

    ``files`` may carry more than the files table does, such as sections; only
    names are compared with rules and tracked paths.
    """
    base = _listable(files, ignore_names)
    plain = base.where(~F.coalesce(F.col("is_dir"), F.lit(False)))
    if not show_all and rules is not None:
        passed, _ = ignore.included(base.select(*PLAIN_COLUMNS), rules)
        narrow = set(files.columns) <= set(PLAIN_COLUMNS)
        plain = passed.select(*files.columns) if narrow else plain.join(passed.select("repo", "path"), ["repo", "path"], "left_semi")
    elif not show_all and tracked is not None:
        plain = ignore.tracked_files(plain, tracked)
    return _narrowed(plain, newer, older, max_depth, with_todos)


def _narrowed(
    plain: DataFrame, newer: dt.datetime | str | None, older: dt.datetime | str | None, max_depth: int | None, with_todos: DataFrame | None
) -> DataFrame:
    if newer is not None:
        plain = plain.where(filters.newer_than(F.col("mtime"), newer))
    if older is not None:
        plain = plain.where(filters.older_than(F.col("mtime"), older))
    if with_todos is not None:
        plain = plain.join(with_todos.select("repo", "path"), ["repo", "path"], "left_semi")
    if max_depth is not None:
        plain = plain.where(filters.within_depth(F.col("path"), max_depth))
    return plain


def list_nodes(
    files: DataFrame,
    *,
    rules: DataFrame | None = None,
    tracked: DataFrame | None = None,
    show_all: bool = False,
    ignore_names: Sequence[str] = (),
    newer: dt.datetime | str | None = None,
    older: dt.datetime | str | None = None,
    max_depth: int | None = None,
    dirs_only: bool = False,
    rules_hide_dirs: bool = False,
    with_todos: DataFrame | None = None,
) -> DataFrame:
    """Nodes of the listing: (repo, path, parent, name, depth, node_type, size_bytes).

    Links and ``.git`` are never listed. Directories stay when they pass the
    rules or lead to a file that does, even if time or task filters empty them;
    ``dirs_only`` lists directories whatever the rules say unless
    ``rules_hide_dirs`` is set. ``with_todos`` keeps files found in that table.
    ``show_all`` skips the rules and the tracked set.
    """
    path = F.col("path")
    names_only = files.select(*PLAIN_COLUMNS)
    base = _listable(names_only, ignore_names)
    plain, dirs = base.where(~F.coalesce(F.col("is_dir"), F.lit(False))), directories(base)
    hide = not dirs_only or rules_hide_dirs
    if not show_all and rules is not None:
        plain, kept_dirs = ignore.included(base, rules)
        # All directories above a file that passes have passed themselves.
        dirs = kept_dirs if hide else dirs
    elif not show_all and tracked is not None:
        plain = ignore.tracked_files(plain, tracked)
        dirs = ignore.tracked_dirs(dirs, tracked) if hide else dirs
    if max_depth is not None:
        dirs = dirs.where(filters.within_depth(path, max_depth))
    no_size = F.lit(None).cast("bigint").alias("size_bytes")
    roots = files.select("repo").distinct().select("repo", F.lit("").alias("path"))
    nodes = roots.unionByName(dirs).select("repo", "path", F.lit("dir").alias("node_type"), no_size)
    if not dirs_only:
        plain = _narrowed(plain, newer, older, max_depth, with_todos)
        nodes = nodes.unionByName(plain.select("repo", "path", F.lit("file").alias("node_type"), "size_bytes"))
    return with_places(nodes)


def with_places(rows: DataFrame) -> DataFrame:
    """Add ``parent``, ``name`` and ``depth``."""
    path = F.col("path")
    return rows.select(
        "repo",
        "path",
        names.parent_path(path).alias("parent"),
        names.base_name(path).alias("name"),
        names.path_depth(path).alias("depth"),
        *[c for c in rows.columns if c not in ("repo", "path")],
    )


def end_siblings(nodes: DataFrame) -> DataFrame:
    """(repo, parent, first, last, entries): first and last entry of each directory, and how many there are.

    Smallest and largest names are found with partial aggregation, so one very
    wide directory is never gathered or sorted in a single task.
    """
    return nodes.where(F.col("depth") > 0).groupBy("repo", "parent").agg(
        F.min("name").alias("first"), F.max("name").alias("last"), F.count("*").alias("entries")
    )


def _child(parent: Column, name: Column) -> Column:
    return F.when(parent == "", name).otherwise(F.concat(parent, F.lit("/"), name))


def with_last_flag(nodes: DataFrame, first: bool = False) -> DataFrame:
    """Add ``is_last`` (or ``is_first``) among the siblings that are shown.

    The join key is the sibling's own path, which is unique on both sides.
    """
    end, flag = ("first", "is_first") if first else ("last", "is_last")
    ends = end_siblings(nodes).select(
        "repo", _child(F.col("parent"), F.col(end)).alias("path"), F.lit(True).alias("__end")
    )
    return (
        nodes.join(ends, ["repo", "path"], "left")
        .withColumn(flag, F.coalesce("__end", F.lit(False)))
        .drop("__end")
    )


def with_sibling_rank(nodes: DataFrame) -> DataFrame:
    """Add ``sibling_rank``, from 1 in each directory, by raw name."""
    return number_rows(nodes, ["repo", "parent"], ["name"], "sibling_rank")


def with_preorder(nodes: DataFrame) -> DataFrame:
    """Add ``preorder``, from 1 at each root, in depth-first order."""
    return number_rows(nodes, ["repo"], [names.sort_key(F.col("path"))], "preorder")


def directory_frame(nodes: DataFrame) -> DataFrame:
    """(repo, parent, first, last, entries, prefix): what the entries of a directory need to be drawn.

    The prefix is put together once per directory from the last flags of the
    directories on its path.
    """
    path = F.col("path")
    ends = end_siblings(nodes)
    dirs = nodes.where((F.col("node_type") == "dir") & (F.col("depth") > 0))
    closed = dirs.join(ends, ["repo", "parent"]).select("repo", "path", (F.col("name") == F.col("last")).alias("closed"))
    chains = closed.select(
        "repo", "path", F.posexplode(F.concat(names.ancestors(path, False), F.array(path))).alias("pos", "up")
    )
    glyph = F.when(F.col("closed"), F.lit(BRANCH_CLOSED)).otherwise(F.lit(BRANCH_OPEN))
    # One list entry per directory level of one path.
    below = (
        chains.join(closed.select("repo", F.col("path").alias("up"), "closed"), ["repo", "up"])
        .groupBy("repo", F.col("path").alias("parent"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", glyph.alias("g")))).alias("gs"))
        .select("repo", "parent", F.array_join(F.transform("gs", lambda x: x["g"]), "").alias("prefix"))
    )
    return ends.join(below, ["repo", "parent"], "left").withColumn("prefix", F.coalesce("prefix", F.lit("")))


def in_frame(rows: DataFrame, frame: DataFrame) -> DataFrame:
    """Add ``is_first``, ``is_last``, ``prefix`` and ``connector`` to rows with a parent, a name and a depth.

    One join, on the parent; a directory with very many entries, as the frame
    tells, is dealt over several tasks.
    """
    below = F.col("depth") > 0
    counted = frame.select("repo", "parent", F.col("entries").alias("count"))
    placed = spread_join(rows, frame.drop("entries"), ["repo", "parent"], ["path"], "left", counted)
    is_last = below & F.coalesce(F.col("name") == F.col("last"), F.lit(False))
    connector = F.when(~below, F.lit("")).when(is_last, F.lit(LAST_CONNECTOR)).otherwise(F.lit(CONNECTOR))
    return placed.withColumns(
        {
            "is_first": below & F.coalesce(F.col("name") == F.col("first"), F.lit(False)),
            "is_last": is_last,
            "prefix": F.coalesce("prefix", F.lit("")),
            "connector": connector,
        }
    ).drop("first", "last")


def drawn_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes with ``is_first``, ``is_last``, ``prefix`` and ``connector``."""
    return in_frame(nodes, directory_frame(nodes))


def continuation_prefix(prefix: Column, is_last: Column) -> Column:
    """Prefix of the rows below an entry."""
    return F.concat(prefix, F.when(is_last, F.lit(BRANCH_CLOSED)).otherwise(F.lit(BRANCH_OPEN)))
