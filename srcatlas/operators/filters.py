"""Predicates over the file table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from srcatlas.functions.globs import any_component_matches
from srcatlas.functions.names import path_depth

GIT_DIR = ".git"


def outside_git_dir(path: Column) -> Column:
    return ~F.array_contains(F.split(path, "/"), GIT_DIR)


def not_ignored_by_name(path: Column, patterns: Sequence[str]) -> Column:
    """No component equals or matches a pattern: a matched directory hides its subtree."""
    return ~any_component_matches(path, tuple(patterns)) if patterns else F.lit(True)


def not_symlink(is_symlink: Column) -> Column:
    return ~F.coalesce(is_symlink, F.lit(False))


def _instant(when: dt.datetime | str | Column) -> Column:
    return when if isinstance(when, Column) else F.lit(when).cast("timestamp")


def newer_than(mtime: Column, cutoff: dt.datetime | str | Column) -> Column:
    """Modified at or after the cutoff; an unknown time passes."""
    return mtime.isNull() | (mtime >= _instant(cutoff))


def older_than(mtime: Column, cutoff: dt.datetime | str | Column) -> Column:
    """Modified at or before the cutoff; an unknown time passes."""
    return mtime.isNull() | (mtime <= _instant(cutoff))


def within_depth(path: Column, limit: int) -> Column:
    return path_depth(path) <= limit


def not_hidden(path: Column) -> Column:
    return ~F.exists(F.split(path, "/"), lambda c: F.startswith(c, F.lit(".")))
