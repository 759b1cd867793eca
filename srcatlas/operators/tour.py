"""Sums over subtrees by one walk over the directories in preorder.

Directories are range-sorted so that a subtree is a run of neighbouring rows. Each task walks its range with the
path from the root as a stack: a directory that is left hands its sums to the one above it and gives one row. Only
the directories on the path at the ends of a range give a row in more than one task; these rows are added up. The rows are thus
as many as the directories, however deep they lie, and no path is spelled out into its ancestors.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType, StructField, StructType

#: Rows that are handed on together.
BATCH_ROWS = 10_000


def _preorder(path: Column) -> Column:
    """Key whose order puts a directory right before its subtree; no path holds U+0000."""
    return F.replace(path, F.lit("/"), F.lit("\0"))


def _in_preorder(rows: DataFrame) -> DataFrame:
    key = _preorder(F.col("path"))
    return rows.repartitionByRange("repo", key).sortWithinPartitions("repo", key)


def _walk(rows: DataFrame, measures: Sequence[str]) -> DataFrame:
    """(repo, path, measures): of every directory on the way to a row what lies at or below it in a task's range."""
    schema = StructType([StructField("repo", StringType()), StructField("path", StringType()), *[rows.schema[m] for m in measures]])
    types = [to_arrow_type(f.dataType) for f in schema.fields]
    zero = [0] * len(measures)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        repo: str | None = None
        open_: list[tuple[str, str, list]] = []  # component, path, sums

        def leave(depth: int) -> None:
            while len(open_) > depth:
                _, path, sums = open_.pop()
                out.append((repo, path, *sums))
                if open_:
                    above = open_[-1][2]
                    for i, v in enumerate(sums):
                        above[i] += v

        def flushed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=schema.names)
            out.clear()
            return batch

        for batch in batches:
            for row_repo, path, *values in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row_repo != repo or not open_:
                    leave(0)
                    repo = row_repo
                    open_.append(("", "", list(zero)))
                parts = path.split("/") if path else []
                same = 0
                while same < len(parts) and same + 1 < len(open_) and open_[same + 1][0] == parts[same]:
                    same += 1
                leave(same + 1)
                for part in parts[same:]:
                    above = open_[-1][1]
                    open_.append((part, f"{above}/{part}" if above else part, list(zero)))
                sums = open_[-1][2]
                for i, v in enumerate(values):
                    sums[i] += v or 0
                if len(out) >= BATCH_ROWS:
                    yield flushed()
        leave(0)
        if out:
            yield flushed()

    return _in_preorder(rows.select("repo", "path", *measures)).mapInArrow(run, schema)


def subtree_sums(rows: DataFrame, measures: Sequence[str]) -> DataFrame:
    """(repo, path, measures): sums of whole numbers over each directory's subtree, for every directory at or above a row's path."""
    return _walk(rows, measures).groupBy("repo", "path").agg(*[F.sum(m).alias(m) for m in measures])


def closed_directories(paths: DataFrame) -> DataFrame:
    """(repo, path) of the given directories and all above them, the root too; each is found where the walk enters it."""
    return _walk(paths.select("repo", "path").distinct(), []).distinct()
