"""Streams of arriving files: incremental extraction and running statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from srcatlas.functions import names
from srcatlas.functions.text import count_lines
from srcatlas.operators.comments import extract_comments
from srcatlas.operators.imports import extract_imports
from srcatlas.operators.signatures import extract_signatures
from srcatlas.operators.todos import extract_todos
from srcatlas.sinks.writers import write_incrementally
from srcatlas.sources import listings
from srcatlas.sources.tables import from_binary_files
from srcatlas.streaming import commits

BINARY_FILE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)

#: Groups that files share for the state of their counts, and what a group keeps of each; a change of either needs a new checkpoint.
STATE_GROUPS = 1 << 14
FILE_STATE = "repos array<string>, paths array<string>, times array<bigint>, lines array<bigint>"

#: Files of one batch, and those that are worth a task where the executors list them.
BATCH_FILES = 25_000
TASK_FILES = 250
LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"

EXTRACTORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "comments": extract_comments,
    "signatures": extract_signatures,
    "todos": extract_todos,
    "imports": extract_imports,
}


def stream_corpus(spark: SparkSession, path: str, repo: str, log: str | None = None) -> DataFrame:
    """Files as they arrive in a folder.

    Uses the built-in binary file source, which leaves out names that start
    with a dot or an underscore. A batch has at most ``BATCH_FILES`` of them;
    further ones come in further batches.

    That source keeps the names of all files on the driver. With ``log``, a
    folder for each query, the executors list the folder and read the files
    instead, and the driver holds nothing for a single file (``sources/listings``). The folder is listed
    when this is called; ``listings.log_listing`` adds what came since, also while the query runs.

    The built-in source gives a task 32 small files at most, as it counts the opening of
    one as 4 MB, and lists a batch's files again by up to 10,000 tasks. Both are
    done by as many tasks here as a shuffle has; the setting for the listing stays in the session.
    """
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    if log is not None:
        listings.log_listing(spark, path, log, BATCH_FILES)
        return listings.stream_listed(spark, path, repo, log, min(tasks, -(-BATCH_FILES // TASK_FILES)))
    listing = int(spark.conf.get(LISTING_TASKS, "10000"))
    spark.conf.set(LISTING_TASKS, str(min(listing, tasks)))
    found = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", BATCH_FILES)
        .load(path)
    )
    return from_binary_files(found, path, repo).coalesce(tasks)


def start_extraction(files: DataFrame, kind: str, target: str, checkpoint: str) -> StreamingQuery:
    """Append the rows of one extractor to a Parquet table, then stop at the end of the input.

    The extractors keep no state, so the stream needs none either.
    """
    return (
        EXTRACTORS[kind](files)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def running_counts(files: DataFrame, by: str = "language") -> DataFrame:
    """(repo, ``by``, files, lines) over the files so far; ``by`` is ``language`` or ``ext``."""
    ext = names.file_ext(F.col("path"))
    key = {"ext": ext, "language": names.language_of(ext)}[by]
    lines = count_lines(F.col("content"), F.col("size_bytes"))
    plain = files.where(~F.coalesce(F.col("is_dir"), F.lit(False))).select("repo", key.alias(by), lines.alias("lines"))
    return plain.groupBy("repo", by).agg(F.count("*").alias("files"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"))


def start_counts(files: DataFrame, target: str, checkpoint: str, by: str = "language") -> StreamingQuery:
    """Running counts per repository and language (or extension); each batch replaces the one before as a whole.

    Counts only grow: a file that is delivered again counts again. Where files change or go, use ``start_file_counts``.
    The state, and so a batch's table, has a row for each repository and language.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        commits.commit(batch, target, batch_id)

    return write_incrementally(running_counts(files, by), write, checkpoint, "complete")


def count_changes(files: DataFrame, by: str = "language") -> DataFrame:
    """(repo, ``by``, files, lines): what each change of a file adds to and takes from the counts.

    ``files`` is a stream of file rows, each a new version of (repo, path) or, with ``removed`` set, its end. A file's last
    contribution is kept as state, so that a version takes back what the one before it added. Versions count by ``mtime``: one
    that is not later than the last is passed over, of several in a batch the latest counts.

    Files share ``STATE_GROUPS`` groups by a hash of their names, as Python is called once a group, and a call costs as much as
    some thousand files. A batch writes the groups anew in which it has files. Progress of a query with one group for
    each file, as it was before, can't be gone on with.
    """
    ext = names.file_ext(F.col("path"))
    key = {"ext": ext, "language": names.language_of(ext)}[by]
    removed = F.coalesce(F.col("removed"), F.lit(False)) if "removed" in files.columns else F.lit(False)
    lines = F.when(~removed, F.coalesce(count_lines(F.col("content"), F.col("size_bytes")), F.lit(0)))
    # No content goes to the state.
    versions = files.where(~F.coalesce(F.col("is_dir"), F.lit(False))).select(
        "repo", "path", key.alias(by), F.unix_micros("mtime").alias("at"), lines.cast("bigint").alias("lines"),
        F.pmod(F.xxhash64("repo", "path"), F.lit(STATE_GROUPS)).cast("int").alias("state_group"),
    )

    def change(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        latest: dict[tuple, tuple] = {}
        for frame in frames:
            for repo, path, value, at, count in zip(frame["repo"], frame["path"], frame[by], frame["at"], frame["lines"], strict=True):
                # At one time a removal comes last, then the longer version.
                order = (int(at), pd.isna(count), 0 if pd.isna(count) else int(count))
                file = (_text(repo), _text(path))
                if file not in latest or order > latest[file][0]:
                    latest[file] = (order, _text(value))
        repos, paths, times, counts = state.get if state.exists else ([], [], [], [])
        # Time and lines of every file's last version; a file that is gone has no lines.
        known = dict(zip(zip(repos, paths, strict=True), zip(times, counts, strict=True), strict=True))
        new, moved = False, []
        for file, ((at, gone, count), value) in latest.items():
            old_at, old_count = known.get(file, (None, None))
            if old_at is not None and at <= old_at:
                continue
            known[file], new = (at, None if gone else count), True
            step = (int(not gone) - int(old_count is not None), count - (old_count or 0))
            if any(step):
                moved.append((file[0], value, *step))
        if new:
            state.update(([f[0] for f in known], [f[1] for f in known], [v[0] for v in known.values()], [v[1] for v in known.values()]))
        if moved:
            yield pd.DataFrame(moved, columns=["repo", by, "files", "lines"])

    return versions.groupBy("state_group").applyInPandasWithState(
        change, f"repo string, {by} string, files bigint, lines bigint", FILE_STATE, "update", GroupStateTimeout.NoTimeout
    )


def _text(value: str | float | None) -> str | None:
    return value if isinstance(value, str) else None


def start_file_counts(files: DataFrame, target: str, checkpoint: str, by: str = "language") -> StreamingQuery:
    """Counts of the files as they are now, also where files are rewritten or removed; each batch is there whole or not at all."""

    def write(batch: DataFrame, batch_id: int) -> None:
        last = commits.last_batch(target)
        if last is not None and last >= batch_id:
            # The rows are there already, the state of this batch isn't.
            batch.write.format("noop").mode("overwrite").save()
            return
        before = commits.read_last(batch.sparkSession, target)
        rows = batch if before is None else batch.unionByName(before)
        counted = rows.groupBy("repo", by).agg(F.sum("files").alias("files"), F.sum("lines").alias("lines"))
        commits.commit(counted.where("files > 0"), target, batch_id)

    return write_incrementally(count_changes(files, by), write, checkpoint, "update")


def latest_counts(spark: SparkSession, target: str) -> DataFrame:
    """The counts after the last whole batch."""
    return commits.read_last(spark, target)
