"""Directory scan that sees every name and never follows a link.

Folders are read where they are mounted on the executors, stores through Arrow's
file systems. The walk goes level by level: the directories of a level are a table, each one
is listed by some task, and the directories found are the next level. A
repository with very many directories is thus spread over all tasks. Contents
are read in a second step, only for the rows that are still wanted.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcatlas.functions.globs import name_matches
from srcatlas.operators.filters import GIT_DIR
from srcatlas.session import materialize
from srcatlas.sources.stores import file_system, local_path

ENTRY = (
    "repo string, root string, path string, size_bytes bigint, mtime timestamp, "
    "is_symlink boolean, is_dir boolean, error string"
)
NAMES = [f.split()[0] for f in ENTRY.split(", ")]
BATCH_ROWS = 10_000
BATCH_BYTES = 32 << 20


def _children(root: str, path: str, follow: bool = False) -> Iterator[tuple]:
    """(path, size, time in microseconds, is_symlink, is_dir, error) of the entries of one directory.

    Local folders are read with their links as links, or with ``follow`` as what they lead to; stores have none.
    """
    local = local_path(root)
    if local is None:
        store, base = file_system(root)
        for info in store.get_file_info(fs.FileSelector(f"{base}/{path}" if path else base)):
            rel = f"{path}/{info.base_name}" if path else info.base_name
            folder = info.type == fs.FileType.Directory
            yield rel, 0 if folder else info.size, (info.mtime_ns or 0) // 1000 or None, False, folder, None
        return
    with os.scandir(os.path.join(local, path) if path else local) as listing:
        for entry in listing:
            rel = f"{path}/{entry.name}" if path else entry.name
            try:
                stat = entry.stat(follow_symlinks=follow)
                link, folder = not follow and entry.is_symlink(), entry.is_dir(follow_symlinks=follow)
            except OSError as error:
                yield rel, None, None, False, False, str(error)
                continue
            yield rel, 0 if folder else stat.st_size, stat.st_mtime_ns // 1000, link, folder, None


def _list_directories(batches: Iterator[pd.DataFrame], follow: bool = False) -> Iterator[pd.DataFrame]:
    rows: list[tuple] = []

    def flush() -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=NAMES)
        frame["mtime"] = pd.to_datetime(frame["mtime"], unit="us", utc=True)
        frame["size_bytes"] = frame["size_bytes"].astype("Int64")
        rows.clear()
        return frame

    for batch in batches:
        for repo, root, path in zip(batch["repo"], batch["root"], batch["path"]):
            try:
                for entry in _children(root, path, follow):
                    rows.append((repo, root, *entry))
                    if len(rows) >= BATCH_ROWS:
                        yield flush()
            except OSError as error:
                if not path:
                    raise FileNotFoundError(f"root {root} can't be listed: {error}") from error
                # The directory itself was listed by its parent; this row only tells what happened.
                rows.append((repo, root, path, None, None, False, None, str(error)))
    if rows:
        yield flush()


def _read_contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        start, held, contents, errors = 0, 0, [], []
        for i, (root, path, size) in enumerate(zip(batch["root"], batch["path"], batch["size_bytes"])):
            try:
                store, base = file_system(root)
                with store.open_input_stream(f"{base}/{path}", compression=None) as f:
                    contents.append(f.read())
                errors.append(None)
            except OSError as error:
                contents.append(None)
                errors.append(str(error))
            held += int(size or 0)
            if held >= BATCH_BYTES:
                yield batch.iloc[start : i + 1].assign(error=errors, content=contents)
                start, held, contents, errors = i + 1, 0, [], []
        if contents:
            yield batch.iloc[start:].assign(error=errors, content=contents)


def list_entries(
    roots: DataFrame, ignore_names: Sequence[str] = (), hidden: Callable[[Column], Column] | None = None, follow: bool = False
) -> DataFrame:
    """(repo, root, path, size_bytes, mtime, is_symlink, is_dir, error) without contents.

    ``roots`` holds (repo, root): folders that all executors reach, or addresses
    of stores. A root that can't be listed is an error; below, a path that can't be read has
    ``error`` set. ``.git`` and ignored names are pruned with
    their subtrees while walking, and so are names of which ``hidden`` is true. With ``follow``, links are what they lead to. Each level is written to the shared folder,
    so a lost executor never repeats the levels before.
    """
    spark = roots.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    name = F.substring_index("path", "/", -1)
    wanted = (name != GIT_DIR) & ~name_matches(name, list(ignore_names))
    if hidden is not None:
        wanted &= ~hidden(name)

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _list_directories(batches, follow)

    level = roots.select("repo", "root", F.lit("").alias("path"))
    levels = []
    while True:
        found = level.repartition(tasks, "repo", "path").mapInPandas(listed, ENTRY).where(wanted)
        levels.append(materialize(found, "scan"))
        level = levels[-1].where("is_dir AND error IS NULL").select("repo", "root", "path")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, levels)


def read_contents(entries: DataFrame) -> DataFrame:
    """The ``files`` table for the given entries, with ``error``; directories and links hold no content."""
    tasks = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    plain = F.coalesce(~F.col("is_dir") & ~F.col("is_symlink") & F.col("error").isNull(), F.lit(False))
    read = entries.where(plain).repartition(tasks, "repo", "path").mapInPandas(_read_contents, ENTRY + ", content binary")
    rest = entries.where(~plain).withColumn("content", F.lit(None).cast("binary"))
    return read.unionByName(rest).drop("root")


def scan_dirs(roots: DataFrame, ignore_names: Sequence[str] = (), max_file_size: int | None = None) -> DataFrame:
    """Scan directory trees into a ``files`` table.

    Every file is read; where ``max_file_size`` is given, larger ones are listed with NULL content.
    What can't be read is left out or has NULL content; ``scan_with_errors`` tells which.
    """
    found = scan_with_errors(roots, ignore_names, max_file_size)
    return found.where("is_dir IS NOT NULL").drop("error")


def scan_with_errors(roots: DataFrame, ignore_names: Sequence[str] = (), max_file_size: int | None = None) -> DataFrame:
    """The same with a column ``error``; an unreadable directory has a second row for it, with NULL ``is_dir``."""
    entries = list_entries(roots, ignore_names)
    if max_file_size is None:
        return read_contents(entries)
    large = F.coalesce(F.col("size_bytes") > max_file_size, F.lit(False))
    unread = entries.where(large).drop("root").withColumn("content", F.lit(None).cast("binary"))
    return read_contents(entries.where(~large)).unionByName(unread)
