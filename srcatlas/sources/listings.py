"""Files as they arrive, listed and read by the executors: the driver holds parts of a list, never a file's name.

``log_listing`` lists a folder as ``dirscan`` does, directory by directory, leaves out what the log has and adds the rest to the log,
oldest files first, in parts of a bounded number of files. ``stream_listed`` is a stream over the log; a batch is one part,
and its files are read where the part's rows are dealt to. What the driver remembers grows with the number of parts.

Names count as in Spark's file source: those that start with a dot or, without an equals sign, with an underscore are left out
with all below them, links are followed, and empty files don't arrive until they have content. A file arrives once, by its path. One
that goes between listing and reading is left out; one that changes is read as it is.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from srcatlas.operators.skew import number_rows
from srcatlas.schema import FILES
from srcatlas.session import shared_folder
from srcatlas.sources.dirscan import BATCH_BYTES, list_entries
from srcatlas.sources.stores import file_system

LISTED = "path string, size_bytes bigint, mtime timestamp"
#: A path that is there no longer, or a link that leads nowhere.
GONE = "No such file|does not exist|Too many levels of symbolic links"


def _hidden(name: Column) -> Column:
    return name.startswith(".") | (name.startswith("_") & ~name.contains("=")) | name.endswith("._COPYING_")


def _parts(log: str) -> int:
    store, base = file_system(log)
    return sum(i.base_name.endswith(".parquet") for i in store.get_file_info(fs.FileSelector(base, allow_not_found=True)))


def log_listing(spark: SparkSession, path: str, log: str, part_files: int) -> int:
    """Add the files of a folder that the log doesn't have, at most ``part_files`` in a part; the number of new parts.

    One look at a time. It may be taken while a stream reads the log; one that is stopped has added its first parts, and the next
    one adds the others.
    """
    entries = list_entries(spark.createDataFrame([("", path)], "repo string, root string"), hidden=_hidden, follow=True)
    unread = entries.where(F.col("error").isNotNull() & ~F.col("error").rlike(GONE)).select("path", "error").first()
    if unread:
        raise OSError(f"{unread.path} can't be listed: {unread.error}")
    # Spark's file source has milliseconds.
    files = entries.where("error IS NULL AND NOT is_dir AND size_bytes > 0").select(
        "path", "size_bytes", F.date_trunc("millisecond", "mtime").alias("mtime")
    )
    before = _parts(log)
    if before:
        files = files.join(spark.read.schema(LISTED).parquet(log).select("path"), "path", "left_anti")
    numbered = number_rows(files, [], ["mtime", "path"], "number")
    staged = os.path.join(shared_folder(spark), f"listing-{uuid.uuid4().hex}")
    part = F.floor((F.col("number") - 1) / part_files)
    numbered.select("path", "size_bytes", "mtime", part.alias("part")).repartition("part").write.partitionBy("part").parquet(staged)
    return _put_in_place(staged, log, before)


def _put_in_place(staged: str, log: str, before: int) -> int:
    """Copy the parts in their order, as a stream takes files by their time; each is there whole or not at all."""
    source, base = file_system(staged)
    found = [i.path for i in source.get_file_info(fs.FileSelector(base, recursive=True)) if i.base_name.endswith(".parquet")]
    store, to = file_system(log)
    for name in (to, f"{to}/_pending"):
        store.create_dir(name)
    for k, path in enumerate(sorted(found, key=lambda p: int(p.rsplit("/", 2)[1].partition("=")[2]))):
        pending = f"{to}/_pending/{uuid.uuid4().hex}"
        with source.open_input_stream(path) as part, store.open_output_stream(pending) as out:
            out.write(part.read())
        store.move(pending, f"{to}/{before + k:020d}.parquet")
        time.sleep(0.002)
    return len(found)


def stream_listed(spark: SparkSession, path: str, repo: str, log: str, tasks: int) -> DataFrame:
    """The ``files`` rows of what the log lists, one part of it a batch."""
    schema = to_arrow_schema(FILES)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = file_system(path)
        for batch in batches:
            kept, contents, held = [], [], 0
            for i, name in enumerate(batch.column("path").to_pylist()):
                try:
                    with store.open_input_stream(f"{base}/{name}", compression=None) as f:
                        content = f.read()
                except FileNotFoundError:
                    continue
                if content:
                    kept.append(i)
                    contents.append(content)
                    held += len(content)
                if held >= BATCH_BYTES:
                    yield files(batch, kept, contents)
                    kept, contents, held = [], [], 0
            if kept:
                yield files(batch, kept, contents)

    def files(batch: pa.RecordBatch, kept: list[int], contents: list[bytes]) -> pa.RecordBatch:
        rows = batch.take(pa.array(kept, pa.int64()))
        columns = {
            "repo": [repo] * len(kept), "path": rows.column("path"), "size_bytes": [len(c) for c in contents], "mtime": rows.column("mtime"),
            "is_symlink": [False] * len(kept), "is_dir": [False] * len(kept), "content": contents,
        }
        arrays = [c.cast(f.type) if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in schema]
        return pa.RecordBatch.from_arrays(arrays, names=schema.names)

    listed = spark.readStream.schema(LISTED).option("maxFilesPerTrigger", 1).parquet(log)
    return listed.repartition(tasks).mapInArrow(read, FILES)
