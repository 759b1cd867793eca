"""Reports as documents of which any directory can be found.

A report's rows are range-sorted and written by all tasks, each one part; the parts in order are the documents of all
repositories, one behind the other. Next to its part, a task writes the places of what it wrote: one row per stretch of rows of one
path, with the first byte and the number of bytes. The driver gets the name and the size of each part only; it puts a small file in
place by one move that names the parts in order, so that a reader sees the report before or the whole new one.
Parts of tasks that failed, or that ran twice, are named by nothing.

A directory's rows are neighbours in a report, so that it is one range of bytes in each of a few parts.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs, parquet
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from srcatlas.operators.reports import REPORT_ORDER
from srcatlas.sources.stores import file_system

FORMAT = "srcatlas_documents"
#: Bytes of a part that are read at once.
READ_BYTES = 1 << 20
PLACES = pa.schema([("repo", pa.string()), ("path", pa.string()), ("part", pa.string()), ("first", pa.int64()), ("bytes", pa.int64())])


@dataclass
class Part(WriterCommitMessage):
    """What one task wrote."""

    number: int
    name: str
    size: int


class Documents(DataSource):
    """Takes rows (repo, path, text) that are in order."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return DocumentWriter(self.options["path"], self.options["folder"])


class DocumentWriter(DataSourceArrowWriter):
    def __init__(self, target: str, folder: str):
        self.target, self.folder = target, folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        number = TaskContext.get().partitionId()
        name = f"part-{number:06d}-{uuid.uuid4().hex}"
        store, base = file_system(self.target)
        at = f"{base}/{self.folder}"
        store.create_dir(at)
        size = 0
        with store.open_output_stream(f"{at}/{name}.txt") as text:
            with parquet.ParquetWriter(f"{at}/{name}.parquet", PLACES, filesystem=store) as places:
                for batch in iterator:
                    if len(batch):
                        found = _places(batch, name, size)
                        places.write_table(found)
                        text.write("\n".join(t or "" for t in batch["text"].to_pylist()).encode() + b"\n")
                        size += pc.sum(found["bytes"]).as_py()
        return Part(number, name, size)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.number)
        entry = {"folder": self.folder, "parts": [[p.name, p.size] for p in parts if p.size]}
        store, base = file_system(self.target)
        for name in ("pending", "commits"):
            store.create_dir(f"{base}/{name}")
        pending = f"{base}/pending/{self.folder}"
        with store.open_output_stream(pending) as out:
            out.write(json.dumps(entry).encode())
        store.move(pending, f"{base}/commits/{self.folder}.json")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Nothing names the parts; what is there stays until its owner clears it."""


def _places(batch: pa.RecordBatch, part: str, size: int) -> pa.Table:
    """One row per stretch of rows of one path in a batch that begins at byte ``size``."""
    lengths = np.asarray(pc.add(pc.fill_null(pc.binary_length(batch["text"]), 0), 1), dtype=np.int64)
    change = np.zeros(len(batch), dtype=bool)
    change[0] = True
    for column in ("repo", "path"):
        ids = np.asarray(batch[column].dictionary_encode(null_encoding="encode").indices)
        change[1:] |= ids[1:] != ids[:-1]
    starts = np.flatnonzero(change)
    sums = np.add.reduceat(lengths, starts)
    firsts = size + np.concatenate(([0], np.cumsum(sums)[:-1]))
    return pa.table(
        [batch["repo"].take(starts), batch["path"].take(starts), pa.array([part] * len(starts)), firsts, sums], schema=PLACES
    )


def write_documents(rows: DataFrame, target: str) -> None:
    """Write a report's rows (repo, path, sort_key, seq, text) as documents, in place of those written before.

    Every row ends in a newline; a null text is an empty row. ``target`` is a folder or store that driver and executors reach.
    """
    spark = rows.sparkSession
    spark.dataSource.register(Documents)
    before = _last(target)
    number = int(before["folder"].split("-")[1]) + 1 if before else 0
    ordered = rows.repartitionByRange(*REPORT_ORDER).sortWithinPartitions(*REPORT_ORDER).select("repo", "path", "text")
    ordered.write.format(FORMAT).mode("append").option("folder", f"data-{number:012d}-{uuid.uuid4().hex}").save(target)


def _last(target: str) -> dict | None:
    store, base = file_system(target)
    found = store.get_file_info(fs.FileSelector(f"{base}/commits", allow_not_found=True))
    names = sorted(i.path for i in found if i.base_name.endswith(".json"))
    if not names:
        return None
    with store.open_input_stream(names[-1]) as f:
        return json.loads(f.read())


def places(spark: SparkSession, target: str) -> DataFrame:
    """(repo, path, part, part_number, part_first, first, bytes): where the rows of every path lie.

    ``first`` counts from the part's beginning; ``part_first`` is the place of the part's first byte in all parts together.
    """
    entry = _last(target)
    if entry is None:
        raise FileNotFoundError(f"no documents in {target}")
    at, parts = 0, []
    for number, (name, size) in enumerate(entry["parts"]):
        parts.append((name, number, at))
        at += size
    known = spark.createDataFrame(parts, "part string, part_number int, part_first bigint")
    if not parts:
        return known.selectExpr("'' AS repo", "'' AS path", "*", "part_first AS first", "part_first AS bytes")
    # One row per part, as many as the writing tasks.
    found = spark.read.parquet(*[f"{target}/{entry['folder']}/{name}.parquet" for name, _ in entry["parts"]])
    return found.join(F.broadcast(known), "part").select("repo", "path", "part", "part_number", "part_first", "first", "bytes")


def path_places(spark: SparkSession, target: str) -> DataFrame:
    """(repo, path, first_byte, bytes): of every path its place in its repository's document and the bytes of its own rows."""
    first = F.col("part_first") + F.col("first")
    found = places(spark, target).groupBy("repo", "path").agg(F.min(first).alias("first_byte"), F.sum("bytes").alias("bytes"))
    starts = found.groupBy("repo").agg(F.min("first_byte").alias("start"))
    return found.join(starts, "repo").select("repo", "path", (F.col("first_byte") - F.col("start")).alias("first_byte"), "bytes")


def document_ranges(spark: SparkSession, target: str, repo: str, path: str = "") -> list[tuple[str, int, int]]:
    """(file, first byte, end) of each part that holds rows of a file or of a directory and all below it, in order.

    The number of ranges is at most that of the parts. The root is the whole document.
    """
    inside = F.col("repo") == repo
    if path:
        inside &= (F.col("path") == path) | F.startswith(F.col("path"), F.lit(path + "/"))
    ends = F.max(F.col("first") + F.col("bytes")).alias("end")
    found = places(spark, target).where(inside).groupBy("part_number", "part").agg(F.min("first").alias("first"), ends)
    folder = _last(target)["folder"]
    return [(f"{target}/{folder}/{r.part}.txt", r.first, r.end) for r in found.orderBy("part_number").collect()]


def read_document(spark: SparkSession, target: str, repo: str, path: str = "") -> Iterator[bytes]:
    """The bytes of a document, or of one directory or file in it, piece by piece; nothing for what isn't in it."""
    for name, first, end in document_ranges(spark, target, repo, path):
        store, at = file_system(name)
        with store.open_input_file(at) as f:
            f.seek(first)
            while first < end:
                piece = f.read(min(READ_BYTES, end - first))
                first += len(piece)
                yield piece
