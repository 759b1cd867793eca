"""Files read in ranges of bytes, so that one file may be larger than a row and is read by several tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from srcatlas.operators.chunks import CHUNK_BYTES
from srcatlas.sources.stores import file_system

CHUNKS = StructType(
    [StructField("repo", StringType()), StructField("path", StringType()), StructField("seq", LongType()), StructField("content", BinaryType())]
)


def read_chunks(entries: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table of listed entries (``dirscan.list_entries``): one row for every ``chunk_bytes`` bytes of a plain file.

    The ranges of a file are dealt over the tasks like those of all others. A file that can't be read, or is
    shorter than listed, is an error of its task.
    """
    plain = F.coalesce(~F.col("is_dir") & ~F.col("is_symlink") & F.col("error").isNull(), F.lit(False))
    last = F.floor(F.greatest(F.col("size_bytes") - 1, F.lit(0)) / chunk_bytes).cast("bigint")
    ranges = entries.where(plain).select("repo", "path", "root", "size_bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("seq"))
    tasks = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, base = file_system(row["root"])
                at = row["seq"] * chunk_bytes
                want = min(chunk_bytes, row["size_bytes"] - at)
                with store.open_input_file(f"{base}/{row['path']}") as f:
                    data = f.read_at(want, at) if want else b""
                if len(data) != want:
                    raise OSError(f"{row['path']} has changed since it was listed")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["repo"]]), pa.array([row["path"]]), pa.array([row["seq"]]), pa.array([data], pa.binary())], names=CHUNKS.names
                )

    return ranges.repartition(tasks, "repo", "path", "seq").mapInArrow(run, CHUNKS)
