"""Sinks: tables, JSON records and ordered reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from srcatlas.operators.reports import REPORT_ORDER
from srcatlas.sources.stores import file_system


def write_table(df: DataFrame, path: str, mode: str = "errorifexists", by_repo: bool = False) -> None:
    """Write a flat Parquet table.

    With ``by_repo`` the rows land in one folder per repository. They are
    range-sorted first, so that small repositories share a task and give one
    file each, while a very large one is cut over many tasks.
    """
    if not by_repo:
        df.write.mode(mode).parquet(path)
        return
    order = [c for c in ("repo", "path") if c in df.columns]
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).partitionBy(
        "repo"
    ).parquet(path)


def write_json_records(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line."""
    records.select("json").write.mode(mode).text(path)


def write_report(rows: DataFrame, path: str, mode: str = "errorifexists", by_repo: bool = True) -> None:
    """Write report rows in document order.

    A range sort by (repo, sort_key, seq) spreads even a single huge document
    over many tasks; the part files in name order are the document.
    """
    ordered = rows.repartitionByRange(*REPORT_ORDER).sortWithinPartitions(*REPORT_ORDER)
    if by_repo:
        ordered.select("repo", "text").write.mode(mode).partitionBy("repo").text(path)
    else:
        ordered.select("text").write.mode(mode).text(path)


def write_incrementally(
    stream: DataFrame, consume: Callable[[DataFrame, int], None], checkpoint: str, output_mode: str = "append"
) -> StreamingQuery:
    """Hand every micro-batch to ``consume`` as soon as it is there."""
    return (
        stream.writeStream.outputMode(output_mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(consume)
        .start()
    )


def write_files(files: DataFrame, root: str) -> int:
    """Write every file's bytes below ``root``/repo/path and return their number.

    The root may be a folder that all executors reach or the address of a store.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = file_system(root)
        made: set[str] = set()
        for batch in batches:
            for repo, path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                target = f"{base}/{repo}/{path}"
                folder = target.rpartition("/")[0]
                if folder not in made:
                    store.create_dir(folder)
                    made.add(folder)
                with store.open_output_stream(target) as out:
                    out.write(content or b"")
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], names=["written"])

    plain = files.where("NOT coalesce(is_dir, false) AND NOT coalesce(is_symlink, false)")
    counted = plain.select("repo", "path", "content").mapInArrow(run, "written bigint")
    return counted.agg({"written": "sum"}).first()[0] or 0
