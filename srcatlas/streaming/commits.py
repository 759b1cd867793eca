"""Batches that are there whole or not at all.

A batch is written to a folder of its own; then a small file in ``commits`` names it, put in place by one move. Readers
look at ``commits`` only, so that they see the batch before until the next one is whole, and never a part of one.
A batch that was stopped leaves a folder that no commit names; run again, it is written anew. A batch whose commit is there is
not applied a second time.
"""

from __future__ import annotations

import json
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from srcatlas.sources.stores import file_system


def committed(target: str) -> list[dict]:
    """The commits of a table, oldest first: ``batch`` and ``folder``."""
    store, base = file_system(target)
    found = []
    for info in store.get_file_info(fs.FileSelector(f"{base}/commits", allow_not_found=True)):
        if info.type == fs.FileType.File and info.base_name.endswith(".json"):
            with store.open_input_stream(info.path) as f:
                found.append(json.loads(f.read()))
    return sorted(found, key=lambda c: c["batch"])


def last_batch(target: str) -> int | None:
    """Number of the last batch that is whole."""
    found = committed(target)
    return found[-1]["batch"] if found else None


def commit(df: DataFrame, target: str, batch: int, keep: int | None = 2) -> bool:
    """Write a batch and make it the last one; False if that batch or a later one is there already.

    Of batches that each replace the one before, the last ``keep`` stay, so that readers of the one before can finish;
    with ``keep=None`` all stay, as parts of one table.
    """
    before = committed(target)
    if before and before[-1]["batch"] >= batch:
        return False
    folder = f"data/{batch:020d}-{uuid.uuid4().hex}"
    df.write.parquet(f"{target}/{folder}")
    store, base = file_system(target)
    for name in ("commits", "pending"):
        store.create_dir(f"{base}/{name}")
    pending = f"{base}/pending/{uuid.uuid4().hex}"
    with store.open_output_stream(pending) as out:
        out.write(json.dumps({"batch": batch, "folder": folder}).encode())
    store.move(pending, f"{base}/commits/{batch:020d}.json")
    named = [*before, {"batch": batch, "folder": folder}]
    if keep is not None:
        for old in named[:-keep]:
            store.delete_file(f"{base}/commits/{old['batch']:020d}.json")
        named = named[-keep:]
    _clean(target, {c["folder"] for c in named}, batch)
    return True


def _clean(target: str, named: set[str], batch: int) -> None:
    """Remove folders of batches up to this one that no commit names."""
    store, base = file_system(target)
    for info in store.get_file_info(fs.FileSelector(f"{base}/data")):
        if f"data/{info.base_name}" not in named and int(info.base_name.split("-")[0]) <= batch:
            store.delete_dir(info.path)


def read_last(spark: SparkSession, target: str) -> DataFrame | None:
    """The last whole batch; None before the first one."""
    found = committed(target)
    return spark.read.parquet(f"{target}/{found[-1]['folder']}") if found else None


def read_all(spark: SparkSession, target: str) -> DataFrame | None:
    """All whole batches as one table; None before the first one."""
    found = committed(target)
    return spark.read.parquet(*[f"{target}/{c['folder']}" for c in found]) if found else None
