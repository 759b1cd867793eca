"""Session builder and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
_OWN_FOLDERS: dict[str, str] = {}


def get_session(app_name: str = "srcatlas", master: str | None = None, **conf: str) -> SparkSession:
    """Build or reuse a session with the settings the engine is tuned for."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # A batch holds whole files; fewer rows keep it within memory.
        .config("spark.sql.parquet.columnarReaderBatchSize", "512")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor can reach, as named by the session.

    Only a local session may run without the setting; it then gets a fresh
    folder of its own. A cluster without the setting is an error, because a
    machine-local folder would be lost together with its executor.
    """
    named = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _OWN_FOLDERS:
        _OWN_FOLDERS[app] = tempfile.mkdtemp(prefix="srcatlas-")
    return _OWN_FOLDERS[app]


def write_shared(df: DataFrame, label: str) -> str:
    """Write ``df`` as a new table in the shared folder and return its path."""
    target = os.path.join(shared_folder(df.sparkSession), f"{label}-{uuid.uuid4().hex}")
    df.write.parquet(target)
    return target


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back.

    Used where two passes must see the very same rows (row numbers, listing
    levels): the written table survives the loss of any executor.
    """
    return df.sparkSession.read.schema(df.schema).parquet(write_shared(df, label))
