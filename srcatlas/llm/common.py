"""Helpers shared by the corpus operators: columns, Arrow batches, whole-text words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Rows of one Arrow batch. A row is a whole text, so that a worker holds few of them at once.
BATCH_ROWS = 512

Batches = Iterator[pa.RecordBatch]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def map_batches(df: DataFrame, fn: Callable[[Batches], Batches], schema: StructType) -> DataFrame:
    """``mapInArrow`` with batches of few rows, since a row may be a very long text."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(fn, schema)


def two_columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Key and text alone, under fixed names, so that no other column can clash."""
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def with_others(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Key and text, and all columns but the text as one struct ``others`` (the key among them)."""
    others = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text_col])
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), others.alias("others"))


def restored(df: DataFrame, columns: list[str], text_col: str, **changed: Column) -> DataFrame:
    """The columns as before ``with_others``, the text as in ``df``; ``changed`` ones anew, where they exist."""
    old = {c: F.col("text") if c == text_col else F.col("others").getField(c) for c in columns}
    return df.select(*[changed.get(c, value).alias(c) for c, value in old.items()])


def id_field(df: DataFrame, id_col: str, name: str | None = None) -> StructField:
    """The key's field as it stands in ``df``, nullable."""
    return StructField(name or id_col, df.schema[id_col].dataType, True)


def texts_as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    wide = pa.types.is_large_string(column.type)
    return column.cast(pa.large_binary() if wide else pa.binary()).to_pylist()


def sha256_hex(column: Column | str) -> Column:
    """Lowercase hex digest of a string or binary column."""
    return F.sha2(column if isinstance(column, Column) else F.col(column), 256)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the key as text leaves the remainder 1 by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))
