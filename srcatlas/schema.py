"""Table schemas and the boundary check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

FILES = T.StructType(
    [
        T.StructField("repo", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("mtime", T.TimestampType()),
        T.StructField("is_symlink", T.BooleanType()),
        T.StructField("is_dir", T.BooleanType()),
        T.StructField("content", T.BinaryType()),
    ]
)

TRACKED = T.StructType(
    [T.StructField("repo", T.StringType()), T.StructField("path", T.StringType())]
)

STATUS = T.StructType(
    [
        T.StructField("repo", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("is_new", T.BooleanType()),
        T.StructField("is_ignored", T.BooleanType()),
    ]
)


def require_columns(df: DataFrame, schema: T.StructType, *names: str) -> DataFrame:
    """Fail early when ``df`` lacks a column or holds it with another type."""
    wanted = {f.name: f.dataType for f in schema.fields}
    have = {f.name: f.dataType for f in df.schema.fields}
    for name in names or wanted:
        if name not in have:
            raise ValueError(f"missing column {name}; have {sorted(have)}")
        if have[name] != wanted[name]:
            raise ValueError(
                f"column {name} is {have[name].simpleString()}, "
                f"expected {wanted[name].simpleString()}"
            )
    return df
