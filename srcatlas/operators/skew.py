"""Joins and numberings that stay even when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcatlas.session import materialize

HOT_KEY_SETTING = "spark.srcatlas.hotKeyRows"
DEFAULT_HOT_KEY_ROWS = 2_000_000


def hot_key_rows(df: DataFrame) -> int:
    """Rows of one key that still fit a single join task."""
    return int(df.sparkSession.conf.get(HOT_KEY_SETTING, str(DEFAULT_HOT_KEY_ROWS)))


def spread_join(
    rows: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    salt_by: Sequence[str],
    how: str = "left",
    counted: DataFrame | None = None,
) -> DataFrame:
    """Join many rows to a lookup table when some keys may hold a large share of the rows.

    Keys with more rows than the limit are counted first, with map-side
    partial counts. There are at most (rows / limit) of them, which bounds the
    broadcast. Their rows are dealt over several salts and their lookup rows
    are copied once per salt; every other key keeps the single salt 0.
    ``counted`` is a table of the keys and their ``count``, where that is known already.
    """
    limit = hot_key_rows(rows)
    keys = list(on)
    hot = (
        (rows.groupBy(*keys).count() if counted is None else counted)
        .where(F.col("count") > limit)
        .select(*keys, F.ceil(F.col("count") / limit).cast("int").alias("__salts"))
    )
    salts = F.coalesce(F.col("__salts"), F.lit(1))
    dealt = (
        rows.join(F.broadcast(hot), keys, "left")
        .withColumn("__salt", F.pmod(F.xxhash64(*salt_by), salts).cast("int"))
        .drop("__salts")
    )
    copied = (
        lookup.join(F.broadcast(hot), keys, "left")
        .withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("__salts")
    )
    return dealt.join(copied, [*keys, "__salt"], how).drop("__salt")


def number_rows(
    rows: DataFrame, group: Sequence[str], order: Sequence[Column | str], name: str
) -> DataFrame:
    """``row_number`` per group without gathering a group in one task.

    The rows are range-sorted by group and order and written once with their
    place in the sorted partitions. A second pass adds the counts of earlier
    partitions, a table with one row per group and partition.
    """
    by = [F.col(g) for g in group] + [F.col(o) if isinstance(o, str) else o for o in order]
    place = F.monotonically_increasing_id()
    placed = materialize(
        rows.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .select("*", place.alias("__place")),
        "ranks",
    ).withColumn("__part", F.shiftright("__place", 33))
    keys = list(group)
    pieces = placed.groupBy(*keys, "__part").agg(
        F.count("*").alias("__rows"), F.min("__place").alias("__first")
    )
    # A group has at most one row per partition here, so this window is small.
    earlier = (
        Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = pieces.select(
        *keys,
        "__part",
        (F.coalesce(F.sum("__rows").over(earlier), F.lit(0)) - F.col("__first")).alias("__shift"),
    )
    return (
        placed.join(offsets, [*keys, "__part"])
        .withColumn(name, F.col("__place") + F.col("__shift") + 1)
        .drop("__place", "__part", "__shift")
    )
