"""Tracked paths and states from the text that a version control prints.

One listing per repository, in one file or in several whose name order is the listing's. Files lie in folders
``repo=<name>`` below the path, or all belong to the repository that the caller names. Records end with a newline
(names C-quoted where needed) or with a NUL (names as they are). Files are cut into splits at any record, so that a listing of any
size is read by many tasks; empty records are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srcatlas.functions.quoting import unquoted
from srcatlas.operators.skew import number_rows

_NAME = r'"(?:[^"\\]|\\.)*"|.+?'
_CHANGE = rf"^(..) ({_NAME})(?: -> ({_NAME}))?$"
#: States of paths that aren't tracked and of ignored ones.
NEW, IGNORED = "??", "!!"
#: Records of a run of renames that one row spells out, an even number.
RUN_PART = 10_000


def _records(spark: SparkSession, path: str, repo: str | None, nul: bool) -> DataFrame:
    """(repo, value) of every record."""
    reader = spark.read.option("lineSep", "\0" if nul else "\n")
    if repo is None:
        found = reader.schema("value string, repo string").text(path)
    else:
        found = reader.text(path).withColumn("repo", F.lit(repo))
    return found


def read_printed_index(
    spark: SparkSession, path: str, repo: str | None = None, *, nul: bool = False, staged: bool = False
) -> DataFrame:
    """(repo, path) of an index listing; ``staged`` ones have mode, object and stage before a tab."""
    value = F.col("value")
    name = F.substring(value, F.locate("\t", value) + 1, F.length(value)) if staged else value
    shown = F.make_valid_utf8(name) if nul else unquoted(name)
    listed = _records(spark, path, repo, nul).where(value != "").select("repo", shown.alias("path"))
    # An unmerged path is printed once for each stage.
    return listed.distinct() if staged else listed


def read_printed_status(spark: SparkSession, path: str, repo: str | None = None, *, nul: bool = False) -> DataFrame:
    """(repo, path, is_new, is_ignored) of a status listing in its short, stable form.

    A renamed or copied path gives two rows, for the new and for the old name; headers (``##``) are left out.
    """
    records = _records(spark, path, repo, nul)
    changes = _by_nul(records) if nul else _by_line(records)
    code = F.col("code")
    return changes.where(code != "##").select(
        "repo", F.explode("paths").alias("path"), (code == NEW).alias("is_new"), (code == IGNORED).alias("is_ignored")
    )


def _by_line(records: DataFrame) -> DataFrame:
    def part(n: int) -> Column:
        return F.regexp_extract("value", _CHANGE, n)

    paths = F.when(part(3) == "", F.array(unquoted(part(2)))).otherwise(F.array(unquoted(part(3)), unquoted(part(2))))
    return records.where(part(1) != "").select("repo", part(1).alias("code"), paths.alias("paths"))


def _by_nul(records: DataFrame) -> DataFrame:
    """Here the old name of a renamed path is a record of its own behind the new one, and may look like any other record.

    A record behind one that doesn't look like a rename is a state. So along a run of records that look like renames, states and
    old names take turns, and the record behind the run goes on with that. Runs are told by the difference of two numberings.
    """
    value = F.col("value")
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    within = records.select("repo", "value", *place).withColumn("row", F.monotonically_increasing_id())
    numbered = number_rows(within.where(value != ""), ["repo"], ["file", "block", "row"], "n").select("repo", "value", "n")
    alike = numbered.where(F.regexp_like(value, F.lit(r"(?s)^(?:[RC].|.[RC]) .")))
    ranked = number_rows(alike.select("repo", "n"), ["repo"], ["n"], "m").withColumn("run", F.col("n") - F.col("m"))
    runs = ranked.groupBy("repo", "run").agg(F.min("n").alias("first"), F.max("n").alias("last"))
    # Long runs are spelled out in parts, so that no row holds a whole one.
    parts = runs.select("repo", "last", F.explode(F.sequence("first", "last", F.lit(RUN_PART))).alias("first"))
    end = F.least(F.col("last"), F.col("first") + RUN_PART - 1)
    renames = parts.select("repo", F.explode(F.sequence(F.col("first"), end, F.lit(2))).alias("n"))
    old = renames.select("repo", (F.col("n") + 1).alias("n"), F.lit(True).alias("is_old"))
    marked = numbered.join(old, ["repo", "n"], "left")
    code = F.when(F.col("is_old").isNull(), F.substring(value, 1, 2)).otherwise(F.lit("R "))
    name = F.when(F.col("is_old").isNull(), F.substring(value, F.lit(4), F.length(value))).otherwise(value)
    return marked.select("repo", code.alias("code"), F.array(F.make_valid_utf8(name)).alias("paths"))
