"""Task markers in comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcatlas.functions.text import WS, raw_lines, trim
from srcatlas.operators.corpus import with_text

# The markers, comment openings and phrases of documentation text.
MARKERS = ["TODO", "FIXME", "HACK", "XXX", "BUG", "NOTE"]
DOCUMENTATION_PHRASES = [
    "Tasks to be done",
    "Code that needs fixing",
    "Temporary workaround",
    "Problematic or unclear",
    "Known bug",
    "Important note",
]

# Runs of blanks are possessive: what follows them can never be a blank, so
# nothing is lost and a line of blanks costs one pass.
TODO_REGEX = (
    rf"(?idu)^[{WS}]*+(?://++|/?\*++|#++|--++|;++)[{WS}]*+(?:![{WS}]*+)?+("
    + "|".join(MARKERS)
    + rf")[{WS}]*+:(.+)"
)


def is_documentation_example(text: Column) -> Column:
    """Text that describes markers rather than naming a task."""
    hit = F.startswith(text, F.lit("`")) | F.contains(F.lower(text), F.lit("marker"))
    for phrase in DOCUMENTATION_PHRASES:
        hit = hit | F.startswith(text, F.lit(phrase))
    return hit


def clean_comment_text(text: Column) -> Column:
    """Cut at a closing comment mark."""
    return trim(F.substring_index(F.substring_index(text, "*/", 1), "-->", 1))


def todos_array(lines: Column) -> Column:
    """Array of (line, marker, text) inside the file's row, in file order.

    Three passes over ever fewer lines: the text of lines with a colon, the
    tests on the text, and only then the marker.
    """

    def candidate(line: Column, pos: Column) -> Column:
        task = clean_comment_text(trim(F.regexp_extract(line, TODO_REGEX, 2)))
        return F.when(
            F.contains(line, F.lit(":")),
            F.struct((pos + 1).alias("line"), line.alias("raw"), task.alias("text")),
        )

    def wanted(t: Column) -> Column:
        return t.isNotNull() & (t["text"] != "") & ~is_documentation_example(t["text"])

    def item(t: Column) -> Column:
        marker = F.upper(F.regexp_extract(t["raw"], TODO_REGEX, 1))
        return F.struct(t["line"].alias("line"), marker.alias("marker"), t["text"].alias("text"))

    return F.transform(F.filter(F.transform(lines, candidate), wanted), item)


def extract_todos(files: DataFrame, **gates: int) -> DataFrame:
    """(repo, path, line, marker, text), one row per task marker; a narrow stage."""
    return with_text(files, **gates).select(
        "repo", "path", F.inline(todos_array(raw_lines(F.col("text"))))
    )
