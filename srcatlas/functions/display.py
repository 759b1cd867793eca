"""Text forms of sizes, numbers and metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from srcatlas.functions.text import trim


def format_size(size: Column) -> Column:
    """``512B``, ``1.5K``, ``2.0M``, ``3.1G``; exact ties round to even."""

    def scaled(power: int, unit: str) -> Column:
        return F.format_string(f"%.1f{unit}", F.bround(size / F.lit(float(1 << power)), 1))

    return (
        F.when(size >= 1 << 30, scaled(30, "G"))
        .when(size >= 1 << 20, scaled(20, "M"))
        .when(size >= 1 << 10, scaled(10, "K"))
        .otherwise(F.concat(size.cast("string"), F.lit("B")))
    )


def format_number(n: Column) -> Column:
    return F.format_number(n, 0)


def clean_signature(sig: Column) -> Column:
    return trim(F.rtrim(F.rtrim(trim(sig), F.lit("{")), F.lit(";")))


def simplify_path(path: Column) -> Column:
    """Drop one leading standard or crate root; ``super::`` stays."""
    return F.regexp_replace(path, r"^(?:std|core|alloc|crate|self)::", "")


def imports_summary(imports: Column) -> Column:
    """``a, b, std::{…}, crate::{…}`` with empty parts left out."""

    def part(name: str, head: str, tail: str) -> Column:
        items = imports[name]
        return F.when(
            F.size(items) > 0, F.concat(F.lit(head), F.array_join(items, ", "), F.lit(tail))
        )

    return F.concat_ws(
        ", ",
        part("external", "", ""),
        part("std", "std::{", "}"),
        part("internal", "crate::{", "}"),
    )


def import_label(imports: Column) -> Column:
    summary = imports_summary(imports)
    return F.when(summary != "", F.concat(F.lit("imports: "), summary))


def todo_label(marker: Column, text: Column, line: Column) -> Column:
    return F.concat(marker, F.lit(": "), text, F.lit(" (line "), line.cast("string"), F.lit(")"))


def symbol_span(signature: Column, symbol: Column) -> Column:
    """1-based start of the symbol inside its signature, 0 when absent."""
    return F.when(symbol.isNotNull(), F.instr(signature, symbol)).otherwise(F.lit(0))
