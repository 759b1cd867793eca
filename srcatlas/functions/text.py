"""White space, lines and size gates, all as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points with the Unicode White_Space property.
WHITE_SPACE = "".join(
    chr(c)
    for c in [
        *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680,
        *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    ]
)
# The same set as regular-expression class bodies, whole and without newline.
WS = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
HWS = WS.replace(r"\n", "")

# Sizes that callers may name as a limit; none applies by itself.
USUAL_EXTRACTION_LIMIT = 1_000_000
USUAL_LINE_LIMIT = 5_000_000


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trim(col: Column) -> Column:
    """Strip Unicode white space at both ends (``F.trim`` strips U+0020 only)."""
    return F.btrim(col, F.lit(WHITE_SPACE))


def ltrim(col: Column) -> Column:
    return F.ltrim(col, F.lit(WHITE_SPACE))


def rtrim(col: Column) -> Column:
    return F.rtrim(col, F.lit(WHITE_SPACE))


def raw_lines(text: Column) -> Column:
    """Split on newline only; callers trim, which also drops the carriage return.

    A single-character separator avoids the regular-expression path of split.
    """
    return F.split(text, "\n")


def lines(text: Column) -> Column:
    """Lines without terminators; no empty element for a final terminator."""
    parts = F.split(text, "\r?\n")
    return F.when(
        F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)
    ).otherwise(parts)


def first_line(col: Column) -> Column:
    return F.rtrim(F.substring_index(col, "\n", 1), F.lit("\r"))


def count_lines(content: Column, size: Column | None = None, max_size: int | None = None) -> Column:
    """Newline bytes, plus one for an unterminated last line; NULL above ``max_size``, if one is given.

    Works on bytes, so files that are not text count as well.
    """
    text = content.cast("string")
    newlines = F.octet_length(content) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    open_end = F.when(
        (F.octet_length(content) > 0) & ~F.endswith(text, F.lit("\n")), F.lit(1)
    ).otherwise(F.lit(0))
    counted = (newlines + open_end).cast("bigint")
    if max_size is None:
        return counted
    return F.when((F.octet_length(content) if size is None else size) <= max_size, counted)


def decoded(content: Column) -> Column:
    """The bytes as text, NULL when they are not valid UTF-8."""
    return F.try_validate_utf8(content.cast("string"))


def indent_of(line: Column) -> Column:
    """Width of the leading blanks; a tab is four wide."""
    lead = F.length(line) - F.length(F.ltrim(line, F.lit(" \t")))
    head = F.left(line, lead)
    tabs = lead - F.length(F.replace(head, F.lit("\t"), F.lit("")))
    return lead + tabs * 3


def wrap_text(text: Column, width: Column | int) -> Column:
    """Greedy word wrap by code points.

    Words are joined by single blanks; each output line is then the longest
    piece that ends at a word end, or ``width`` characters of a longer word,
    whose last piece stays open for the next word. ``width`` 0 leaves the text
    as it is. One linear scan per text.
    """
    width = F.lit(width) if isinstance(width, int) else width
    w = width.cast("string")
    step = F.concat(
        F.lit("(?s)(?:.{1,"), w, F.lit("}(?: |\\z)|[^ ]{"), w, F.lit("})")
    )

    def pieces(words: Column) -> Column:
        cut = F.transform(F.regexp_extract_all(words, step, F.lit(0)), lambda p: F.rtrim(p))
        return F.when(F.length(words) <= width, F.array(words)).otherwise(cut)

    # A single blank between words is left alone, so most texts pass unchanged.
    words = F.regexp_replace(trim(text), f" [{WS}]++|[{WS}&&[^ ]][{WS}]*+", " ")
    return F.when(width == 0, F.array(text)).otherwise(bind(words, pieces))


def wrap_width(width: Column, *prefix_lengths: Column | int) -> Column:
    """Width left after the prefixes; NULL when wrapping is off or 10 or less is left."""
    left = width
    for n in prefix_lengths:
        left = left - n
    return F.when(left > 10, left)
