"""Metadata of a file as lines in four sections, and their order and layout.

Everything here works on arrays inside the file's own row: no shuffle, and one
decode and one split per file however many sections are asked for.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcatlas.functions import text as tx
from srcatlas.functions.display import import_label, todo_label
from srcatlas.operators.comments import header_comment
from srcatlas.operators.corpus import NAMED, with_text
from srcatlas.operators.imports import grouped_imports, import_items
from srcatlas.operators.signatures import signatures_array
from srcatlas.operators.todos import todos_array

COMMENTS_FIRST = "comments_first"
TYPES_FIRST = "types_first"
SECTIONS = ["comment", "type", "import", "todo"]
LINE_TYPE = "array<struct<section:string,style:string,content:string,symbol:string,indent:int>>"


@dataclass(frozen=True)
class Sections:
    """Which extractors run and whether whole blocks are shown."""

    comments: bool = True
    types: bool = False
    todos: bool = False
    imports: bool = False
    full: bool = False


def select_sections(
    comments: bool = False,
    types: bool = False,
    todos: bool = False,
    imports: bool = False,
    full: bool = False,
    no_comments: bool = False,
) -> Sections:
    """Sections for the given wishes.

    Nothing asked for: comments. Types or tasks alone: just these. Types, tasks
    or imports imply whole blocks.
    """
    wants = comments or not (types or todos)
    return Sections(
        comments=wants and not no_comments,
        types=types,
        todos=todos,
        imports=imports,
        full=full or types or todos or imports,
    )


# Extension point: name -> function of (text, lines, canon_ext) giving an array
# of structs (content, style, symbol, indent).
Extractor = Callable[[Column, Column, Column], Column]
_EXTRACTORS: dict[str, Extractor] = {}


def register_extractor(name: str, extractor: Extractor) -> None:
    """Add a section of one's own; a column expression, or a pandas UDF call."""
    _EXTRACTORS[name] = extractor


def registered_extractors() -> list[str]:
    return sorted(_EXTRACTORS)


def _line(section: str, style: str, content: Column, symbol: Column, indent: Column) -> Column:
    return F.struct(
        F.lit(section).alias("section"),
        F.lit(style).alias("style"),
        content.alias("content"),
        symbol.alias("symbol"),
        indent.cast("int").alias("indent"),
    )


def _plain(section: str, style: str, content: Column) -> Column:
    return _line(section, style, content, F.lit(None).cast("string"), F.lit(0))


def _empty_lines() -> Column:
    return F.array().cast(LINE_TYPE)


def comment_lines(comment: Column) -> Column:
    rows = F.transform(tx.lines(comment), lambda s: _plain("comment", "comment", s))
    return F.when(comment.isNotNull(), rows).otherwise(_empty_lines())


def type_lines(signatures: Column) -> Column:
    rows = F.transform(
        signatures,
        lambda s: _line("type", "type_signature", s["signature"], s["symbol"], s["indent"]),
    )
    return F.coalesce(rows, _empty_lines())


def todo_lines(todos: Column) -> Column:
    rows = F.transform(
        todos, lambda t: _plain("todo", "todo", todo_label(t["marker"], t["text"], t["line"]))
    )
    return F.coalesce(rows, _empty_lines())


def import_lines(imports: Column) -> Column:
    label = import_label(imports)
    return F.when(label.isNotNull(), F.array(_plain("import", "import", label))).otherwise(
        _empty_lines()
    )


def file_sections(
    files: DataFrame, sections: Sections = Sections(), extra: list[str] | None = None, every: bool = False, **gates: int | None
) -> DataFrame:
    """(repo, path, comment, signatures, todos, imports, <extra>): wanted sections in one pass.

    Sections that are not wanted are NULL and cost nothing. With ``every`` there is a row for every
    file, also for those without a section, with its size, time and kind; reports then draw the files
    from these rows instead of joining sections to a listing.
    """
    text, lines, ext = F.col("text"), F.col("lines"), F.col("canon_ext")
    cols: dict[str, Column] = {
        "comment": header_comment(text, ext) if sections.comments else F.lit(None).cast("string"),
        "signatures": signatures_array(lines, ext)
        if sections.types
        else F.lit(None).cast("array<struct<line:int,signature:string,symbol:string,indent:int>>"),
        "todos": todos_array(lines)
        if sections.todos
        else F.lit(None).cast("array<struct<line:int,marker:string,text:string>>"),
        "imports": F.lit(None).cast(
            "struct<external:array<string>,std:array<string>,internal:array<string>>"
        ),
    }
    named = NAMED if every else []
    split = with_text(files, every=every, **gates).select(
        "repo", "path", *named, "canon_ext", "text", tx.raw_lines(text).alias("lines")
    )
    if sections.imports:
        split = split.select("*", import_items(text, lines, ext).alias("items"))
        cols["imports"] = grouped_imports(F.col("items"), ext)
    for name in extra or []:
        cols[name] = _EXTRACTORS[name](text, lines, ext)
    return split.select("repo", "path", *named, *[c.alias(n) for n, c in cols.items()])


def extract_with(files: DataFrame, name: str, **gates: int) -> DataFrame:
    """(repo, path, seq, content, style, symbol, indent) of a registered extractor."""
    found = file_sections(files, Sections(comments=False), [name], **gates)
    items = F.filter(name, lambda x: x.isNotNull())
    return found.select("repo", "path", F.posexplode(items).alias("pos", "x")).select(
        "repo", "path", (F.col("pos") + 1).alias("seq"), "x.*"
    )


def with_section_lines(sections: DataFrame) -> DataFrame:
    """Add the four line arrays ``comment_lines``, ``type_lines``, ``import_lines``, ``todo_lines``."""
    return sections.select(
        "*",
        comment_lines(F.col("comment")).alias("comment_lines"),
        type_lines(F.col("signatures")).alias("type_lines"),
        import_lines(F.col("imports")).alias("import_lines"),
        todo_lines(F.col("todos")).alias("todo_lines"),
    )


def _counts() -> dict[str, Column]:
    return {s: F.size(f"{s}_lines") for s in SECTIONS}


def total_lines() -> Column:
    n = _counts()
    return n["comment"] + n["type"] + n["import"] + n["todo"]


def is_empty() -> Column:
    return total_lines() == 0


def has_only(section: str) -> Column:
    """Lines in this section and in no other."""
    return (_counts()[section] > 0) & (_counts()[section] == total_lines())


def has_both() -> Column:
    return (_counts()["comment"] > 0) & (_counts()["type"] > 0)


def has_todos() -> Column:
    return _counts()["todo"] > 0


def has_imports() -> Column:
    return _counts()["import"] > 0


def _leading(order: str) -> tuple[str, str]:
    pair = ("comment_lines", "type_lines")
    return pair if order == COMMENTS_FIRST else pair[::-1]


def ordered_lines(order: str = COMMENTS_FIRST) -> Column:
    """All lines: two leading sections, imports, tasks; an empty line between groups."""
    blank = F.array(_plain("separator", "comment", F.lit("")))
    groups = [F.col(c) for c in (*_leading(order), "import_lines", "todo_lines")]
    parts, before = [groups[0]], F.size(groups[0])
    for group in groups[1:]:
        parts.append(F.when((before > 0) & (F.size(group) > 0), blank).otherwise(_empty_lines()))
        parts.append(group)
        before = before + F.size(group)
    return F.concat(*parts)


def first_metadata_line(order: str = COMMENTS_FIRST) -> Column:
    """Line shown beside the name: leading sections, then tasks, then imports."""
    first, second = _leading(order)
    groups = [first, second, "todo_lines", "import_lines"]
    return F.coalesce(*[F.get(F.col(g), F.lit(0)) for g in groups])


def first_section_is_single_line(order: str = COMMENTS_FIRST) -> Column:
    first, second = (F.size(F.col(c)) for c in _leading(order))
    return (
        F.when(first > 0, first == 1)
        .when(second > 0, second == 1)
        .otherwise(_counts()["todo"] == 1)
    )


def metadata_lines(
    files: DataFrame, sections: Sections, order: str = COMMENTS_FIRST, **gates: int
) -> DataFrame:
    """(repo, path, seq, section, style, content, symbol, indent) in display order."""
    found = with_section_lines(file_sections(files, sections, **gates))
    return (
        found.select("repo", "path", F.posexplode(ordered_lines(order)).alias("pos", "m"))
        .select("repo", "path", (F.col("pos") + 1).alias("seq"), "m.*")
    )


def needs_group_separator(indent: Column, previous: Column, next_indent: Column) -> Column:
    """Blank row before a base-level line that ends or opens an indented group.

    ``previous`` is NULL at the start and after an empty line; ``next_indent``
    is that of the next line with content.
    """
    opens = F.coalesce(next_indent > indent, F.lit(False))
    return (indent == 0) & previous.isNotNull() & ((previous > 0) | opens)


BLOCK_ROW = "struct<text:string,symbol:string,indent:int>"


def with_block_rows(
    df: DataFrame, lines: str, name: str, width: Column | int | None = None
) -> DataFrame:
    """Add the rows of a metadata block: (text, symbol, indent), NULL text for a blank row.

    Framed by blank rows, wrapped, with blank rows between groups. Neighbours
    come from the same array shifted by one, so the cost is linear. The lines
    with content are a column of their own, worked out once.
    """
    indexed = F.transform(
        lines,
        lambda m, i: F.struct(
            i.alias("i"), tx.trim(m["content"]).alias("content"), m["symbol"].alias("symbol"), m["indent"].alias("indent")
        ),
    )
    filled = F.col("__filled")
    nothing = F.array(F.lit(None).cast("struct<i:int,content:string,symbol:string,indent:int>"))
    before = F.concat(nothing, filled)
    after = F.concat(F.slice(filled, 2, 1 << 30), nothing)
    # The shifted copy is one longer; its last element pairs with no line.
    trios = F.filter(
        F.arrays_zip(filled.alias("m"), before.alias("p"), after.alias("n")), lambda z: z["m"].isNotNull()
    )
    blank = F.struct(
        F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("symbol"), F.lit(0).alias("indent")
    ).cast(BLOCK_ROW)

    def rows(z: Column) -> Column:
        m, p, n = z["m"], z["p"], z["n"]
        gap = m["i"] - F.coalesce(p["i"], F.lit(-1)) - 1
        previous = F.when(gap == 0, p["indent"])
        sep = needs_group_separator(m["indent"], previous, n["indent"])
        pieces = F.array(m["content"])
        if width is not None:
            w = F.lit(width) if isinstance(width, int) else F.col("__width")
            pieces = F.when(w.isNotNull(), tx.wrap_text(m["content"], w)).otherwise(pieces)
        content = F.transform(
            pieces,
            lambda s: F.struct(s.alias("text"), m["symbol"].alias("symbol"), m["indent"].alias("indent")),
        )
        return F.concat(F.array_repeat(blank, gap + F.when(sep, 1).otherwise(0)), content)

    last = F.coalesce(F.try_element_at(filled, F.lit(-1))["i"], F.lit(-1))
    trailing = F.size(lines) - 1 - last
    block = F.concat(
        F.array(blank), F.flatten(F.transform(trios, rows)), F.array_repeat(blank, trailing + 1)
    )
    own_width = width if isinstance(width, Column) else F.lit(None).cast("int")
    return (
        df.select(
            "*",
            F.filter(indexed, lambda m: m["content"] != "").alias("__filled"),
            own_width.alias("__width"),
        )
        .select("*", F.when(filled.isNotNull(), block).alias(name))
        .drop("__filled", "__width")
    )


LAYOUTS = ["empty", "inline", "inline_block", "block"]


def rest_lines(order: str) -> Column:
    """Lines without the one shown inline and the separator it leaves behind."""
    every = ordered_lines(order)
    first, second = _leading(order)
    leads = (F.size(F.col(first)) > 0) | (F.size(F.col(second)) > 0)
    skipped = F.slice(every, F.when(has_both(), 3).otherwise(2), F.lit(1 << 30))
    return F.when(leads | ~has_imports() | ~has_todos(), skipped).otherwise(F.col("import_lines"))


def block_table(laid: DataFrame) -> DataFrame:
    """(repo, path, seq, text, symbol, indent): the rows below each name."""
    rows = F.filter("block", lambda r: r.isNotNull())
    return laid.select("repo", "path", F.posexplode(rows).alias("seq", "r")).select(
        "repo", "path", "seq", "r.*"
    )


def with_layout(
    lines: DataFrame, full: bool, order: str = COMMENTS_FIRST, width: Column | int | None = None
) -> DataFrame:
    """Add ``layout``, ``inline`` (content, symbol, indent) and ``block`` rows."""
    first = first_metadata_line(order)
    if full:
        layout = (
            F.when(is_empty(), "empty")
            .when(total_lines() == 1, "inline")
            .when(first_section_is_single_line(order), "inline_block")
            .otherwise("block")
        )
    else:
        layout = F.when(is_empty(), "empty").otherwise("inline")
    shown = F.struct(
        tx.first_line(first["content"]).alias("content"), first["symbol"].alias("symbol"), first["indent"].alias("indent")
    )
    placed = lines.withColumn("layout", layout).withColumn(
        "inline", F.when(F.col("layout").isin("inline", "inline_block"), shown)
    )
    no_rows = F.array().cast(f"array<{BLOCK_ROW}>")
    if not full:
        return placed.withColumn("block", no_rows)
    below = F.when(F.col("layout") == "inline_block", rest_lines(order)).when(
        F.col("layout") == "block", ordered_lines(order)
    )
    return (
        with_block_rows(placed.withColumn("__below", below), "__below", "block", width)
        .withColumn("block", F.coalesce("block", no_rows))
        .drop("__below")
    )
