"""Text, Markdown and JSON reports as ordered rows.

Each report is a table (repo, sort_key, seq, text). Sorting it by these columns
and writing the text in that order gives the document, in as many parts as the
cluster likes; no document is ever put together in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcatlas.functions import names
from srcatlas.functions.display import format_number, format_size
from srcatlas.functions.text import first_line, trim, wrap_width
from srcatlas.operators import metadata as md
from srcatlas.operators.stats import listing_counts
from srcatlas.operators.tree import continuation_prefix, directory_frame, end_siblings, in_frame, with_places

REPORT_ORDER = ["repo", "sort_key", "seq"]


def _step(order: int, name: Column) -> Column:
    return F.named_struct(F.lit("o"), F.lit(order), F.lit("p"), name)


def _key(path: Column, *end: int) -> Column:
    """Preorder key; a trailing number places a row after everything below the path."""
    parts = F.transform(names.sort_key(path), lambda p: _step(0, p))
    tail = [_step(e, F.lit("")) for e in end]
    return F.concat(parts, F.array(*tail)) if tail else parts


def _summary_rows(nodes: DataFrame, pattern: str) -> DataFrame:
    counts = listing_counts(nodes)
    rows = F.array(F.lit(""), F.format_string(pattern, F.col("directories"), F.col("files")))
    return counts.select(
        "repo", F.lit("").alias("path"), _key(F.lit(""), 2).alias("sort_key"), F.posexplode(rows).alias("seq", "text")
    )


def _file_rows(nodes: DataFrame, extra: DataFrame | None) -> DataFrame:
    """File rows with their places, and with the columns of ``extra``, if given.

    Rows from ``file_sections(every=True)`` have a size and are the files of the
    listing themselves; others are joined to the listed files by path.
    """
    is_file = F.col("node_type") == "file"
    if extra is None:
        return nodes.where(is_file).drop("node_type")
    if "size_bytes" in extra.columns:
        return with_places(extra)
    return nodes.where(is_file).drop("node_type").join(extra, ["repo", "path"], "left")


def text_report(
    nodes: DataFrame,
    lines: DataFrame | None = None,
    *,
    full: bool = False,
    order: str = md.COMMENTS_FIRST,
    wrap: int | None = 100,
    prefix: str = "",
    show_size: bool = False,
) -> DataFrame:
    """Drawn tree with metadata and closing counts, one row per printed line.

    ``lines`` comes from ``with_section_lines``; made with ``every=True`` and
    narrowed by ``listed_files`` it holds the listed files, and no file is joined to itself. Rows: (repo, path, sort_key,
    seq, text).
    """
    frame = directory_frame(nodes)
    key = _key(F.col("path")).alias("sort_key")
    dirs = in_frame(nodes.where(F.col("node_type") == "dir"), frame)
    head = F.concat("prefix", "connector", "name")
    rows = dirs.select("repo", "path", key, F.lit(0).alias("seq"), head.alias("text"))
    laid = None if lines is None else _laid_out(lines, full, order, wrap, prefix)
    files = in_frame(_file_rows(nodes, laid), frame)
    if show_size:
        size = F.concat(F.lit("  ["), format_size(F.col("size_bytes")), F.lit("]"))
        head = F.concat(head, F.coalesce(size, F.lit("")))
    if lines is None:
        shown = files.select("repo", "path", key, F.lit(0).alias("seq"), head.alias("text"))
    else:
        below = continuation_prefix(F.col("prefix"), F.col("is_last"))
        beside = F.coalesce(F.col("beside"), F.lit(""))
        # The generator takes the expression, not a column: for a column the
        # optimizer would test its size first and work it out twice.
        block = F.transform("block", lambda r: F.concat(F.col("below"), r))
        every = F.concat(F.array("head"), F.coalesce(block, F.array().cast("array<string>")))
        shown = files.select(
            "repo", "path", key, F.concat(head, beside).alias("head"), below.alias("below"), "block"
        ).select("repo", "path", "sort_key", F.posexplode(every).alias("seq", "text"))
    return rows.unionByName(shown).unionByName(_summary_rows(nodes, "%d directories, %d files"))


def _laid_out(lines: DataFrame, full: bool, order: str, wrap: int | None, prefix: str) -> DataFrame:
    """(repo, path, beside, block): printed metadata of each file, short of the branches.

    All of it follows from the file's own row and depth, so the layout is done
    where the file was read and only its result is joined to the tree.
    """
    # Every level of the branches is four characters wide.
    depth = names.path_depth(F.col("path"))
    width = wrap_width(F.lit(wrap).cast("int"), depth * 4, len(prefix)) if wrap is not None else None
    laid = md.with_layout(lines, full, order, width)

    def printed(indent: Column, text: Column) -> Column:
        return F.concat(F.lit(prefix), F.repeat(F.lit(" "), indent), text)

    return laid.select(
        "repo",
        "path",
        *_size(lines),
        F.concat(F.lit("  "), printed(F.col("inline.indent"), F.col("inline.content"))).alias("beside"),
        F.transform(
            "block", lambda r: F.coalesce(printed(r["indent"], r["text"]), F.lit(""))
        ).alias("block"),
    )


def markdown_report(
    nodes: DataFrame,
    lines: DataFrame | None = None,
    *,
    full: bool = False,
    order: str = md.COMMENTS_FIRST,
    show_size: bool = False,
) -> DataFrame:
    """Nested Markdown list; further metadata goes into a quote below the item."""
    indent = F.repeat(F.lit("  "), F.col("depth"))
    size = F.lit("")
    if show_size:
        size = F.coalesce(
            F.concat(F.lit(" ("), format_size(F.col("size_bytes")), F.lit(")")), F.lit("")
        )
    none = [F.lit(None).cast("string").alias("beside"), F.lit(None).cast("array<string>").alias("quote")]
    files = _file_rows(nodes, None if lines is None else _quoted(lines, full, order))
    files = files.select("*", *none) if lines is None else files
    beside = F.coalesce(F.col("beside"), F.lit(""))
    item = F.concat(indent, F.lit("- `"), F.col("name"), F.lit("`"), size, beside)
    folder = F.concat(indent, F.lit("- **"), F.col("name"), F.lit("/**"))
    dirs = nodes.where(F.col("node_type") == "dir").select("*", *none)
    shown = [
        rows.select("repo", "path", _key(F.col("path")).alias("sort_key"), head.alias("head"), "quote")
        for rows, head in ((dirs, folder), (files, item))
    ]
    rows = F.concat(F.array("head"), F.coalesce("quote", F.array().cast("array<string>")))
    body = shown[0].unionByName(shown[1]).select("repo", "path", "sort_key", F.posexplode(rows).alias("seq", "text"))
    return body.unionByName(_summary_rows(nodes, "*%d directories, %d files*"))


def _size(rows: DataFrame) -> list[str]:
    return ["size_bytes"] if "size_bytes" in rows.columns else []


def _quoted(lines: DataFrame, full: bool, order: str) -> DataFrame:
    """(repo, path, beside, quote): text beside the item and the rows of the quote below it."""
    first = md.first_metadata_line(order)
    beside = F.concat(F.lit(" - "), first_line(first["content"])).alias("beside")
    if not full:
        return lines.select("repo", "path", *_size(lines), beside, F.lit(None).cast("array<string>").alias("quote"))
    nested = F.repeat(F.lit("  "), names.path_depth(F.col("path")) + 1)
    rest = F.filter(F.transform(md.rest_lines(order), lambda m: trim(m["content"])), lambda s: s != "")
    quote = F.concat(
        F.array("nested"),
        F.transform(
            F.when(F.size("rest") > 0, F.col("rest")).otherwise(F.array(F.lit(""))),
            lambda s: F.concat(F.col("nested"), F.lit("> "), s),
        ),
        F.array(F.lit("")),
    )
    return lines.select(
        "repo", "path", *_size(lines), beside, nested.alias("nested"), rest.alias("rest"), md.total_lines().alias("n")
    ).select("repo", "path", *_size(lines), "beside", F.when(F.col("n") > 1, quote).alias("quote"))


def _node_fields(with_size: bool) -> list[Column]:
    fields = [
        F.lit("file").alias("type"),
        F.col("name"),
        F.col("path"),
        F.col("comment"),
        _none_if_empty(F.transform("signatures", lambda s: s["signature"])).alias("types"),
        _none_if_empty(
            F.transform(
                "todos",
                lambda t: F.struct(t["marker"].alias("type"), t["text"].alias("text"), t["line"].alias("line")),
            )
        ).alias("todos"),
        F.when(
            F.col("imports").isNotNull(),
            F.struct(
                *[_none_if_empty(F.col("imports")[c]).alias(c) for c in ("external", "std", "internal")]
            ),
        ).alias("imports"),
    ]
    if with_size:
        fields += [F.col("size_bytes"), format_size(F.col("size_bytes")).alias("size_human")]
    return fields


def _none_if_empty(items: Column) -> Column:
    return F.when(F.size(items) > 0, items)


def json_records(nodes: DataFrame, sections: DataFrame, show_size: bool = False) -> DataFrame:
    """(repo, path, json): one object per file; absent fields are left out."""
    rows = _file_rows(nodes, sections)
    return rows.select("repo", "path", F.to_json(F.struct(*_node_fields(show_size))).alias("json"))


def json_tree(nodes: DataFrame, sections: DataFrame, show_size: bool = False) -> DataFrame:
    """Nested JSON tree of each repository as rows (repo, path, sort_key, seq, text).

    A directory opens in one row and closes in another that sorts after all
    its entries; an entry that is not the first of its siblings starts with a
    comma. In order, the rows of a repository are one JSON document.
    """
    frame = end_siblings(nodes).withColumn("prefix", F.lit(""))
    comma = F.when((F.col("depth") > 0) & ~F.col("is_first"), F.lit(",")).otherwise(F.lit(""))
    opening = F.to_json(F.struct(F.lit("dir").alias("type"), F.col("name"), F.col("path")))
    opened = F.concat(
        comma, F.left(opening, F.length(opening) - 1), F.lit(',"children":[')
    )
    dirs = in_frame(nodes.where(F.col("node_type") == "dir"), frame)
    ends = F.array(
        F.struct(_key(F.col("path")).alias("sort_key"), opened.alias("text")),
        F.struct(_key(F.col("path"), 1).alias("sort_key"), F.lit("]}").alias("text")),
    )
    dir_rows = dirs.select("repo", "path", F.explode(ends).alias("e")).select("repo", "path", "e.*")
    files = in_frame(_file_rows(nodes, sections), frame)
    record = F.to_json(F.struct(*_node_fields(show_size)))
    file_rows = files.select(
        "repo", "path", _key(F.col("path")).alias("sort_key"), F.concat(comma, record).alias("text")
    )
    return dir_rows.unionByName(file_rows).select(
        "repo", "path", "sort_key", F.lit(0).alias("seq"), "text"
    )


# The frame of the statistics report.
STATS_TITLE = ["Codebase Statistics", "───────────────────"]


def stats_report(stats: DataFrame, totals: DataFrame) -> DataFrame:
    """Statistics as text: (repo, sort_key, seq, text).

    Languages come by file count, then name, in columns. A repository has at
    most as many rows as there are languages.
    """
    has_lines = F.col("total_lines").isNotNull()

    def at(section: int, texts: Column) -> tuple[Column, Column]:
        return F.array(_step(section, F.lit(""))).alias("sort_key"), F.posexplode(
            texts
        ).alias("seq", "text")

    head = F.array(
        *[F.lit(t) for t in STATS_TITLE],
        F.format_string("Files:        %d total", F.col("files")),
        F.format_string("Directories:  %d", F.col("directories")),
        F.lit(""),
    )
    title = F.when(F.col("files") > 0, F.array(F.lit("By Language:"))).otherwise(
        F.array().cast("array<string>")
    )
    tail = F.concat(
        F.when(F.col("files") > 0, F.array(F.lit(""))).otherwise(F.array().cast("array<string>")),
        F.when(
            has_lines,
            F.array(F.concat(F.lit("Total:       "), format_number(F.col("total_lines")), F.lit(" lines of code"))),
        ).otherwise(F.array().cast("array<string>")),
    )
    row = F.concat(
        F.format_string("  %-14s%4d files", F.col("language"), F.col("files")),
        F.when(
            F.col("lines").isNotNull(), F.format_string("  %8s lines", format_number(F.col("lines")))
        ).otherwise(F.lit("")),
    )
    rank = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("files"), "language"))
    by_language = stats.select(
        "repo",
        F.array(_step(2, F.lit(""))).alias("sort_key"),
        rank.alias("seq"),
        row.alias("text"),
    )
    return (
        totals.select("repo", *at(0, head))
        .unionByName(totals.select("repo", *at(1, title)))
        .unionByName(by_language)
        .unionByName(totals.select("repo", *at(3, tail)))
    )


def stats_json(stats: DataFrame, totals: DataFrame) -> DataFrame:
    """(repo, json): totals and the list by language.

    ``lines`` is left out when not counted and ``by_language`` when empty;
    ``total_lines`` stays as null. The list holds one entry per language.
    """
    entry = F.struct("language", "files", "lines", "extensions")
    listed = (
        stats.groupBy("repo")
        .agg(F.collect_list(F.struct((-F.col("files")).alias("o"), "language", entry.alias("e"))).alias("ls"))
        .select("repo", F.to_json(F.transform(F.array_sort("ls"), lambda x: x["e"])).alias("ls"))
    )
    head = F.to_json(F.struct("files", "directories", "total_lines"), {"ignoreNullFields": "false"})
    body = F.concat(
        F.left(head, F.length(head) - 1),
        F.coalesce(F.concat(F.lit(',"by_language":'), F.col("ls")), F.lit("")),
        F.lit("}"),
    )
    return totals.join(listed, "repo", "left").select("repo", body.alias("json"))
