"""Files in chunks: lines, tasks and imports of files that are larger than one row can hold.

A chunk table is (repo, path, seq, content): consecutive pieces of a file, cut anywhere, also inside a line, a character or
a line end. The results are those of the whole file, whatever the cuts:

- The whole lines inside a chunk are worked on where the chunk is. Only what lies before its first and behind its
  last newline goes through an exchange; pieces of one line are put together there, also over chunks without a newline.
- Line numbers are prefix sums over the chunks' newlines, added to what was found, not to the contents.
- State carried over lines, such as an open ``import ( … )`` block, is a transition: each chunk says what it finds if it
  starts inside and outside of a block and how it leaves the state. The transitions are composed in a scan of one narrow
  row per chunk, and each chunk's findings are then taken from the right case.

A line, unlike a file, has to fit into a row. A file that isn't valid UTF-8 as a whole has no lines, tasks or imports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcatlas.functions import names
from srcatlas.functions.text import raw_lines
from srcatlas.operators.imports import (
    DISTINCT_CATEGORIES,
    GO_BLOCK_END,
    GO_BLOCK_START,
    grouped_imports,
    import_items,
)
from srcatlas.operators.todos import todos_array

FILE = ["repo", "path"]
#: Bytes of a chunk unless said otherwise.
CHUNK_BYTES = 8 << 20


def cut_files(files: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table of a files table, cut every ``chunk_bytes`` bytes; an empty file is one empty chunk."""
    plain = files.where(F.col("content").isNotNull() & ~F.coalesce(F.col("is_dir"), F.lit(False)) & ~F.coalesce(F.col("is_symlink"), F.lit(False)))
    last = F.greatest(F.octet_length("content") - 1, F.lit(0))
    at = F.explode(F.sequence(F.lit(0), F.floor(last / chunk_bytes).cast("int")))
    cut = F.substring(F.col("content"), F.col("seq") * chunk_bytes + 1, F.lit(chunk_bytes))
    return plain.select(*FILE, "content", at.alias("seq")).select(*FILE, F.col("seq").cast("bigint").alias("seq"), cut.alias("content"))


def _text(content: Column) -> Column:
    """Bytes as a string whatever they are; only taken apart at newlines."""
    return content.cast("string")


def _newlines(content: Column) -> Column:
    text = _text(content)
    return (F.octet_length(content) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))).cast("bigint")


def chunk_line_counts(chunks: DataFrame) -> DataFrame:
    """(repo, path, lines): newline bytes, and one more for an unterminated last line; any bytes count."""
    some = F.octet_length("content") > 0
    ends = F.when(some, F.endswith(_text(F.col("content")), F.lit("\n")))
    per_chunk = chunks.select(*FILE, F.when(some, F.col("seq")).alias("seq"), _newlines(F.col("content")).alias("n"), ends.alias("ends"))
    counted = per_chunk.groupBy(*FILE).agg(F.sum("n").alias("n"), F.max_by("ends", "seq").alias("ends"))
    return counted.select(*FILE, (F.col("n") + F.when(~F.col("ends"), 1).otherwise(0)).alias("lines"))


def _parts(chunks: DataFrame) -> DataFrame:
    """(repo, path, seq, newlines, head, inner, tail) of every chunk.

    ``inner`` are its whole lines without the last newline, NULL if it has none. A chunk without a newline is all ``tail``.
    """
    text = _text(F.col("content"))
    size = F.octet_length("content")
    first = F.octet_length(F.substring_index(text, "\n", 1))
    back = F.octet_length(F.substring_index(text, "\n", -1))
    has = F.col("newlines") > 0
    # Positions are bytes: the contents stay binary.
    inner = F.when(F.col("newlines") > 1, F.substring(F.col("content"), F.col("first") + 2, F.col("size") - F.col("back") - F.col("first") - 2))
    return (
        chunks.select(*FILE, "seq", "content", _newlines(F.col("content")).alias("newlines"), size.alias("size"), first.alias("first"), back.alias("back"))
        .select(
            *FILE,
            "seq",
            "newlines",
            F.when(has, F.substring(F.col("content"), F.lit(1), F.col("first"))).alias("head"),
            inner.alias("inner"),
            F.substring(F.col("content"), F.col("size") - F.col("back") + 1, F.col("back")).alias("tail"),
        )
    )


def _carried(parts: DataFrame) -> DataFrame:
    """(repo, path, seq, line, text): lines cut by chunk ends, put together; ``seq`` is the chunk where one starts, -1 for the first."""
    before = Window.partitionBy(*FILE).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    has = F.col("newlines") > 0
    placed = parts.select(
        *FILE,
        "seq",
        "newlines",
        "head",
        "tail",
        F.coalesce(F.last(F.when(has, F.col("seq")), ignorenulls=True).over(before), F.lit(-1)).alias("owner"),
        F.coalesce(F.sum("newlines").over(before), F.lit(0)).alias("before"),
    )
    piece = lambda owner, line, part: F.struct(owner.alias("owner"), line.alias("line"), part.alias("part"))
    closing = piece(F.col("owner"), F.col("before"), F.col("head"))
    opening = piece(F.when(has, F.col("seq")).otherwise(F.col("owner")), F.col("before") + F.col("newlines"), F.col("tail"))
    pieces = placed.select(*FILE, "seq", F.explode(F.filter(F.array(closing, opening), lambda p: p["part"].isNotNull())).alias("p"))
    gathered = pieces.groupBy(*FILE, F.col("p.owner").alias("owner")).agg(
        F.min("p.line").alias("line"), F.array_sort(F.collect_list(F.struct("seq", "p.part"))).alias("parts")
    )
    joined = F.aggregate("parts", F.lit("").cast("binary"), lambda all_, p: F.concat(all_, p["part"]))
    return gathered.select(*FILE, F.col("owner").alias("seq"), (F.col("line") + 1).alias("line"), joined.alias("text"))


def _offsets(parts: DataFrame) -> DataFrame:
    """(repo, path, seq, before): newlines of a file before each chunk; a scan over one narrow row per chunk."""
    before = Window.partitionBy(*FILE).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(*FILE, "seq", F.coalesce(F.sum("newlines").over(before), F.lit(0)).alias("before"))


def _invalid_files(parts: DataFrame, carried: DataFrame) -> DataFrame:
    def bad(column: str) -> Column:
        return F.col(column).isNotNull() & F.try_validate_utf8(_text(F.col(column))).isNull()

    return parts.where(bad("inner")).select(*FILE).unionByName(carried.where(bad("text")).select(*FILE)).distinct()


def _found(chunks: DataFrame, inside: Column, carried_line: Column, extensions: list[str] | None = None) -> DataFrame:
    """Rows of ``inside``, an array of structs with a ``line`` per chunk's whole lines, and of the carried lines, numbered in the file."""
    ext = names.canonical_ext(names.file_ext(F.col("path")))
    wanted = chunks.where(ext.isNotNull() if extensions is None else ext.isin(extensions))
    parts = _parts(wanted)
    carried = _carried(parts)
    rows = parts.where(F.col("inner").isNotNull()).select(*FILE, "seq", ext.alias("canon_ext"), F.try_validate_utf8(_text(F.col("inner"))).alias("text"))
    rows = rows.where(F.col("text").isNotNull()).select(*FILE, "seq", "canon_ext", F.inline(inside))
    numbered = rows.join(_offsets(parts), [*FILE, "seq"]).withColumn("line", (F.col("line") + F.col("before") + 1).cast("bigint")).drop("seq", "before")
    alone = carried.select(*FILE, "line", ext.alias("canon_ext"), F.try_validate_utf8(_text(F.col("text"))).alias("text")).where(F.col("text").isNotNull())
    alone = alone.select(*FILE, "canon_ext", F.col("line").cast("bigint").alias("at"), F.inline(carried_line)).withColumn("line", F.col("at")).drop("at")
    return numbered.unionByName(alone).join(_invalid_files(parts, carried), FILE, "left_anti")


def chunk_todos(chunks: DataFrame) -> DataFrame:
    """(repo, path, line, marker, text), as ``todos.extract_todos`` gives it for whole files."""
    return _found(chunks, todos_array(raw_lines(F.col("text"))), todos_array(F.array("text"))).drop("canon_ext")


def chunk_source_lines(chunks: DataFrame) -> DataFrame:
    """(repo, path, canon_ext, line, content), as ``corpus.source_lines`` gives it for whole files."""

    def numbered(content: Column, carried: bool) -> Column:
        return F.transform(content, lambda s, i: F.struct((i + 1).alias("line"), s.alias("content"), F.lit(carried).alias("carried")))

    # One carriage return before the newline goes with it. Behind the last newline a line is open: it keeps the
    # return, and is no line if it is empty.
    unreturned = lambda s: F.regexp_replace(s, r"\r\z", "")
    found = _found(chunks, numbered(F.transform(raw_lines(F.col("text")), unreturned), False), numbered(F.array("text"), True))
    closed = F.max_by(F.endswith(_text(F.col("content")), F.lit("\n")), F.when(F.octet_length("content") > 0, F.col("seq")))
    ends = chunk_line_counts(chunks).join(chunks.groupBy(*FILE).agg(closed.alias("closed")), FILE)
    strip = F.col("carried") & (F.col("closed") | (F.col("line") < F.col("lines")))
    shown = F.when(strip, unreturned(F.col("content"))).otherwise(F.col("content"))
    return found.join(ends, FILE).where(F.col("line") <= F.col("lines")).select(*FILE, "canon_ext", "line", shown.alias("content"))


def _block_event(text: Column) -> Column:
    """How lines leave the state: TRUE inside an import block, FALSE outside, NULL as it was."""
    last = F.get(F.split(text, GO_BLOCK_START), F.size(F.split(text, GO_BLOCK_START)) - 1)
    body = F.coalesce(F.get(F.split(last, "\n", 2), F.lit(1)), F.lit(""))
    return F.when(F.regexp_like(text, F.lit(GO_BLOCK_START)), ~F.regexp_like(body, F.lit(GO_BLOCK_END))).when(F.regexp_like(text, F.lit(GO_BLOCK_END)), F.lit(False))


def chunk_imports(chunks: DataFrame) -> DataFrame:
    """(repo, path, imports), as ``imports.file_imports`` gives it for whole files."""
    ext = names.canonical_ext(names.file_ext(F.col("path")))
    parts = _parts(chunks.where(ext.isin(list(DISTINCT_CATEGORIES))))
    carried = _carried(parts)
    units = (
        parts.where(F.col("inner").isNotNull())
        .select(*FILE, "seq", F.lit(0).alias("part"), F.col("inner").alias("text"))
        .unionByName(carried.select(*FILE, "seq", F.lit(1).alias("part"), "text"))
        .select(*FILE, "seq", "part", ext.alias("canon_ext"), F.try_validate_utf8(_text(F.col("text"))).alias("text"))
        .where(F.col("text").isNotNull())
    )

    def items(text: Column) -> Column:
        return import_items(text, raw_lines(text), F.col("canon_ext"))

    # What a unit finds and how it leaves the state, for both states it may start in.
    is_go = F.col("canon_ext") == "go"
    within = F.concat(F.lit("import (\n"), F.col("text"))
    told = units.select(
        *FILE,
        "seq",
        "part",
        "canon_ext",
        items(F.col("text")).alias("outside"),
        F.when(is_go, items(within)).alias("inside"),
        F.when(is_go, _block_event(F.col("text"))).alias("event"),
    ).where((F.size("outside") > 0) | (F.size("inside") > 0) | F.col("event").isNotNull())
    before = Window.partitionBy(*FILE).orderBy("seq", "part").rowsBetween(Window.unboundedPreceding, -1)
    state = F.coalesce(F.last("event", ignorenulls=True).over(before), F.lit(False))
    taken = told.withColumn("state", state).select(*FILE, "canon_ext", "seq", "part", F.when(F.col("state"), F.col("inside")).otherwise(F.col("outside")).alias("items"))
    whole = taken.where(F.size("items") > 0).groupBy(*FILE, "canon_ext").agg(F.array_sort(F.collect_list(F.struct("seq", "part", "items"))).alias("all"))
    found = whole.select(*FILE, grouped_imports(F.flatten(F.col("all.items")), F.col("canon_ext")).alias("imports"))
    return found.join(_invalid_files(parts, carried), FILE, "left_anti")
