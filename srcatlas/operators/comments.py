"""Header comments per language.

A header is cut out of the text by one anchored pattern that walks whole lines
and stops at the first line of code, so the cost follows the header, not the
file. All repetitions are possessive: they neither back up nor recurse. The few
header lines are then cleaned with array functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcatlas.functions.text import HWS, WS, ltrim, raw_lines, trim
from srcatlas.operators.corpus import with_text

# Comment openings and the lines a header may skip.
RUBY_MAGIC = ["# frozen_string_literal", "# encoding:", "# coding:"]
SHEBANG = "#!"
JAVADOC_TAG = "@"

_SOMETHING = rf"(?=[{HWS}]*+[^{WS}])"


def _skip(*starts: str) -> str:
    """Pattern for leading lines that are blank or start with one of ``starts``."""
    blank = f"[{HWS}]*+"
    some = f"(?:(?:{'|'.join(starts)})[^\\n]*+)?+"
    return rf"\A(?:{blank}{some}\n)*+(?:{blank}{some}\z)?+"


def _skip_then_run(skipped: list[str], run: str) -> str:
    """Group 1 is the unbroken run of lines starting with ``run`` after skipped lines."""
    blank = f"[{HWS}]*+"
    return (
        rf"\A(?:{blank}(?:(?:{'|'.join(skipped)})[^\n]*+)?+\n)*+"
        rf"((?:{blank}{run}[^\n]*+(?:\n|\z))++)"
    )


def _joined(items: Column) -> Column:
    """Lines as one text; NULL when all of them are empty."""
    return F.when(F.exists(items, lambda s: s != ""), F.array_join(items, "\n"))


def _marked(header: Column, *marks: str) -> Column:
    """Header lines that start with a mark, without the first mark that fits."""

    def body(line: Column) -> Column:
        out = None
        for mark in marks:
            hit = F.startswith(line, F.lit(mark))
            rest = trim(F.substring(line, len(mark) + 1, 1 << 30))
            out = F.when(hit, rest) if out is None else out.when(hit, rest)
        return out

    stripped = F.transform(raw_lines(header), lambda line: body(trim(line)))
    return F.filter(stripped, lambda s: s.isNotNull())


def _block_lines(body: Column, drop: Callable[[Column], Column] | None = None) -> Column:
    cleaned = F.transform(raw_lines(body), lambda s: trim(F.ltrim(trim(s), F.lit("*"))))
    kept = F.filter(cleaned, lambda s: (s != "") & ~drop(s) if drop else s != "")
    return F.when(F.size(kept) > 0, F.array_join(kept, "\n"))


def _block(text: Column, opening: str, drop: Callable[[Column], Column] | None = None) -> Column:
    """Block comment at the start; it ends at the first closing mark after the opening."""
    body = F.regexp_extract(ltrim(text), rf"(?s)\A{opening}(.*?)\*/", 1)
    return _block_lines(body, drop)


def _slash_run(text: Column) -> Column:
    header = F.regexp_extract(text, _skip("//"), 0)
    return _joined(_marked(header, "//"))


def rust_comment(text: Column) -> Column:
    module = _joined(_marked(F.regexp_extract(text, _skip("//"), 0), "//!"))
    item_run = _skip_then_run(["(?!///)//", r"#!?\["], "///")
    item = _joined(_marked(F.regexp_extract(text, item_run, 1), "///"))
    return F.coalesce(module, item, _block(text, r"/\*"))


def python_docstring(text: Column) -> Column:
    found = (
        rf"(?s)\A(?:[{HWS}]*+(?:#[^\n]*+)?+\n)*+[{WS}]*+"
        r"""(?:\"{3}(.*?)\"{3}|'{3}(.*?)'{3})"""
    )
    doc = trim(F.concat(F.regexp_extract(text, found, 1), F.regexp_extract(text, found, 2)))
    return F.when(doc != "", F.array_join(F.transform(raw_lines(doc), trim), "\n"))


def js_comment(text: Column) -> Column:
    return F.coalesce(_block(text, r"/\*\*", lambda s: s == "/"), _slash_run(text))


def go_comment(text: Column) -> Column:
    """Package comment: the comment lines right above ``package``.

    Other code lines void what was collected; a line that opens a block
    comment ends the search with the first block of the text.
    """
    blank = f"[{HWS}]*+"
    stop = rf"{blank}(?:/\*|package {_SOMETHING})"
    region = rf"\A((?:(?!{stop})[^\n]*+(?:\n|\z))*+)({blank}/\*)?+"
    above = F.regexp_extract(text, region, 1)
    at_block = F.regexp_extract(text, region, 2) != ""
    block = _block_lines(F.regexp_extract(text, r"(?s)\A(?:(?!/\*).)*+/\*(.*?)\*/", 1))
    rows = F.transform(raw_lines(above), trim)
    code = F.transform(
        F.reverse(rows), lambda s: (s != "") & ~F.startswith(s, F.lit("//"))
    )
    after_code = F.array_position(code, F.lit(True))
    tail = F.when(after_code > 0, F.slice(F.reverse(rows), F.lit(1), (after_code - 1).cast("int")))
    lines = F.coalesce(F.reverse(tail), rows)
    run = F.transform(
        F.filter(lines, lambda s: F.startswith(s, F.lit("//"))),
        lambda s: trim(F.substring(s, 3, 1 << 30)),
    )
    return F.coalesce(F.when(at_block, block), _joined(run))


def c_comment(text: Column) -> Column:
    return F.coalesce(_block(text, r"/\*"), _slash_run(text))


def hash_comment(text: Column, magic: list[str]) -> Column:
    """Run of ``#`` lines; shebang and magic lines are passed over."""
    skipped = [SHEBANG, *magic]
    run = F.regexp_extract(text, _skip_then_run(skipped, "#"), 1)

    def passed_over(line: Column) -> Column:
        hit = F.startswith(line, F.lit(skipped[0]))
        for mark in skipped[1:]:
            hit = hit | F.startswith(line, F.lit(mark))
        return hit

    kept = F.filter(F.transform(raw_lines(run), trim), lambda s: (s != "") & ~passed_over(s))
    return _joined(F.transform(kept, lambda s: trim(F.substring(s, 2, 1 << 30))))


def javadoc_comment(text: Column) -> Column:
    tagged = lambda s: F.startswith(s, F.lit(JAVADOC_TAG))
    return F.coalesce(_block(text, r"/\*\*", tagged), _slash_run(text))


def php_comment(text: Column) -> Column:
    body = F.regexp_replace(ltrim(text), r"\A<\?(?:php)?", "")
    tagged = lambda s: F.startswith(s, F.lit(JAVADOC_TAG))
    header = F.regexp_extract(body, _skip("//", r"#(?!\[)"), 0)
    return F.coalesce(_block(body, r"/\*\*", tagged), _joined(_marked(header, "//", "#")))


def csharp_comment(text: Column) -> Column:
    header = F.regexp_extract(text, _skip("//", f"using {_SOMETHING}", r"\["), 0)

    def body(line: Column) -> Column:
        doc = trim(F.substring(line, 4, 1 << 30))
        tag = F.startswith(doc, F.lit("<")) | F.endswith(doc, F.lit(">"))
        return F.when(F.startswith(line, F.lit("///")), F.when(~tag, doc)).when(
            F.startswith(line, F.lit("//")), trim(F.substring(line, 3, 1 << 30))
        )

    kept = F.filter(
        F.transform(raw_lines(header), lambda s: body(trim(s))), lambda s: s.isNotNull()
    )
    return F.coalesce(_joined(kept), _block(text, r"/\*"))


COMMENT_RULES: dict[tuple[str, ...], Callable[[Column], Column]] = {
    ("rs",): rust_comment,
    ("py",): python_docstring,
    ("js", "ts"): js_comment,
    ("go",): go_comment,
    ("c", "cpp"): c_comment,
    ("rb",): lambda text: hash_comment(text, RUBY_MAGIC),
    ("sh",): lambda text: hash_comment(text, []),
    ("java", "kt", "swift"): javadoc_comment,
    ("php",): php_comment,
    ("cs",): csharp_comment,
}


def header_comment(text: Column, canon_ext: Column) -> Column:
    """Header comment of one file; NULL when there is none or the language has no rule."""
    out = None
    for exts, rule in COMMENT_RULES.items():
        test = canon_ext.isin(list(exts))
        out = F.when(test, rule(text)) if out is None else out.when(test, rule(text))
    return out


def extract_comments(files: DataFrame, **gates: int) -> DataFrame:
    """(repo, path, comment), one row per file that has a header comment."""
    known = [ext for exts in COMMENT_RULES for ext in exts]
    found = header_comment(F.col("text"), F.col("canon_ext"))
    # As a generator the comment is worked out once, not again for the NULL test.
    return (
        with_text(files, **gates)
        .where(F.col("canon_ext").isin(known))
        .select("repo", "path", F.explode(F.array_compact(F.array(found))).alias("comment"))
    )
