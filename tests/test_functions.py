"""Column functions against exact values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from srcatlas.functions import display, globs, names, text


def one(spark, column, *values):
    schema = ", ".join(f"c{i} {t}" for i, (_, t) in enumerate(values))
    df = spark.createDataFrame([tuple(v for v, _ in values)], schema)
    return df.select(column.alias("x")).first().x


def over(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_sizes_and_numbers(spark):
    sizes = [0, 1023, 1024, 1280, 1792, 1536, 1048576, 1 << 30, 5 * (1 << 30) + (1 << 28)]
    assert over(spark, sizes, display.format_size, "bigint") == [
        "0B", "1023B", "1.0K", "1.2K", "1.8K", "1.5K", "1.0M", "1.0G", "5.2G"]
    assert over(spark, [0, 999, 1000, 1234567], display.format_number, "bigint") == ["0", "999", "1,000", "1,234,567"]


def test_wrap(spark):
    cases = [
        ("mast boom and sail", 9, ["mast boom", "and sail"]),
        ("lighthousekeeper", 6, ["lighth", "ouseke", "eper"]),
        ("at lighthouses by it", 6, ["at", "lighth", "ouses", "by it"]),
        ("", 7, [""]),
        ("two  gaps", 0, ["two  gaps"]),
        ("🌊🌊🌊🌊", 3, ["🌊🌊🌊", "🌊"]),
        ("北海道港", 3, ["北海道", "港"]),
        ("Kap 北海 🌊", 6, ["Kap 北海", "🌊"]),
        ("  a\t b c  ", 3, ["a b", "c"]),
    ]
    for value, width, want in cases:
        assert over(spark, [value], lambda c: text.wrap_text(c, width)) == [want]
    widths = [one(spark, text.wrap_width(F.col("c0"), 4, 2), (w, "int")) for w in (100, None, 15)]
    assert widths == [94, None, None]


def _greedy(value: str, width: int) -> list[str]:
    out, line = [], ""
    for word in value.split():
        if line and len(line) + 1 + len(word) <= width:
            line += " " + word
            continue
        if line:
            out.append(line)
        while len(word) > width:
            out.append(word[:width])
            word = word[width:]
        line = word
    return out + [line] if line or not out else out


def test_wrap_random(spark):
    import random

    rng = random.Random(5)
    values = [" ".join("x" * rng.randint(1, 14) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    for width in (1, 5, 12):
        got = over(spark, values, lambda c: text.wrap_text(c, width))
        assert got == [_greedy(v, width) for v in values]


def test_lines_and_counts(spark):
    assert over(spark, ["a\r\nb\n", "", "a\n\n", "a\r\rb"], text.lines) == [["a", "b"], [], ["a", ""], ["a\r\rb"]]
    blobs = [b"", b"\n", b"a", b"a\nb", b"\xff\n\xfe\n", b"x\r\n"]
    assert over(spark, blobs, text.count_lines, "binary") == [0, 1, 1, 2, 2, 1]
    big = over(spark, [b"a\n"], lambda c: text.count_lines(c, F.lit(5_000_001), 5_000_000), "binary")
    assert big == [None]
    assert over(spark, ["  \tx", "x", "\t\tx", ""], text.indent_of) == [6, 0, 8, 0]
    assert over(spark, ["　 x  ", "​x"], text.trim) == ["x", "​x"]


def test_paths(spark):
    paths = ["", "a", "a/b/c.tar.GZ", "Makefile", ".gitignore", "foo.", "d/.x.rs", "日本/ファイル.PY"]
    assert over(spark, paths, names.base_name) == [".", "a", "c.tar.GZ", "Makefile", ".gitignore", "foo.", ".x.rs", "ファイル.PY"]
    assert over(spark, paths, names.parent_path) == [None, "", "a/b", "", "", "", "d", "日本"]
    assert over(spark, paths, names.path_depth) == [0, 1, 3, 1, 1, 1, 2, 2]
    assert over(spark, paths, names.file_ext) == ["", "", "gz", "", "", "", "rs", "py"]
    assert over(spark, ["", "a", "a/b/c"], names.ancestors) == [[], [""], ["", "a", "a/b"]]
    assert over(spark, ["a", "a/b/c"], lambda c: names.ancestors(c, False)) == [[], ["a", "a/b"]]
    exts = ["rs", "py", "jsx", "tsx", "hpp", "xyz", "edn"]
    assert over(spark, exts, names.canonical_ext) == ["rs", "py", "js", "ts", "cpp", None, "clj"]
    langs = ["rs", "js", "ts", "py", "unknown", "", "jsx", "edn"]
    assert over(spark, langs, names.language_of) == [
        "Rust", "JavaScript", "TypeScript", "Python", "Other", "No Extension", "JSX", "Other"]
    assert sum(map(len, names.CANONICAL_EXTENSIONS.values())) == 58
    assert len(names.CANONICAL_EXTENSIONS) == 29


GLOBS = [
    ("*.kt", "quay.kt", True), ("*.kt", ".kt", True), ("*.kt", "quay.kts", False),
    ("sail*", "sailor", True), ("sail*", "mainsail", False), ("keel", "keel", True),
    ("keel", "keels", False), ("log?.md", "log7.md", True), ("log?.md", "log17.md", False),
    ("[xyz]-axis", "y-axis", True), ("[xyz]-axis", "w-axis", False), ("[0-9]x", "4x", True),
    ("[0-9]x", "ax", False), ("[!q]ua", "oua", True), ("[!q]ua", "qua", False),
    ("[open", "[open", True), ("k**", "kl", False), ("**", "whatever", True), ("[y-b]", "c", False),
    ("m.n", "mxn", False), ("[]]", "]", True),
]


@pytest.mark.parametrize("pattern,name,want", GLOBS)
def test_globs(spark, pattern, name, want):
    assert over(spark, [name], lambda c: globs.name_matches(c, [pattern])) == [want]


def test_display(spark):
    assert over(spark, ["pub fn moor() {", " x;; ", "a {;"], display.clean_signature) == ["pub fn moor()", "x", "a {"]
    assert over(spark, ["std::a::b", "super::c", "crate::std::d"], display.simplify_path) == ["a::b", "super::c", "std::d"]
    df = spark.createDataFrame(
        [((["tokio", "rand"], ["net", "fmt"], ["dock"]),), (([], [], []),)],
        "i struct<external:array<string>,std:array<string>,internal:array<string>>",
    )
    got = df.select(display.imports_summary(F.col("i")).alias("s"), display.import_label(F.col("i")).alias("l")).collect()
    assert got[0].s == "tokio, rand, std::{net, fmt}, crate::{dock}" and got[0].l == "imports: " + got[0].s
    assert got[1].s == "" and got[1].l is None
    span = one(spark, display.symbol_span(F.col("c0"), F.col("c1")), ("pub fn moor()", "string"), ("moor", "string"))
    assert span == 8
    label = one(spark, display.todo_label(F.lit("TODO"), F.col("c0"), F.lit(3)), ("x", "string"))
    assert label == "TODO: x (line 3)"
