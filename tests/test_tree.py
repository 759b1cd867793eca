"""Filters, ignore rules, listings and reports."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from report_helpers import report_text
from pyspark.sql import functions as F

from srcatlas.operators import filters, ignore, metadata as md, reports, stats, tree
from srcatlas.operators.skew import number_rows, spread_join
from srcatlas.operators.todos import extract_todos


def shown(df):
    return {r.path for r in df.collect()}


IGNORE_CASES = [
    ({".gitignore": "*.log\ntarget/", "main.rs": "", "debug.log": ""}, {"debug.log"}),
    ({".gitignore": "target/", "app/a.rs": "", "target/debug": "", "target/a/b": ""},
     {"target", "target/debug", "target/a", "target/a/b"}),
    ({".gitignore": "*.log", "subdir/.gitignore": "*.tmp", "root.log": "", "subdir/cache.tmp": "",
      "subdir/nested.log": "", "root.tmp": ""}, {"root.log", "subdir/cache.tmp", "subdir/nested.log"}),
    ({".gitignore": "*.log\n!important.log", "a.log": "", "important.log": ""}, {"a.log"}),
    ({".gitignore": "[invalid\n**/\n# c\n\n[z-a]\nx[]\n", "a": "", "invalid": ""}, set()),
    ({".gitignore": "/top\ndoc/*.txt\n**/deep/x\nabc/**\n\\#hash\n\\!bang\ntrail  \n", "top": "", "sub/top": "", "doc/a.txt": "",
      "doc/s/b.txt": "", "deep/x": "", "q/deep/x": "", "abc/d": "", "#hash": "", "!bang": "", "trail": ""},
     {"top", "doc/a.txt", "deep/x", "q/deep/x", "abc/d", "#hash", "!bang", "trail"}),
    ({".gitignore": "build\n!build/keep", "build/keep": "", "s/build": ""}, {"build", "build/keep", "s/build"}),
    ({".gitignore": "*.o", "d/.gitignore": "!keep.o", "d/keep.o": "", "d/x.o": "", "keep.o": ""}, {"d/x.o", "keep.o"}),
    ({".gitignore": "f[!a-c]?.t\na/**/z\n", "fd1.t": "", "fa1.t": "", "a/z": "", "a/b/c/z": "", "z": ""},
     {"fd1.t", "a/z", "a/b/c/z"}),
    ({".gitignore": "name/", "name": "", "x/name/f": ""}, {"x/name", "x/name/f"}),
    ({".gitignore": "a+b(1).t\n*.{x}\nq.r\n", "a+b(1).t": "", "y.{x}": "", "qxr": "", "q.r": ""}, {"a+b(1).t", "y.{x}", "q.r"}),
]


@pytest.mark.parametrize("limit", ["2000000", "2"])
def test_ignore_rules(spark, make_files, limit):
    spark.conf.set("spark.srcatlas.hotKeyRows", limit)
    try:
        rows = [(f"r{i}", p, c) for i, (files, _) in enumerate(IGNORE_CASES) for p, c in files.items()]
        files = make_files(rows)
        rules = ignore.read_ignore_rules(files)
        entries = ignore.all_entries(files)
        kept = ignore.included_entries(files, rules)
        gone = entries.join(kept, ["repo", "path", "is_dir"], "left_anti").collect()
        for i, (_, want) in enumerate(IGNORE_CASES):
            assert {r.path for r in gone if r.repo == f"r{i}"} == want, i
    finally:
        spark.conf.unset("spark.srcatlas.hotKeyRows")


def test_second_ignore_file_outranks(make_files):
    files = make_files({".gitignore": "*.a\n", ".ignore": "!x.a\n", "d/.gitignore": "x.a", "x.a": "", "d/x.a": "", "y.a": ""})
    rules = ignore.read_ignore_rules(files, (".gitignore", ".ignore"))
    got = shown(ignore.included_entries(files, rules).where("not is_dir"))
    assert got == {".gitignore", ".ignore", "d/.gitignore", "x.a", "d/x.a"}


def test_tracked(spark, make_files):
    files = make_files({"a/t.rs": "", "u.rs": "", "b/c/m.rs": "", "n.rs": ""})
    index = spark.createDataFrame([("r", "a/t.rs")], "repo string, path string")
    status = spark.createDataFrame(
        [("r", "b/c/m.rs", False, False), ("r", "n.rs", True, False), ("r", "u.rs", False, True)],
        "repo string, path string, is_new boolean, is_ignored boolean",
    )
    tracked = ignore.tracked_paths(index, status)
    assert shown(ignore.tracked_files(files, tracked)) == {"a/t.rs", "b/c/m.rs"}
    nodes = tree.list_nodes(files, tracked=tracked)
    assert shown(nodes) == {"", "a", "a/t.rs", "b", "b/c", "b/c/m.rs"}


def test_listing_filters(make_files):
    files = make_files(
        {"top.rs": "x", "level1/mid.rs": "// TODO: x", "level1/level2/deep.rs": "", ".git/config": "", "ln.rs": "", "node_modules/x/y.js": ""},
        links=("ln.rs",), dirs=("empty", "level1"),
        mtimes={"top.rs": dt.datetime(2024, 6, 1), "level1/mid.rs": None},
    )
    base = {"", "empty", "level1", "level1/level2", "node_modules", "node_modules/x"}
    everything = base | {"top.rs", "level1/mid.rs", "level1/level2/deep.rs", "node_modules/x/y.js"}
    assert shown(tree.list_nodes(files)) == everything
    assert shown(tree.list_nodes(files, max_depth=1)) == {"", "empty", "level1", "node_modules", "top.rs"}
    assert shown(tree.list_nodes(files, max_depth=0)) == {""}
    assert shown(tree.list_nodes(files, dirs_only=True)) == base
    cut = tree.list_nodes(files, ignore_names=["node_*", "empty"])
    assert shown(cut) == everything - {"node_modules", "node_modules/x", "node_modules/x/y.js", "empty"}
    assert shown(tree.list_nodes(files, newer="2024-05-01 00:00:00")) == base | {"top.rs", "level1/mid.rs"}
    assert shown(tree.list_nodes(files, older="2024-05-01 00:00:00")) == everything - {"top.rs"}
    with_todos = tree.list_nodes(files, with_todos=extract_todos(files))
    assert shown(with_todos) == base | {"level1/mid.rs"}


def test_rules_prune_directories(make_files):
    files = make_files(
        {".gitignore": "out/\nhide.txt\n", "out/a": "", "only/hide.txt": "", "s/k.rs": ""}, dirs=("void", "out/void")
    )
    rules = ignore.read_ignore_rules(files)
    assert shown(tree.list_nodes(files, rules=rules)) == {"", ".gitignore", "only", "s", "s/k.rs", "void"}
    assert "out/void" in shown(tree.list_nodes(files, rules=rules, dirs_only=True))
    assert "out" not in shown(tree.list_nodes(files, rules=rules, dirs_only=True, rules_hide_dirs=True))
    assert "out/a" in shown(tree.list_nodes(files, rules=rules, show_all=True))


def test_hidden(make_files):
    files = make_files({"a.rs": "", ".hid/b.rs": "", "c/.d": "", "__init__.py": "", ".git/x": ""})
    assert shown(stats.countable_files(files)) == {"a.rs", "__init__.py"}
    assert shown(stats.countable_files(files, show_hidden=True)) == {"a.rs", "__init__.py", ".hid/b.rs", "c/.d"}
    assert not files.where(filters.not_hidden(F.col("path"))).where("path = 'c/.d'").count()


PATHS = {"zebra.rs": "", "apple.rs": "", "a-b": "", "a/x": "", "a/b/c.rs": "", "a/b/d.rs": "", "a/zz/e": "", "m/n/o/p": "", "é": ""}


def preorder(paths):
    every = {""}
    for p in paths:
        parts = p.split("/")
        every |= {"/".join(parts[: i + 1]) for i in range(len(parts))}
    return sorted(every, key=lambda p: [c.encode() for c in p.split("/")] if p else [])


def drawn(paths):
    order = preorder(paths)
    out, closed = {}, {}
    for p in order:
        if not p:
            out[p] = "."
            continue
        parent, _, name = p.rpartition("/")
        siblings = [q for q in order if q and q.rpartition("/")[0] == parent]
        closed[p] = siblings[-1] == p
        up = [a for a in order if a and p.startswith(a + "/")]
        out[p] = "".join("    " if closed[a] else "│   " for a in up) + ("└── " if closed[p] else "├── ") + name
    return [out[p] for p in order]


@pytest.mark.parametrize("limit", ["2000000", "1"])
def test_tree_shape(spark, make_files, limit):
    spark.conf.set("spark.srcatlas.hotKeyRows", limit)
    try:
        files = make_files(PATHS)
        nodes = tree.list_nodes(files)
        text = report_text(reports.text_report(nodes), "r").split("\n")
        assert text[:-2] == drawn(PATHS)
        assert text[-2:] == ["", "6 directories, 9 files"]
    finally:
        spark.conf.unset("spark.srcatlas.hotKeyRows")
    ranked = tree.with_preorder(nodes).orderBy("preorder").collect()
    assert [r.path for r in ranked] == preorder(PATHS)
    assert [r.preorder for r in ranked] == list(range(1, len(ranked) + 1))
    ends = tree.with_last_flag(nodes).where("is_last").groupBy("parent").count().collect()
    assert all(r["count"] == 1 for r in ends)


def test_number_rows_spans_partitions(spark):
    df = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 97)).alias("g"),
        F.sha1(F.col("id").cast("string")).alias("o"),
    )
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = number_rows(df, ["g"], ["o"], "n")
        want = df.selectExpr("g", "o", "row_number() over (partition by g order by o) as n")
        assert got.select("g", "o", "n").exceptAll(want.selectExpr("g", "o", "cast(n as bigint)")).count() == 0
        assert got.count() == 20_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_spread_join_matches_plain_join(spark):
    rows = spark.range(10_000).selectExpr("if(id % 3 = 0, 0, id % 50) as k", "id as r")
    lookup = spark.range(40).selectExpr("id as k", "id * 2 as v")
    spark.conf.set("spark.srcatlas.hotKeyRows", "500")
    try:
        for how in ("left", "inner"):
            got = spread_join(rows, lookup, ["k"], ["r"], how).select("k", "r", "v")
            want = rows.join(lookup, "k", how).select("k", "r", "v")
            assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    finally:
        spark.conf.unset("spark.srcatlas.hotKeyRows")


def test_stats(make_files):
    files = make_files(
        [("r", "a.rs", "x\ny"), ("r", "b/c.RS", "x\n"), ("r", "b/d.py", ""), ("r", "Makefile", "a"), ("r", "q.weird", b"\xff\n"),
         ("s", "x/y/z.js", "1\n2\n3\n")]
    )
    got = {(r.repo, r.language): (r.files, r.lines, list(r.extensions)) for r in stats.listed_language_stats(stats.language_extensions(files)).collect()}
    assert got == {
        ("r", "Rust"): (2, 3, [".rs"]), ("r", "Python"): (1, 0, [".py"]), ("r", "No Extension"): (1, 1, []),
        ("r", "Other"): (1, 1, [".weird"]), ("s", "JavaScript"): (1, 3, [".js"]),
    }
    bare = {(r.repo, r.language): r.lines for r in stats.language_stats(files, with_lines=False).collect()}
    assert set(bare.values()) == {None}
    totals = {r.repo: (r.files, r.directories, r.total_lines) for r in stats.codebase_totals(files).collect()}
    assert totals == {"r": (5, 1, 5), "s": (1, 2, 3)}
    roll = {r.path: (r.dirs, r.files, r.bytes) for r in stats.directory_rollup(files).where("repo = 's'").collect()}
    assert roll == {"": (2, 1, 6), "x": (1, 1, 6), "x/y": (0, 1, 6)}
    levels = {(r.repo, r.language): (r.level, r.files, r.lines) for r in stats.stats_rollup(files).collect()}
    assert levels[(None, None)] == (3, 6, 8) and levels[("r", None)] == (1, 5, 5) and levels[("r", "Rust")] == (0, 2, 3)
    ranked = stats.languages_by_files(stats.language_stats(files)).where("repo = 'r'").orderBy("rank").collect()
    assert [r.language for r in ranked] == ["Rust", "No Extension", "Other", "Python"]
    out = reports.stats_report(stats.language_stats(files), stats.codebase_totals(files))
    text = report_text(out, "s").split("\n")
    assert text == ["Codebase Statistics", "───────────────────", "Files:        1 total", "Directories:  2", "",
                    "By Language:", "  JavaScript       1 files         3 lines", "", "Total:       3 lines of code"]
    js = {r.repo: json.loads(r.json) for r in reports.stats_json(stats.listed_language_stats(stats.language_extensions(files, False)), stats.codebase_totals(files, False)).collect()}
    assert js["s"] == {"files": 1, "directories": 2, "total_lines": None,
                       "by_language": [{"language": "JavaScript", "files": 1, "extensions": [".js"]}]}


def build_lines(spark, comment=(), types=(), imports=(), todos=()):
    def rows(section, items):
        return [(section, section, *(i if isinstance(i, tuple) else (i, None, 0))) for i in items]

    schema = f"comment_lines {md.LINE_TYPE}, type_lines {md.LINE_TYPE}, import_lines {md.LINE_TYPE}, todo_lines {md.LINE_TYPE}"
    return spark.createDataFrame(
        [(rows("comment", comment), rows("type", types), rows("import", imports), rows("todo", todos))], schema
    )


def laid(spark, full=True, order=md.COMMENTS_FIRST, width=None, **sections):
    r = md.with_layout(build_lines(spark, **sections), full, order, width).first()
    return r.layout, r.inline.content if r.inline else None, [" " * b.indent + b.text if b.text is not None else None for b in r.block]


def test_layout(spark):
    assert laid(spark) == ("empty", None, [])
    assert laid(spark, full=False, comment=["a", "b"]) == ("inline", "a", [])
    assert laid(spark, comment=["a"]) == ("inline", "a", [])
    assert laid(spark, comment=["a", "b"]) == ("block", None, [None, "a", "b", None])
    assert laid(spark, comment=["a"], types=["t"]) == ("inline_block", "a", [None, "t", None])
    assert laid(spark, order=md.TYPES_FIRST, comment=["a"], types=["t"]) == ("inline_block", "t", [None, "a", None])
    assert laid(spark, imports=["i"]) == ("inline", "i", [])
    assert laid(spark, imports=["i"], todos=["t"]) == ("inline_block", "t", [None, "i", None])
    assert laid(spark, imports=["i"], todos=["t", "u"]) == ("block", None, [None, "i", None, "t", "u", None])
    assert laid(spark, comment=["a"], todos=["t"]) == ("inline_block", "a", [None, None, "t", None])
    grouped = [("A", "A", 0), ("m", "m", 4), ("B", "B", 0), ("C", "C", 0), ("n", "n", 2)]
    assert laid(spark, types=grouped) == ("block", None, [None, "A", "    m", None, "B", None, "C", "  n", None])
    assert laid(spark, comment=["a", "", "b"], width=3) == ("block", None, [None, "a", None, "b", None])
    assert laid(spark, comment=["one two three", "x"], width=7) == ("block", None, [None, "one two", "three", "x", None])
    for order in (md.COMMENTS_FIRST, md.TYPES_FIRST):
        df = build_lines(spark, comment=["c"], types=["t"])
        rows = df.select(F.explode(md.ordered_lines(order)).alias("m")).select("m.content").collect()
        assert [r.content for r in rows] == (["c", "", "t"] if order == md.COMMENTS_FIRST else ["t", "", "c"])


def test_separator_and_predicates(spark):
    cases = [(0, None, False, False), (0, 0, False, False), (0, 4, False, True), (0, 0, True, True), (4, 4, True, False)]
    df = spark.createDataFrame([(i, p, i + 1 if c else i, w) for i, p, c, w in cases], "i int, p int, n int, w boolean")
    got = df.select(md.needs_group_separator(F.col("i"), F.col("p"), F.col("n")).alias("g"), "w").collect()
    assert all(r.g == r.w for r in got)
    df = build_lines(spark, comment=["a"], todos=["t"])
    row = df.select(md.total_lines().alias("n"), md.has_both().alias("b"), md.has_todos().alias("t"), md.has_imports().alias("i"),
                    md.has_only("comment").alias("o"), md.is_empty().alias("e"), md.first_section_is_single_line().alias("s")).first()
    assert tuple(row) == (2, False, True, False, False, False, True)


def test_section_choice():
    pick = md.select_sections
    assert pick() == md.Sections(comments=True)
    assert pick(types=True) == md.Sections(comments=False, types=True, full=True)
    assert pick(todos=True) == md.Sections(comments=False, todos=True, full=True)
    assert pick(comments=True, types=True) == md.Sections(comments=True, types=True, full=True)
    assert pick(no_comments=True) == md.Sections(comments=False)
    assert pick(imports=True) == md.Sections(comments=True, imports=True, full=True)


SOURCES = {
    "lib.rs": "//! Library docs\nuse std::fmt;\nuse clap::X;\npub struct A;\n// TODO: finish\n",
    "src/one.py": '"""Doc."""\n',
    "src/none.txt": "plain",
    "src/deep/two.rs": "//! First\n//! Second\npub fn go() {\n",
}


def test_reports(spark, make_files):
    files = make_files(SOURCES)
    nodes = tree.list_nodes(files)
    short = md.with_section_lines(md.file_sections(files))
    assert report_text(reports.text_report(nodes, short, show_size=True), "r").split("\n") == [
        ".", "├── lib.rs  [74B]  Library docs", "└── src", "    ├── deep", "    │   └── two.rs  [35B]  First",
        "    ├── none.txt  [5B]", "    └── one.py  [11B]  Doc.", "", "2 directories, 4 files"]
    every = md.Sections(comments=True, types=True, todos=True, imports=True, full=True)
    long = md.with_section_lines(md.file_sections(files, every))
    text = report_text(reports.text_report(nodes, long, full=True, prefix="# "), "r").split("\n")
    assert text[:9] == [
        ".", "├── lib.rs  # Library docs", "│   ", "│   # pub struct A", "│   ", "│   # imports: clap, std::{fmt}", "│   ",
        "│   # TODO: finish (line 5)", "│   "]
    assert "    │       # Second" in text and "    │       # pub fn go()" in text
    md_text = report_text(reports.markdown_report(nodes, short, show_size=True), "r").split("\n")
    assert md_text == [
        "- **./**", "  - `lib.rs` (74B) - Library docs", "  - **src/**", "    - **deep/**", "      - `two.rs` (35B) - First",
        "    - `none.txt` (5B)", "    - `one.py` (11B) - Doc.", "", "*2 directories, 4 files*"]
    md_full = report_text(reports.markdown_report(nodes, long, full=True), "r").split("\n")
    assert md_full[1:8] == ["  - `lib.rs` - Library docs", "    ", "    > pub struct A", "    > imports: clap, std::{fmt}",
                            "    > TODO: finish (line 5)", "", "  - **src/**"]


def test_json(make_files):
    files = make_files(SOURCES)
    nodes = tree.list_nodes(files)
    found = md.file_sections(files, md.Sections(True, True, True, True))
    records = {r.path: json.loads(r.json) for r in reports.json_records(nodes, found, show_size=True).collect()}
    assert records["src/none.txt"] == {"type": "file", "name": "none.txt", "path": "src/none.txt", "size_bytes": 5, "size_human": "5B"}
    assert records["lib.rs"] == {
        "type": "file", "name": "lib.rs", "path": "lib.rs", "comment": "Library docs", "types": ["pub struct A"],
        "todos": [{"type": "TODO", "text": "finish", "line": 5}], "imports": {"external": ["clap"], "std": ["fmt"]},
        "size_bytes": 74, "size_human": "74B"}
    doc = json.loads(report_text(reports.json_tree(nodes, found), "r").replace("\n", ""))
    assert [c["name"] for c in doc["children"]] == ["lib.rs", "src"]
    assert [c["name"] for c in doc["children"][1]["children"]] == ["deep", "none.txt", "one.py"]
    assert doc["children"][1]["children"][0]["children"][0]["comment"] == "First\nSecond"


def test_metadata_rows_and_extension_point(make_files):
    files = make_files(SOURCES)
    rows = md.metadata_lines(files, md.Sections(True, True, True, True)).where("path = 'lib.rs'").orderBy("seq").collect()
    assert [(r.section, r.content) for r in rows] == [
        ("comment", "Library docs"), ("separator", ""), ("type", "pub struct A"), ("separator", ""),
        ("import", "imports: clap, std::{fmt}"), ("separator", ""), ("todo", "TODO: finish (line 5)")]

    def shouting(text, lines, ext):
        return F.transform(
            F.filter(lines, lambda s: s.rlike("^[A-Z]+$")),
            lambda s: F.struct(s.alias("content"), F.lit("loud").alias("style"), F.lit(None).cast("string").alias("symbol"), F.lit(0).alias("indent")),
        )

    md.register_extractor("shouting", shouting)
    loud = make_files({"a.c": "HELLO\nquiet\nBYE"})
    assert [r.content for r in md.extract_with(loud, "shouting").orderBy("seq").collect()] == ["HELLO", "BYE"]
    assert "shouting" in md.registered_extractors()
