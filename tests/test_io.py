"""Sources, sinks and streams on scratch folders."""

from __future__ import annotations

import json
import os

import pytest
from report_helpers import report_text
from pyspark.sql import functions as F

from srcatlas import session
from srcatlas.operators import metadata as md, reports, stats, tree
from srcatlas.operators.todos import extract_todos
from srcatlas.schema import FILES, require_columns
from srcatlas.session import shared_folder
from srcatlas.sinks import writers
from srcatlas.sources import dirscan, tables
from srcatlas.streaming import jobs


@pytest.fixture()
def folder(tmp_path):
    for name, data in {
        "main.rs": "//! Main\n// TODO: one\n", "pkg/__init__.py": '"""Init."""\n', "pkg/.hidden.py": "x = 1\n", ".gitignore": "*.log\n",
        ".hid/a.rs": "//! Hidden\n", ".git/config": "no", "a.log": "log", "deep/er/est/z.go": "// Pkg\npackage z\n", "sp ace 日本.rs": "// TODO: two\n",
        "skip/me.rs": "x",
    }.items():
        path = tmp_path / "root" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(data)
    (tmp_path / "root" / "big.rs").write_text("//! Big\n" + "x" * 5000)
    (tmp_path / "root" / "void").mkdir()
    os.symlink(tmp_path / "root" / "main.rs", tmp_path / "root" / "link.rs")
    os.symlink(tmp_path / "root", tmp_path / "root" / "loop")
    os.symlink("/nowhere", tmp_path / "root" / "broken")
    return tmp_path / "root"


def test_directory_scan(spark, folder):
    roots = spark.createDataFrame([("r", str(folder))], "repo string, root string")
    files = dirscan.scan_dirs(roots, ignore_names=["skip"], max_file_size=4000)
    require_columns(files, FILES)
    rows = {r.path: r for r in files.collect()}
    assert set(rows) == {
        "main.rs", "pkg", "pkg/__init__.py", "pkg/.hidden.py", ".gitignore", ".hid", ".hid/a.rs", "a.log", "deep", "deep/er",
        "deep/er/est", "deep/er/est/z.go", "sp ace 日本.rs", "big.rs", "void", "link.rs", "loop", "broken"}
    assert rows["big.rs"].content is None and rows["big.rs"].size_bytes == 5008
    assert bytes(rows["pkg/__init__.py"].content) == b'"""Init."""\n'
    assert rows["loop"].is_symlink and not rows["loop"].is_dir and rows["void"].is_dir
    seconds = files.where("path = 'main.rs'").select(F.unix_micros("mtime").alias("us")).first().us
    assert seconds == (folder / "main.rs").stat().st_mtime_ns // 1000
    shown = {r.path for r in tree.list_nodes(files).collect()}
    assert not shown & {"link.rs", "loop", "broken"}
    assert {r.text for r in extract_todos(files).collect()} == {"one", "two"}


def test_corpus_round_trip_and_report_sink(spark, make_files, tmp_path):
    files = make_files([(f"r{i % 2}", f"d{i % 7}/f{i}.rs", f"//! Doc {i}\n// TODO: t{i}\n") for i in range(200)])
    writers.write_table(files, str(tmp_path / "corpus"))
    back = tables.read_corpus(spark, str(tmp_path / "corpus"))
    assert back.exceptAll(files).count() == 0 and back.count() == 200
    with pytest.raises(ValueError):
        tables.read_corpus(spark, str(tmp_path / "corpus")).drop("path").transform(lambda d: require_columns(d, FILES))
    writers.write_table(extract_todos(back), str(tmp_path / "todos"), by_repo=True)
    assert spark.read.parquet(str(tmp_path / "todos")).count() == 200

    nodes = tree.list_nodes(back)
    found = md.file_sections(back, md.Sections(True, True, True, True))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for name, rows in {
            "txt": reports.text_report(nodes, md.with_section_lines(found)),
            "json": reports.json_tree(nodes, found),
        }.items():
            writers.write_report(rows, str(tmp_path / name))
            for repo in ("r0", "r1"):
                parts = sorted((tmp_path / name / f"repo={repo}").glob("part-*"))
                text = "".join(p.read_text() for p in parts).rstrip("\n")
                assert text == report_text(rows, repo)
                if name == "json":
                    doc = json.loads(text.replace("\n", ""))
                    assert sum(len(d["children"]) for d in doc["children"]) == 100
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    writers.write_json_records(reports.json_records(nodes, found), str(tmp_path / "records"))
    assert spark.read.json(str(tmp_path / "records")).where("comment is not null").count() == 200


def test_tracked_source(spark, tmp_path):
    (tmp_path / "tracked.csv").write_text("r,a.rs\nr,b/c.rs\n")
    got = tables.read_tracked(spark, str(tmp_path / "tracked.csv"), "csv")
    assert {(r.repo, r.path) for r in got.collect()} == {("r", "a.rs"), ("r", "b/c.rs")}


def test_streaming_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    (src / "sub").mkdir(parents=True)
    for i in range(6):
        (src / "sub" / f"f{i}.rs").write_text(f"//! Doc {i}\nuse std::fmt;\npub fn f{i}() {{}}\n// TODO: t{i}\n")
    batch = tables.read_binary_files(spark, str(src), "r")
    assert {r.path for r in batch.collect()} == {f"sub/f{i}.rs" for i in range(6)}
    for kind, extract in jobs.EXTRACTORS.items():
        out = str(tmp_path / kind)
        stream = jobs.stream_corpus(spark, str(src), "r")
        jobs.start_extraction(stream, kind, out, out + "-cp").awaitTermination()
        assert spark.read.parquet(out).exceptAll(extract(batch)).count() == 0
        assert spark.read.parquet(out).count() == extract(batch).count() > 0

    out, cp = str(tmp_path / "counts"), str(tmp_path / "counts-cp")
    jobs.start_counts(jobs.stream_corpus(spark, str(src), "r"), out, cp, "ext").awaitTermination()
    for late in ("late.rs", "later.py"):
        (src / late).write_text("//! late\n")
        jobs.start_counts(jobs.stream_corpus(spark, str(src), "r"), out, cp, "ext").awaitTermination()
    latest = jobs.latest_counts(spark, out)
    want = stats.extension_counts(tables.read_binary_files(spark, str(src), "r"))
    assert sorted(map(tuple, latest.collect())) == sorted(map(tuple, want.collect()))
    assert len(os.listdir(out + "/data")) == 2


def test_incremental_sink(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.rs").write_text("// TODO: x\n")
    seen = []
    stream = extract_todos(jobs.stream_corpus(spark, str(src), "r"))
    writers.write_incrementally(stream, lambda df, i: seen.extend(r.text for r in df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert seen == ["x"]


def test_shared_folder_comes_from_the_session(spark, monkeypatch):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    # Next comes the folder of the context; a local session without either gets its own.
    monkeypatch.setattr(session, "CHECKPOINT_SETTING", "spark.srcatlas.unsetForTest")
    assert shared_folder(spark) == spark.sparkContext.getCheckpointDir()
    monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda self: None)
    own = shared_folder(spark)
    assert own == shared_folder(spark) != spark.conf.get("spark.checkpoint.dir") and os.path.isdir(own)
    assert session.materialize(spark.range(3), "own").count() == 3


def test_scan_of_addresses_and_errors(spark, folder):
    import pandas as pd

    roots = spark.createDataFrame([("r", folder.as_uri())], "repo string, root string")
    found = {r.path: r for r in dirscan.scan_with_errors(roots).collect()}
    assert bytes(found["main.rs"].content) == b"//! Main\n// TODO: one\n" and found["link.rs"].is_symlink
    assert {r.error for r in found.values()} == {None}
    missing = spark.createDataFrame([("r", str(folder / "nowhere"))], "repo string, root string")
    with pytest.raises(Exception, match="can't be listed"):
        dirscan.list_entries(missing).count()
    gone = pd.DataFrame({"repo": ["r"], "root": [str(folder)], "path": ["lost"], "size_bytes": [1]})
    listed = next(dirscan._list_directories(iter([gone])))
    assert listed["path"].tolist() == ["lost"] and "lost" in listed["error"][0] and listed["is_dir"][0] is None
    read = next(dirscan._read_contents(iter([gone])))
    assert read["content"].tolist() == [None] and "lost" in read["error"].iloc[0]


def test_written_files_are_found_again(spark, make_files, tmp_path):
    files = make_files([("a", "x/y.rs", "//! One\n"), ("b", "z 日本.py", b"\xff\n"), ("b", "empty", "")])
    assert writers.write_files(files, str(tmp_path / "out")) == 3
    roots = spark.createDataFrame([(r, str(tmp_path / "out" / r)) for r in "ab"], "repo string, root string")
    back = {(r.repo, r.path): bytes(r.content) for r in dirscan.scan_dirs(roots).where("not is_dir").collect()}
    assert back == {("a", "x/y.rs"): b"//! One\n", ("b", "z 日本.py"): b"\xff\n", ("b", "empty"): b""}
