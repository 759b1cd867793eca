"""Printed index and status listings against what the version control itself says."""

from __future__ import annotations

import shutil
import subprocess

import pytest

from srcatlas.functions.quoting import quoted, unquoted
from srcatlas.operators import ignore
from srcatlas.sources import printed

ODD = [
    "plain.rs", "sp ace.rs", 'quo"te.py', "tab\there.c", "new\nline.c", "back\\slash", "日本/ü.go", "bell\a\b\v\f\r", "a -> b", "R  looks.rs",
    "\x7f\x01", "'single'", "octal\\303", "é", "x/y/z.rs", '"', "\\",
]


def git(root, *args):
    done = subprocess.run(
        ["git", "-c", "user.name=t", "-c", "user.email=t@t", *args], cwd=root, check=True, capture_output=True,
    )
    return done.stdout


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    if shutil.which("git") is None:
        pytest.skip("git is not there")
    root = tmp_path_factory.mktemp("printed") / "work"
    root.mkdir()
    git(root, "init", "-q")
    for name in [*ODD, *[f"old {i}" for i in range(6)], "R  old", ".gitignore"]:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("*.log\n" if name == ".gitignore" else f"{name!r}\n" * 20)
    git(root, "add", "-A")
    git(root, "commit", "-q", "-m", "one")
    for i in range(6):
        git(root, "mv", f"old {i}", f"neu\t{i}é")
    git(root, "mv", "R  old", "R  new")
    git(root, "rm", "-q", "--cached", "plain.rs")
    (root / "é").write_text("changed")
    (root / "fresh one").write_text("x")
    (root / "seen.log").write_text("x")
    return root


def listing(root, name, *args):
    folder = root.parent / name / "repo=007"
    folder.mkdir(parents=True)
    (folder / "list.txt").write_bytes(git(root, *args))
    return str(folder.parent)


def bytes_of(names):
    return sorted(n.encode() for n in names)


def test_index(spark, repository):
    want = [n for n in git(repository, "ls-files", "-z").decode().split("\0") if n]
    for name, args, how in (
        ("lines", ["ls-files"], {}), ("nul", ["ls-files", "-z"], {"nul": True}),
        ("staged", ["ls-files", "-s"], {"staged": True}), ("staged-nul", ["ls-files", "-s", "-z"], {"staged": True, "nul": True}),
        ("bytes", ["-c", "core.quotePath=false", "ls-files"], {}),
    ):
        rows = printed.read_printed_index(spark, listing(repository, name, *args), **how).collect()
        assert {r.repo for r in rows} == {"007"}
        assert bytes_of(r.path for r in rows) == bytes_of(want), name


def test_status(spark, repository):
    """Lines, NULs and a listing without renames name the same paths."""
    status = ["status", "--porcelain", "--ignored", "-uall"]
    tables = {}
    for name, args, how in (
        ("s-lines", status, {}), ("s-branch", [*status, "-b"], {}), ("s-nul", [*status, "-z"], {"nul": True}),
        ("s-branch-nul", [*status, "-b", "-z"], {"nul": True}), ("s-plain", [*status, "-z", "--no-renames"], {"nul": True}),
    ):
        text = listing(repository, name, *args)
        tables[name] = {tuple(r) for r in printed.read_printed_status(spark, text, **how).collect()}
    assert len(set(map(frozenset, tables.values()))) == 1, tables
    found = tables["s-lines"]
    assert {p for _, p, new, _ in found if new} == {"fresh one", "plain.rs"}
    assert ("007", "seen.log", False, True) in found and ("007", "old 3", False, False) in found
    assert ("007", "neu\t3é", False, False) in found and ("007", "R  old", False, False) in found


def test_tracked_from_text(spark, repository):
    index = printed.read_printed_index(spark, listing(repository, "t-index", "ls-files"))
    status = printed.read_printed_status(spark, listing(repository, "t-status", "status", "--porcelain", "--ignored"))
    tracked = {r.path for r in ignore.tracked_paths(index, status).collect()}
    assert "fresh one" not in tracked and "seen.log" not in tracked
    assert {"old 2", "neu\t2é", "sp ace.rs", "日本/ü.go"} <= tracked


def test_names_come_back(spark):
    names = [*ODD, "", "a" * 5000 + "é", "\\t", '"quoted"', "𝒳", None]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    back = df.select("name", unquoted(quoted(df.name)).alias("a"), unquoted(quoted(df.name, spaces=True)).alias("b")).collect()
    assert all(r.name == r.a == r.b for r in back)
    shown = {r[0]: r[1] for r in df.select("name", quoted(df.name)).collect()}
    assert shown["é"] == '"\\303\\251"' and shown["bell\a\b\v\f\r"] == '"bell\\a\\b\\v\\f\\r"' and shown["sp ace.rs"] == "sp ace.rs"
    broken = spark.createDataFrame([('"a\\377b"',)], "name string")
    assert broken.select(unquoted(broken.name)).first()[0] == "a�b"


@pytest.mark.parametrize("count", [1, 2, 3, 7, 24])
def test_runs_of_records_that_look_like_renames(spark, tmp_path, monkeypatch, count):
    """Old names that look like renames, in a listing cut into many splits and parts."""
    monkeypatch.setattr(printed, "RUN_PART", 4)
    records, want = [], []
    for i in range(count):
        records += [f"R  new {i}", f"R  old {i}"]
        want += [(f"new {i}", False), (f"R  old {i}", False)]
        if i % 5 == 4:
            records += [f"?? R  {i}"]
            want += [(f"R  {i}", True)]
    (tmp_path / "a.txt").write_text("\0".join(records[: count]) + "\0")
    (tmp_path / "b.txt").write_text("\0".join(records[count:]) + "\0")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        rows = printed.read_printed_status(spark, str(tmp_path), "r", nul=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.path, r.is_new) for r in rows) == sorted(want)


def test_empty_listings(spark, tmp_path):
    (tmp_path / "empty.txt").write_bytes(b"")
    for nul in (False, True):
        assert printed.read_printed_index(spark, str(tmp_path), "r", nul=nul).count() == 0
        assert printed.read_printed_status(spark, str(tmp_path), "r", nul=nul).count() == 0
