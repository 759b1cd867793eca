"""Ignore rules of random repositories against git's own verdicts."""

from __future__ import annotations

import random
import shutil
import subprocess

import pytest

from srcatlas.operators import ignore

pytestmark = pytest.mark.skipif(shutil.which("git") is None, reason="git is not there")

NAMES = ["a", "b", "ab", "b1", "a.c", "b.c", "x.log", "y.tar.gz", "t~", "[x]", "B", "a b"]
PIECES = ["a", "b", "1", ".", "*", "?", "[ab]", "[!a]", "[^b]", "[a-c]", "[[:alpha:]]", "[![:digit:].]", "\\a", "c"]


def random_pattern(rng):
    def component():
        roll = rng.random()
        if roll < 0.45:
            return rng.choice(NAMES)
        if roll < 0.6:
            return "*" + rng.choice([".c", ".log", ".gz", ".tar.gz", "~", "b", ""])
        if roll < 0.7:
            return "**"
        return "".join(rng.choice(PIECES) for _ in range(rng.randint(1, 3)))

    text = "/".join(component() for _ in range(rng.choice([1, 1, 1, 2, 2, 3])))
    return ("!" if rng.random() < 0.25 else "") + ("/" if rng.random() < 0.2 else "") + text + ("/" if rng.random() < 0.15 else "")


def random_repository(rng):
    files = {}
    for _ in range(rng.randint(6, 25)):
        path = "/".join(rng.choice(NAMES) for _ in range(rng.randint(1, 4)))
        taken = any(p == path or p.startswith(path + "/") or path.startswith(p + "/") for p in files)
        if not taken:
            files[path] = "x"
    dirs = {""} | {p.rsplit("/", 1)[0] + "/" for p in files if "/" in p}
    for base in rng.sample(sorted(dirs), min(len(dirs), rng.randint(1, 3))):
        files[base + ".gitignore"] = "\n".join(random_pattern(rng) for _ in range(rng.randint(1, 6))) + "\n"
    if rng.random() < 0.4:
        files[".git/info/exclude"] = "\n".join(random_pattern(rng) for _ in range(rng.randint(1, 4))) + "\n"
    return files


def git_keeps(folder, files):
    run = lambda *args: subprocess.run(["git", "-c", "core.excludesFile=", *args], cwd=folder, check=True, capture_output=True).stdout
    folder.mkdir()
    run("init", "-q")
    for path, text in files.items():
        target = folder / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)
    return {p for p in run("ls-files", "-o", "-z", "--exclude-standard").decode().split("\0") if p}


def test_random_repositories(make_files, tmp_path):
    rng = random.Random(11)
    repositories = [random_repository(rng) for _ in range(200)]
    want = [git_keeps(tmp_path / f"r{i}", files) for i, files in enumerate(repositories)]
    files = make_files([(f"r{i}", p, c) for i, entries in enumerate(repositories) for p, c in entries.items()])
    got = {}
    for row in ignore.included_entries(files, ignore.read_ignore_rules(files)).where("NOT is_dir").collect():
        if not row.path.startswith(".git/"):
            got.setdefault(row.repo, set()).add(row.path)
    differing = {i: (repositories[i], sorted(got.get(f"r{i}", set()) ^ want[i])) for i in range(200) if got.get(f"r{i}", set()) != want[i]}
    assert not differing


def test_sets_are_shared_and_no_row_of_a_directory_carries_rules(make_files):
    shared = "\n".join(f"name{i}" for i in range(50)) + "\n*.log\n/top/*.c\n"
    files = make_files([(f"r{i}", p, c) for i in range(30) for p, c in {".gitignore": shared, "d/e/f": "", "d/g.log": ""}.items()])
    scopes, sets = ignore.rule_sets(ignore.read_ignore_rules(files))
    assert scopes.count() == 30 and sets.count() == 1
    state = ignore.directory_sets(ignore.directories(files, with_root=True), scopes)
    assert {f.dataType.simpleString() for f in state.schema.fields} == {"string", "binary"}
