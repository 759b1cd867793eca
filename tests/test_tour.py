"""Rollups by a walk against adding every file to all its ancestors."""

from __future__ import annotations

import random

import pytest

from srcatlas.operators import stats, tour


def brute(files, dirs=()):
    totals, known = {}, {"": set()}
    above = lambda p: ["/".join(p.split("/")[:i]) for i in range(len(p.split("/")))]
    every = {a for p in [*files, *dirs] for a in above(p)} | set(dirs)
    for d in every:
        totals[d] = [len({e for e in every if e != d and (d == "" or e.startswith(d + "/"))}), 0, 0]
    for path, size in files.items():
        for a in above(path):
            totals[a][1] += 1
            totals[a][2] += size
    return {k: tuple(v) for k, v in totals.items()}


@pytest.mark.parametrize("seed", range(3))
def test_random_trees(spark, make_files, seed):
    rng = random.Random(seed)
    parts = ["a", "b", "a-", "a.b", "é", "A"]
    want, rows = {}, []
    for repo in ("r1", "r2", "s"):
        files = {"/".join(rng.choice(parts) for _ in range(rng.randint(1, 6))) + ".f": "x" * rng.randint(0, 9) for _ in range(rng.randint(1, 80))}
        rows += [(repo, p, c) for p, c in files.items()]
        want[repo] = brute({p: len(c) for p, c in files.items()})
    found = stats.directory_rollup(make_files(rows).repartition(5)).collect()
    got = {}
    for r in found:
        got.setdefault(r.repo, {})[r.path] = (r.dirs, r.files, r.bytes)
    assert got == want and len(found) == sum(map(len, want.values()))


def test_listed_directories_and_root_only(make_files):
    found = stats.directory_rollup(make_files({"f": "abc"}, dirs=["x/y", ""])).collect()
    assert {r.path: (r.dirs, r.files, r.bytes) for r in found} == {"": (2, 1, 3), "x": (1, 0, 0), "x/y": (0, 0, 0)}


def test_a_deep_chain_costs_its_directories(spark, make_files):
    depth = 2000
    path = "/".join("d" for _ in range(depth))
    files = make_files([("r", path + "/f", "xy"), ("r", "d/d/g", "z")])
    walked = tour._walk(files.selectExpr("repo", "left(path, length(path) - 2) AS path", "size_bytes"), ["size_bytes"])
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert walked.count() <= (depth + 1) * partitions
    found = {len(r.path.split("/")) if r.path else 0: (r.dirs, r.files, r.bytes) for r in stats.directory_rollup(files).collect()}
    assert len(found) == depth + 1 and found[0] == (depth, 2, 3) and found[2] == (depth - 2, 2, 3) and found[3] == (depth - 3, 1, 2)
    plan = stats.directory_rollup(files)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
