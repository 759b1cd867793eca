"""Counts of files that change: many files share a group of the state."""

from __future__ import annotations

import datetime as dt

import pytest

from srcatlas.schema import FILES
from srcatlas.streaming import jobs


@pytest.fixture
def deliver(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "STATE_GROUPS", 5)
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = spark.createDataFrame([], FILES).schema.add("removed", "boolean")

    def run(*versions):
        rows = []
        for repo, path, day, content in versions:
            data = None if content is None else content.encode()
            rows.append((repo, path, len(data or b""), dt.datetime(2024, 1, day), False, False, data, content is None))
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        query = jobs.start_file_counts(spark.readStream.schema(schema).parquet(source), target, target + "-cp", "ext")
        query.awaitTermination()
        groups = query.lastProgress["stateOperators"][0]["numRowsTotal"]
        return groups, {(r.repo, r.ext): (r.files, r.lines) for r in jobs.latest_counts(spark, target).collect()}

    return run


def test_files_share_groups_of_the_state(deliver):
    names = [(f"r{i % 2}", f"d{i % 7}/f{i}.{'rs' if i % 3 else 'py'}") for i in range(120)]
    now = {}

    def counts():
        out = {}
        for (repo, path), lines in now.items():
            key = (repo, path.rpartition(".")[2])
            out[key] = (out.get(key, (0, 0))[0] + 1, out.get(key, (0, 0))[1] + lines)
        return out

    now |= dict.fromkeys(names, 1)
    groups, found = deliver(*[(*n, 1, "x\n") for n in names])
    assert groups <= 5 and found == counts()
    # Some change, some go, some come back later, an older version of one is passed over.
    now |= dict.fromkeys(names[:40], 3)
    assert deliver(*[(*n, 2, "1\n2\n3\n") for n in names[:40]], (*names[50], 1, "1\n2\n"))[1] == counts()
    for n in names[20:60]:
        del now[n]
    assert deliver(*[(*n, 3, None) for n in names[20:60]])[1] == counts()
    now[names[25]] = 2
    groups, found = deliver((*names[25], 4, "1\n2\n"), (*names[26], 2, "1\n"))
    assert groups <= 5 and found == counts()


def test_names_that_are_null(deliver):
    assert deliver((None, "a.rs", 1, "x\n"), ("r", None, 1, "x\ny\n"), ("r", "a.rs", 1, "x\n"))[1] == {
        (None, "rs"): (1, 1), ("r", None): (1, 2), ("r", "rs"): (1, 1)
    }
    assert deliver((None, "a.rs", 2, "1\n2\n3\n"), ("r", None, 2, None), ("r", None, 1, "x\n"))[1] == {(None, "rs"): (1, 3), ("r", "rs"): (1, 1)}
