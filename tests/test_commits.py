"""Batches that are stopped midway, readers between batches, files that change and go."""

from __future__ import annotations

import datetime as dt

import pytest

from srcatlas.schema import FILES
from srcatlas.streaming import commits, jobs


def numbers(df):
    return sorted(r.id for r in df.collect())


def test_readers_see_whole_batches(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "t")
    assert commits.read_last(spark, target) is None
    assert commits.commit(spark.range(3), target, 0)
    reader = commits.read_last(spark, target)
    # A batch that is stopped after its rows are written and before its commit.
    with monkeypatch.context() as m:
        m.setattr(commits.json, "dumps", lambda _: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError):
            commits.commit(spark.range(9), target, 1)
    assert numbers(commits.read_last(spark, target)) == [0, 1, 2] and len(list((tmp_path / "t" / "data").iterdir())) == 2
    assert commits.commit(spark.range(5), target, 1)
    assert numbers(reader) == [0, 1, 2] and numbers(commits.read_last(spark, target)) == [0, 1, 2, 3, 4]
    # Run again, a batch that is there changes nothing; leftovers and old batches go.
    assert not commits.commit(spark.range(7), target, 1)
    assert commits.commit(spark.range(1), target, 2)
    assert [c["batch"] for c in commits.committed(target)] == [1, 2] and len(list((tmp_path / "t" / "data").iterdir())) == 2


def test_batches_as_one_table(spark, tmp_path):
    target = str(tmp_path / "t")
    for batch in (0, 1, 1, 2):
        commits.commit(spark.range(batch * 10, batch * 10 + 2), target, batch, keep=None)
    assert numbers(commits.read_all(spark, target)) == [0, 1, 10, 11, 20, 21]


@pytest.fixture
def deliver(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = spark.createDataFrame([], FILES).schema.add("removed", "boolean")

    def run(*versions):
        rows = []
        for path, day, content in versions:
            data = None if content is None else content.encode()
            rows.append(("r", path, len(data or b""), dt.datetime(2024, 1, day), False, False, data, content is None))
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        jobs.start_file_counts(stream, target, target + "-cp", "ext").awaitTermination()
        return {r.ext: (r.files, r.lines) for r in jobs.latest_counts(spark, target).collect()}

    return run


def test_rewritten_and_removed_files(deliver):
    assert deliver(("a.rs", 1, "x\ny\n"), ("b.rs", 1, "x\n"), ("c.py", 1, "")) == {"rs": (2, 3), "py": (1, 0)}
    assert deliver(("a.rs", 2, "x\n")) == {"rs": (2, 2), "py": (1, 0)}
    # An older version, and the same one again, change nothing.
    assert deliver(("a.rs", 1, "1\n2\n3\n"), ("b.rs", 1, "x\n")) == {"rs": (2, 2), "py": (1, 0)}
    assert deliver(("c.py", 3, None), ("never.go", 3, None)) == {"rs": (2, 2)}
    assert deliver(("c.py", 4, "q"), ("b.rs", 4, "1\n2\n"), ("b.rs", 5, "1\n2\n3\n")) == {"rs": (2, 4), "py": (1, 1)}


def test_a_stopped_batch_is_applied_once(deliver, monkeypatch):
    assert deliver(("a.rs", 1, "x\n")) == {"rs": (1, 1)}
    whole = commits.commit

    def stopped_before(*args, **more):
        raise RuntimeError("stopped")

    def stopped_after(*args, **more):
        whole(*args, **more)
        raise RuntimeError("stopped")

    for day, stop, content in ((2, stopped_before, "x\ny\n"), (3, stopped_after, "x\ny\nz\n")):
        with monkeypatch.context() as m:
            m.setattr(commits, "commit", stop)
            with pytest.raises(Exception, match="stopped"):
                deliver(("a.rs", day, content), (f"b{day}.rs", day, "1\n"))
        assert deliver() == {"rs": (day, day + day - 1)}
