"""Arriving files that the executors list and read: the same rows as by Spark's file source, and nothing of a file on the driver."""

from __future__ import annotations

import json
import os

import pytest

from srcatlas.streaming import jobs


def put(folder, path, text, at=None):
    file = folder / path
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(text)
    if at is not None:
        os.utime(file, (at, at))


@pytest.fixture
def arrive(spark, tmp_path):
    """Read the folder ``in`` as a stream into a table; the table and the rows of each batch."""

    def run(name, **more):
        out = str(tmp_path / f"out-{name}")
        files = jobs.stream_corpus(spark, str(tmp_path / "in"), "r", **more)
        query = files.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-cp").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(files.schema).parquet(out), [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]

    return run


def test_same_rows_as_the_file_source(arrive, tmp_path):
    folder = tmp_path / "in"
    for path in ("a.rs", "d/b c.rs", "d/e/ü%20+.py", "d/k=1/x.rs", "_k=1/x.rs", ".hidden", "_under", ".dot/x.rs", "d/_u/x.rs", "d/x._COPYING_", "_metadata"):
        put(folder, path, f"// TODO: {path}\n")
    put(folder, "empty.rs", "")
    put(tmp_path / "other", "l.rs", "linked\n")
    (folder / "file.rs").symlink_to(tmp_path / "other" / "l.rs")
    (folder / "folder").symlink_to(tmp_path / "other")
    (folder / "nowhere").symlink_to(tmp_path / "gone")
    want, _ = arrive("spark")
    got, _ = arrive("log", log=str(tmp_path / "log"))
    assert got.schema.simpleString() == want.schema.simpleString()
    assert {r.path for r in got.collect()} >= {"a.rs", "d/b c.rs", "d/e/ü%20+.py", "d/k=1/x.rs", "file.rs", "folder/l.rs"}
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_oldest_first_in_bounded_batches_and_once_each(arrive, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "BATCH_FILES", 30)
    folder, log = tmp_path / "in", str(tmp_path / "log")
    for i in range(70):
        put(folder, f"d{i % 4}/f{i:02d}.rs", f"{i}\n", at=1_700_000_000 + (i * 37) % 70)
    got, batches = arrive("a", log=log)
    assert batches == [30, 30, 10] and got.count() == 70
    parts = sorted(p for p in os.listdir(log) if p.endswith(".parquet"))
    times = [[r.mtime for r in got.sparkSession.read.parquet(f"{log}/{p}").collect()] for p in parts]
    assert [len(t) for t in times] == [30, 30, 10] and all(max(a) <= min(b) for a, b in zip(times, times[1:], strict=False))
    # Started again: new files only, also one that is older than all; a changed file doesn't come again, one that is gone is left out.
    put(folder, "late.rs", "late\n", at=1_600_000_000)
    put(folder, "d0/f00.rs", "changed\n")
    (folder / "d1" / "f01.rs").unlink()
    got, batches = arrive("a", log=log)
    assert batches == [1] and got.count() == 71
    assert got.where("path = 'd0/f00.rs'").first().content == b"0\n"
    assert arrive("a", log=log)[1] == []


def test_a_file_that_goes_before_it_is_read(spark, arrive, tmp_path, monkeypatch):
    put(tmp_path / "in", "a.rs", "a\n")
    put(tmp_path / "in", "b.rs", "b\n")
    look = jobs.listings.log_listing

    def then_gone(*args):
        look(*args)
        (tmp_path / "in" / "a.rs").unlink()

    monkeypatch.setattr(jobs.listings, "log_listing", then_gone)
    assert [r.path for r in arrive("a", log=str(tmp_path / "log"))[0].collect()] == ["b.rs"]


def test_a_folder_that_cant_be_listed(arrive, tmp_path):
    with pytest.raises(Exception, match="can't be listed"):
        arrive("a", log=str(tmp_path / "log"))


def test_no_name_of_a_file_in_what_the_driver_remembers(arrive, tmp_path):
    """Spark's file source logs each file's name for the driver; the log of parts has the parts only."""
    for i in range(50):
        put(tmp_path / "in", f"f{i}.rs", "x\n")
    arrive("a", log=str(tmp_path / "log"))
    seen = [f for f in (tmp_path / "out-a-cp" / "sources" / "0").iterdir() if not f.name.startswith(".")]
    entries = [json.loads(line)["path"] for f in seen for line in f.read_text().splitlines()[1:]]
    assert len(entries) == 1 and entries[0].endswith(".parquet")
