"""Many small files arriving in a folder: few tasks, bounded batches."""

from __future__ import annotations

import os

import pytest

from srcatlas.operators.todos import extract_todos
from srcatlas.sources import tables
from srcatlas.streaming import jobs


@pytest.fixture
def folder(tmp_path):
    source = tmp_path / "in"
    for i in range(200):
        (source / f"d{i % 3}").mkdir(parents=True, exist_ok=True)
        (source / f"d{i % 3}" / f"f{i}.rs").write_text(f"// TODO: t{i}\n")
    return str(source)


def extracted(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    query = jobs.start_extraction(jobs.stream_corpus(spark, folder, "r"), "todos", out, out + "-cp")
    query.awaitTermination()
    want = extract_todos(tables.read_binary_files(spark, folder, "r"))
    got = spark.read.parquet(out)
    assert got.count() == 200 and got.exceptAll(want).count() == 0
    return query, [name for name in os.listdir(out) if name.startswith("part-")]


def test_tasks_dont_grow_with_the_number_of_small_files(spark, folder, tmp_path):
    _, parts = extracted(spark, folder, tmp_path)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(parts) <= tasks
    assert int(spark.conf.get(jobs.LISTING_TASKS)) <= tasks


def test_batches_are_bounded(spark, folder, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "BATCH_FILES", 80)
    query, _ = extracted(spark, folder, tmp_path)
    assert [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]] == [80, 80, 40]
