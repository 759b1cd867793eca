from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from srcatlas.llm import neighbours, queries


def brute(rows, every, k=5):
    good = [(i, np.array(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = set()
    for q in sorted({i for i, _ in good if i % every == 0}):
        own = next(v for i, v in good if i == q)
        found = [
            (-neighbours.cosines(own[None], v[None])[0], i) for i, v in good if i != q and len(v) == len(own)
        ]
        out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(found)[:k], 1)}
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id BIGINT, embedding ARRAY<DOUBLE>, id STRING, rank INT")


@pytest.mark.parametrize("block", [64, 10**6])
def test_random_vectors_with_copies(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "BLOCK_NUMBERS", block)
    monkeypatch.setattr(neighbours, "QUERY_BLOCKS", 3)
    monkeypatch.setattr(neighbours, "ROW_BLOCKS", 2)
    monkeypatch.setattr(neighbours, "TILE_ROWS", 50)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(1000 + i, base[10].tolist()) for i in range(90)]  # a third are copies
    rows += [(2000 + i, (base[20] * (i + 1) + rng.normal(size=16) * 1e-7).tolist()) for i in range(20)]
    found = neighbours.nearest(table(spark, rows).repartition(6), F.col("vec_id") % 10 == 0)
    assert {tuple(r) for r in found.collect()} == brute(rows, 10)


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, []), (None, [1.0, 1.0]),
        (7, [1.0, 1.0, 1.0]), (10, [1.0, 1.0, 0.0]), (8, [None, 1.0]), (9, [1e200, 1e200]), (20, [0.0, 0.0]), (30, None),
    ]
    got = {tuple(r) for r in neighbours.nearest(table(spark, rows), F.col("vec_id") % 10 == 0).collect()}
    assert {(q, n) for q, _, n, _ in got} == {(0, 1), (0, 9), (10, 7)}
    assert neighbours.nearest(table(spark, []), F.col("vec_id") % 10 == 0).count() == 0


def test_repeated_rows(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.1]), (1, [1.0, 0.1])]
    got = sorted(tuple(r)[:3] for r in neighbours.nearest(table(spark, rows), F.col("vec_id") == 0).collect())
    assert got == [(0, 1, 1), (0, 2, 1)]


@pytest.mark.parametrize("times", [2, 3, 9])
def test_repeated_rows_among_many_copies(spark, times):
    rng = np.random.default_rng(times)
    shared, near = rng.normal(size=8), rng.normal(size=(40, 8))
    rows = [(i, shared.tolist()) for i in range(50, 61)] + [(100 + i, v.tolist()) for i, v in enumerate(near)]
    rows += [(200, (shared + 1e-3).tolist())]
    rows *= times
    found = neighbours.nearest(table(spark, rows).coalesce(1), F.col("vec_id") % 10 == 0)
    assert {tuple(r) for r in found.collect()} == brute(rows, 10)


def test_query_finds_the_nearest(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = brute(rows, 50)
    got = {tuple(r) for r in queries.op2_nearest(spark, sf_dir).collect()}
    assert {r[:3] for r in got} == {r[:3] for r in want}
    assert got == want


def test_tiles_are_bounded_on_both_sides(monkeypatch):
    rng = np.random.default_rng(7)
    matrix = rng.normal(size=(5000, 4))
    keys, seen, product = np.arange(5000), [], neighbours.Rounded.product

    def noted(self, other):
        out = product(self, other)
        seen.append(out[0].shape)
        return out

    monkeypatch.setattr(neighbours.Rounded, "product", noted)
    best = neighbours.Best(keys, matrix, 3)
    best.add(keys[:3000], matrix[:3000])
    best.add(keys[3000:], matrix[3000:])
    assert sum(a * b for a, b in seen) == 5000 * 5000 and max(a for a, _ in seen) <= 2000 and max(b for _, b in seen) <= 2048
    for i in (0, 1999, 2000, 3999, 4000, 4999):
        scores = neighbours.cosines(np.repeat(matrix[i : i + 1], 5000, axis=0), matrix)
        want = sorted(((s, -k) for k, s in enumerate(scores.tolist()) if k != i), reverse=True)[:3]
        assert sorted(best.heaps[i], reverse=True) == want


def test_blocks_are_joined_by_tasks(spark, monkeypatch):
    """Several cells each way and lengths of vectors; no rows come to the driver."""
    monkeypatch.setattr(neighbours, "BLOCK_NUMBERS", 96)
    monkeypatch.setattr(neighbours, "QUERY_BLOCKS", 2)
    monkeypatch.setattr(neighbours, "ROW_BLOCKS", 1)
    monkeypatch.setattr(neighbours, "TILE_ROWS", 40)
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=(6, 8, 16)[i % 3]).tolist()) for i in range(500)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]

    def refused(*_):
        raise AssertionError("rows to the driver")

    for name in ("collect", "toLocalIterator", "toPandas", "toArrow"):
        monkeypatch.setattr(type(spark.range(1)), name, refused)
    frame = table(spark, rows[:1]).union(table(spark, rows[1:])).repartition(5)
    found = neighbours.nearest(frame, F.col("vec_id") % 7 == 0)
    monkeypatch.undo()
    assert {tuple(r) for r in found.collect()} == brute(rows, 7)
    plan = found._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_bounds_hold():
    rng = np.random.default_rng(0)
    for scale in (1.0, 1e-150, 1e150):
        a, b = rng.normal(size=(40, 33)) * scale, rng.normal(size=(50, 33))
        cosine, off = neighbours.Rounded(a).product(neighbours.Rounded(b))
        true = (a / np.linalg.norm(a / scale, axis=1)[:, None] / scale) @ (b / np.linalg.norm(b, axis=1)[:, None]).T
        assert (np.abs(cosine - true) <= off).all()
