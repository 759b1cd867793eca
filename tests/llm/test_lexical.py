"""Lexical search against scoring every document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import LOWER

from srcatlas.llm import lexical


def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def brute(docs, items, k):
    counted = [(key, Counter(terms(text))) for key, text in docs]
    counted = [(key, c, sum(c.values())) for key, c in counted if c]
    total, length = len(counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    wanted = {}
    for key, text in items:
        wanted.setdefault(key, set()).update(terms(text))
    out = []
    for item, own in wanted.items():
        scored = []
        for key, c, n in counted:
            m = 50 + (50 * n * total) // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if score > 0:
                scored.append((-score, key is None, key or 0, key))
        out += [(item, rank, row[3], -row[0]) for rank, row in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def searched(docs, items, k, **more):
    return sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.search(docs, items, k, **more).collect()], key=str)


@pytest.fixture
def make_items(spark):
    return lambda rows: spark.createDataFrame([(i, text, 1, 2) for i, text in rows], "item_id BIGINT, text STRING, item INT, score INT")


def random_rows(rng, n, vocabulary):
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    return [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 60)))) for i in range(n)]


@pytest.mark.parametrize(("seed", "k"), [(1, 3), (2, 50), (3, 7)])
def test_random_texts(make_docs, make_items, seed, k, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 40)
    rng = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(60)]
    docs, items = random_rows(rng, 700, vocabulary), random_rows(rng, 12, vocabulary)
    # Ties: equal texts under several keys, in several partitions.
    docs += [(1000 + i, docs[i % 5][1]) for i in range(120)]
    assert searched(make_docs(docs).repartition(3), make_items(items), k) == brute(docs, items, k)


def test_odd_rows(make_docs, make_items, odd_rows):
    items = [(1, "one ONE; two"), (1, "three"), (2, None), (3, " ..."), (None, "seven é w5x5"), (4, "nowhere"), (5, "a" * 50_000), (5, "a" * 50_000)]
    for docs in (odd_rows, [], [(1, None)]):
        assert searched(make_docs(docs), make_items(items), 4) == brute(docs, items, 4)
    assert searched(make_docs(odd_rows), make_items([]), 4) == []


def test_text_keys(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), (None, "x y"), ("c", "z")], "doc_id STRING, text STRING")
    items = spark.createDataFrame([("q", "x")], "item_id STRING, text STRING")
    assert [(r["rank"], r.doc_id) for r in lexical.search(docs, items).orderBy("rank").collect()] == [(1, "a"), (2, "b"), (3, None)]


def segment_of(rng, plan, lists):
    import pyarrow as pa

    rows = pa.table(
        {
            "id": pa.array(range(len(lists)), pa.int64()),
            "n": pa.array([sum(c.values()) for c in lists], pa.int64()),
            "terms": pa.array([sorted(c) for c in lists], pa.list_(pa.int32())),
            "counts": pa.array([[c[t] for t in sorted(c)] for c in lists], pa.list_(pa.int32())),
        }
    )
    partners = {}
    for (a, b), number in plan.number.items():
        partners.setdefault(a, []).append((b, number))
    batch = lexical._segment(rows, plan, partners, ["ids", *lexical._BLOBS])
    return lexical.Segment([batch.column(c)[0].as_py() for c in range(1, 8)], plan)


def test_pair_bounds_hold_and_are_tighter():
    rng = random.Random(5)
    # Terms 0 and 1 exclude each other, so that their pair's bound is less than the sum of theirs.
    lists = [Counter(rng.choices([rng.choice([0, 1]), 2, 3, 4, 5], k=12)) for _ in range(600)]
    frequency = dict(Counter(t for c in lists for t in c))
    items = lexical.Items(["q"], [[0, 1, 2, 3, 4, 5]], [b"t%d" % i for i in range(6)])
    plan = lexical.Plan(items, 5000, 60_000, frequency, 10)
    segment = segment_of(rng, plan, lists)
    own, pairs = plan.terms[0], plan.pairs[0]
    bound = segment.bound(segment.row[own], pairs)
    single = np.cumsum(segment.greatest[segment.row[own]], axis=0)
    assert (bound[1:] <= single).all() and (bound[-1] < single[-1]).any()
    places, scores = segment.search(own, pairs, 1)
    for j in range(len(own) + 1):
        part = np.zeros(lexical.SEGMENT, np.int64)
        for t in own[:j]:
            a, b = segment.bounds[segment.row[t]]
            part[segment.place[a:b]] += segment.impact[a:b]
        assert (part.reshape(lexical.CHUNKS, -1).max(axis=1) <= bound[j]).all()
    for least in np.unique(scores)[:: max(1, len(scores) // 40)].tolist():
        some, found = segment.search(own, pairs, least)
        assert sorted(zip(some.tolist(), found.tolist(), strict=True)) == sorted((p, s) for p, s in zip(places.tolist(), scores.tolist(), strict=True) if s >= least)
