"""Exact dedup and counting quotient filters against plain counting."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from srcatlas.llm import exact, quotient


def plain(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


def brute(rows):
    groups = {}
    for key, text in rows:
        groups.setdefault(plain(text), []).append((-len(text or ""), key is None, key or 0, key))
    out = []
    for key, text in rows:
        own = sorted(groups[plain(text)], key=lambda r: r[:3])
        out.append((key, own[0][3], len(own), hashlib.sha256(plain(text).encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.digest.hex()) for r in df.collect()], key=str)


def one_kept_each(df):
    kept = Counter((r.digest, r.keep_id) for r in df.collect() if r.kept)
    return set(kept.values()) <= {1} and len(kept) == len({(r.digest, r.keep_id) for r in df.collect()})


@pytest.fixture
def rows(odd_rows):
    rng = random.Random(3)
    made = [(100 + i, " ".join(rng.choice(["a", "b ", "\tc", "é"]) for _ in range(rng.randint(0, 4)))) for i in range(400)]
    return [*odd_rows, *made, (None, "a b"), (None, "a b"), (6, "One two THREE four five six  seven")]


def test_rows(make_docs, rows):
    df = exact.deduplicate(make_docs(rows).repartition(3))
    assert found(df) == brute(rows) and one_kept_each(df)
    kept = {r.doc_id for r in df.collect() if r.kept}
    assert 1 not in kept and 3 in kept


@pytest.mark.parametrize("bits", [1, 6, 13, 40])
def test_short_fingerprints(make_docs, rows, bits):
    df = exact.deduplicate(make_docs(rows), bits=bits)
    assert found(df) == brute(rows) and one_kept_each(df)


def test_texts_decide_where_digests_are_equal(make_docs, rows):
    df = exact.deduplicate(make_docs(rows), bits=4, digest=lambda data: bytes([len(data) % 2]))
    assert sorted([x[:3] for x in found(df)], key=str) == sorted([x[:3] for x in brute(rows)], key=str)
    assert sum(r.kept for r in df.collect()) == len({plain(t) for _, t in rows})


def test_empty_and_text_keys(spark, make_docs):
    assert exact.deduplicate(make_docs([])).collect() == []
    docs = spark.createDataFrame([("b", "x"), ("a", "x"), ("c", "x ")], "doc_id STRING, text STRING")
    assert {(r.doc_id, r.keep_id, r.kept) for r in exact.deduplicate(docs).collect()} == {("b", "c", False), ("a", "c", False), ("c", "c", True)}


@pytest.mark.parametrize(("bits", "slots"), [(64, 64), (64, 1 << 16), (20, 64), (9, 16)])
def test_filter_is_lossless(spark, monkeypatch, bits, slots):
    monkeypatch.setattr(quotient, "BLOCK_SLOTS", slots)
    monkeypatch.setattr(quotient, "GATHERED", 500)
    rng = random.Random(bits)
    values = [rng.getrandbits(bits) for _ in range(1500)]
    values += [values[0]] * 700 + rng.choices(values, k=300) + [0, (1 << bits) - 1]
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    table = spark.createDataFrame([(v,) for v in signed], "fp BIGINT").repartition(5)
    blocks = quotient.build(table, "fp", len(values), bits)
    got = quotient.entries(blocks, len(values), bits).collect()
    assert Counter({r.fp: r.n for r in got}) == Counter(signed) and len(got) == len(set(signed))
    assert len({r.block for r in blocks.collect()}) == blocks.count()
    assert {r.fp for r in quotient.entries(blocks, len(values), bits, least=2).collect()} == {v for v, n in Counter(signed).items() if n > 1}


def test_merged_filter_equals_that_of_all():
    rng = np.random.default_rng(1)
    parts = [np.sort(rng.integers(0, 1 << 30, 400, np.uint64) % np.uint64(600)) for _ in range(4)]
    single = lambda v: quotient.Block(v, np.ones(len(v), np.int64))
    packed = [quotient.merged([single(p)]).packed(30) for p in parts]
    whole = quotient.merged([single(np.concatenate(parts))])
    again = quotient.merged([quotient.Block.unpacked(p, 30) for p in packed])
    assert (again.values == whole.values).all() and (again.counts == whole.counts).all()
    assert again.packed(30) == whole.packed(30)
