from __future__ import annotations

import numpy as np
import pytest
import xxhash
from conftest import LOWER, plain_words  # noqa: F401  (tests/llm is first in the path)

from srcatlas.llm import queries, simhash
from srcatlas.llm.components import connected_components


def brute_print(text, size=3):
    words = plain_words((text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, bits=2):
    """{position: smallest position that can be reached}."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = np.array(prints, np.uint64)
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= bits) + i + 1:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_golay_keys_meet_within_two_bits():
    code = simhash.Golay()
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 23, 500)
    for bits in (0, 1, 2):
        others = values.copy()
        for i in range(len(others)):
            for b in rng.choice(23, bits, replace=False):
                others[i] ^= 1 << int(b)
        at, left = code.keys(values)
        there, right = code.keys(others)
        for i in range(len(values)):
            assert set(left[at == i]) & set(right[there == i])


@pytest.mark.parametrize("bits", [0, 1, 2])
@pytest.mark.parametrize("paired", [2, 16])
def test_links_join_the_same_components(spark, monkeypatch, bits, paired):
    monkeypatch.setattr(simhash, "PAIRED", paired)
    rng = np.random.default_rng(bits)
    centres = rng.integers(0, 1 << 63, 12)
    prints = {0, -1}
    for c in centres.tolist():
        for _ in range(30):
            value = c
            for b in rng.choice(20, rng.integers(0, 5), replace=False):
                value ^= 1 << int(b)
            prints.add(value)
    prints = sorted(prints)
    found = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp BIGINT"), bits)
    labels = dict(connected_components(found).collect())
    want = brute_components([p & (2**64 - 1) for p in prints], bits)
    assert [labels.get(p, p) for p in prints] == [prints[i] for i in want]


def test_odd_rows(make_docs, odd_rows):
    rows = simhash.near_duplicates(make_docs(odd_rows)).collect()
    assert len(rows) == len(odd_rows)
    assert sorted((str(r.doc_id), r.fp & (2**64 - 1)) for r in rows) == sorted((str(i), brute_print(t)) for i, t in odd_rows)
    names = {r.doc_id: r.component_id for r in rows}
    assert names[1] == names[2] == names[3] == 1 and names[None] == names[6] == 6
    kept = simhash.deduplicate(make_docs(odd_rows)).collect()
    assert [r.doc_id for r in kept].count(6) == 1 and kept[0].others == "o"
    assert 2 not in {r.doc_id for r in kept} and None in {r.doc_id for r in kept}


def test_each_component_keeps_one_document_where_keys_repeat(make_docs):
    one, two, three = "one two three four five six", "red green blue white black grey", "north east south west up down"
    rows = [(1, one), (5, one), (5, two), (5, two), (6, two), (7, three), (7, one), (None, three)]
    kept = simhash.deduplicate(make_docs(rows).repartition(5))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == [(1, one), (5, two), (7, three), (None, three)]
    rows = [(3, one), (3, two), (3, three), (4, two), (3, one)]
    kept = simhash.deduplicate(make_docs(rows).repartition(5))
    assert sorted((r.doc_id, r.text, r.id, r.fp, r.others) for r in kept.collect()) == [(3, t, "x", 7, "o") for t in sorted([one, two, three])]


def test_text_keys_and_empty_table(spark, make_docs):
    docs = make_docs([("b", "x y z"), ("a", "X y z")], "doc_id STRING")
    assert {r.component_id for r in simhash.near_duplicates(docs).collect()} == {"a"}
    assert simhash.near_duplicates(make_docs([])).count() == 0
    assert simhash.deduplicate(make_docs([])).count() == 0


def test_query(spark, sf_dir, documents):
    prints = [brute_print(t) for _, t in sorted(documents)]
    keys = [i for i, _ in sorted(documents)]
    want = brute_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op1_simhash(spark, sf_dir).collect()}
    assert got == {k: (f"{p:016x}", keys[w]) for k, p, w in zip(keys, prints, want, strict=True)}


def test_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "u BIGINT, v BIGINT")
    found = dict(connected_components(edges).collect())
    assert found == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
