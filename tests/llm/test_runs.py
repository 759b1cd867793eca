"""Periodic runs against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from conftest import plain_words

from srcatlas.llm import queries, runs


def brute_runs(words):
    """Every (start, length, period) by trying all periods."""
    n, out = len(words), []
    for p in range(1, n // 4 + 1):
        x = 0
        while x < n - p:
            start = x
            while x < n - p and words[x] == words[x + p]:
                x += 1
            length = x - start + p
            own = words[start : start + length]
            if x > start and length >= max(6, 4 * p) and not any(own[q:] == own[:-q] for q in range(1, p)):
                out.append((start, length, p))
            x += x == start
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapsed(words, found):
    gone = {i for start, length, period in found for i in range(start + period, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def planted(key, words):
    code = zlib.crc32(str(key).encode())
    n, g = len(words), code // 10
    if key is None or code % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def random_words(rng):
    letters = "abc"[: rng.randint(1, 3)]
    words = [rng.choice(letters) for _ in range(rng.randint(0, 30))]
    for _ in range(rng.randint(0, 3)):
        root = [rng.choice(letters) for _ in range(rng.randint(1, 9))]
        at = rng.randint(0, len(words))
        words[at:at] = (root * rng.randint(1, 9))[: rng.randint(1, 60)]
    return words


@pytest.mark.parametrize("seed", range(8))
def test_random_texts(seed):
    rng = random.Random(seed)
    for _ in range(150):
        lists = [random_words(rng) for _ in range(rng.randint(1, 5))]
        found = runs.find_runs([[w.encode() for w in words] for words in lists])
        assert [[tuple(r) for r in own.tolist()] for own in found] == [brute_runs(words) for words in lists]


def test_runs_do_not_cross_texts():
    assert [len(r) for r in runs.find_runs([[b"a"] * 4, [b"a"] * 4, [b"a"] * 5])] == [0, 0, 0]
    assert [r.tolist() for r in runs.find_runs([[b"a"] * 6, [], [b"a", b"b"] * 4])] == [[[0, 6, 1]], [], [[0, 8, 2]]]


def test_long_periods_and_overlaps():
    root = [str(i).encode() for i in range(1000)]
    assert runs.find_runs([root * 4])[0].tolist() == [[0, 4000, 1000]]
    assert runs.find_runs([(root * 4)[:-1]])[0].tolist() == []
    nested = ([b"x"] * 6 + [b"y"]) * 4
    assert runs.find_runs([nested])[0].tolist() == [[0, 6, 1], [0, 28, 7], [7, 6, 1], [14, 6, 1], [21, 6, 1]]


def test_operator_on_odd_rows(spark, make_docs, odd_rows):
    rows = [*odd_rows, (20, "a " * 50_000), (21, "a b a b a b a b c"), (21, "a b a b a b a b c")]
    found = runs.periodic_runs(make_docs(rows)).collect()
    assert len(found) == len(rows)
    by_text = {(r.doc_id, r.n_words): r for r in found}
    assert [tuple(x) for x in by_text[20, 50_000].runs] == [(0, 50_000, 1)] and by_text[20, 50_000].collapsed == "a"
    assert by_text[21, 9].collapsed == "a b c"
    assert by_text[1, 0].runs == [] and by_text[1, 0].collapsed == ""
    assert by_text[7, 60_000].runs == []
    assert runs.periodic_runs(make_docs([])).collect() == []


def test_repeats_by_rule(spark, make_docs, odd_rows):
    rows = [*odd_rows, *[(i, " ".join(f"w{j}" for j in range(i % 40))) for i in range(100, 400)]]
    found = runs.with_repeats(make_docs(rows)).collect()
    want = [(key, planted(key, plain_words(text))) for key, text in rows]
    assert sorted([(str(r.doc_id), plain_words(r.text)) for r in found]) == sorted([(str(k), w) for k, w in want])
    assert sum(w != plain_words(t) for (_, w), (_, t) in zip(want, rows, strict=True)) > 10


def test_query(spark, sf_dir, documents):
    found = {r.doc_id: r for r in queries.op11_periodic_runs(spark, sf_dir).collect()}
    assert len(found) == len(documents)
    some = 0
    for key, text in documents:
        words = planted(key, plain_words(text))
        if len(words) > 800:
            continue
        own, row = brute_runs(words), found[key]
        some += len(own)
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in own)
        assert row.n_runs == len(own)
        assert row.runs_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(brute_collapsed(words, own).encode()).hexdigest()
        top = min(own, key=lambda r: (-r[1], r[0], r[2])) if own else (None,) * 3
        assert (row.start, row.length, row.period) == top
        assert row.exponent_milli == (1000 * top[1] // top[2] if own else None)
    assert some > 10
