"""Decontamination and substring dedup against brute force and SQL."""

from __future__ import annotations

import hashlib
import os
import random

import duckdb
import pytest
from conftest import item_words, plain_words

from srcatlas.llm import decontaminate, oracle, queries, substring


def brute_hits(docs, items, window=10):
    patterns = {}
    for key, text in items:
        words = item_words(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            patterns.setdefault(tuple(words[i : i + window]), set()).add(key)
    out = []
    for key, text in docs:
        words, hit, found = item_words(text), set(), set()
        for size in {len(p) for p in patterns}:
            for i in range(len(words) - size + 1):
                if (owners := patterns.get(tuple(words[i : i + size]))) is not None:
                    hit.update(range(i, i + size))
                    found |= owners
        out.append((key, len(words), len(hit), tuple(sorted(str(f) for f in found if f is not None))))
    return sorted(out, key=str)


def brute_kept(docs, window=20):
    """A window stays where it starts at its least (key, start), in every row of that key."""
    first, out = {}, []
    place = lambda key, i: (key is not None, key or 0, i)
    each = [(key, plain_words(text)) for key, text in docs]
    for key, words in each:
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            first[w] = min(first.get(w, place(key, i)), place(key, i))
    for key, words in each:
        gone = set()
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] != place(key, i):
                gone.update(range(i, i + window))
        out.append((key, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return sorted(out, key=str)


def hits(frame):
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in frame.collect()), key=str)


def kept(frame):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in frame.collect()), key=str)


def random_docs(seed, n=60):
    rnd = random.Random(seed)
    passages = [[rnd.choice("abcdefgh") * rnd.randint(1, 2) for _ in range(rnd.randint(5, 70))] for _ in range(6)]
    docs = []
    for i in range(n):
        words = []
        for _ in range(rnd.randint(0, 4)):
            words += rnd.choice(passages) if rnd.random() < 0.6 else [rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 30))]
        docs.append((i, rnd.choice([" ", "\n", "  "]).join(words)))
    return docs, [(i, " ".join(p)) for i, p in enumerate(passages)]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("pass_bytes", [1, 10**6])
def test_hits_of_random_texts(spark, make_docs, seed, pass_bytes):
    docs, items = random_docs(seed)
    items += [(90, "aa"), (91, ""), (None, "bb CC dd"), (92, None), (0, "hh gg"), (93, "A-a b")]
    found = decontaminate.decontaminate(make_docs(docs), spark.createDataFrame(items, "item_id BIGINT, text STRING"), pass_bytes=pass_bytes)
    assert hits(found) == brute_hits(docs, items)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("hot", [1, 10**6])
def test_kept_words_of_random_texts(make_docs, monkeypatch, seed, hot):
    monkeypatch.setattr(substring, "HOT_ROWS", hot)
    monkeypatch.setattr(substring, "ORDERED_ROWS", 40)
    monkeypatch.setattr(substring, "GROUP_BYTES", 700)
    docs, _ = random_docs(seed + 10)
    docs.append((100, " ".join(["again"] * 70)))
    for window in (20, 6, 40):
        assert kept(substring.dedup_substrings(make_docs(docs), window)) == brute_kept(docs, window)


@pytest.mark.parametrize("key", [1, None])
def test_repeated_keys_keep_one_whole_copy(make_docs, key):
    passage = [f"p{i}" for i in range(80)]
    own = lambda name, n: [f"{name}{i}" for i in range(n)]
    docs = [(key, " ".join(own("x", 50) + passage)), (key, " ".join(own("y", 10) + passage)), (2, " ".join(own("z", 5) + passage))]
    found = kept(substring.dedup_substrings(make_docs(docs)))
    assert found == brute_kept(docs) and sorted(r[2] for r in found) == [0, 80, 80]
    whole = [r.text for r in substring.without_repeats(make_docs(docs), chars_col="n").collect()]
    assert sum(" ".join(passage) in t for t in whole) == 1
    # Equal rows, also of a third text, don't remove each other.
    docs = docs[:2] + docs[:1] * 3
    assert kept(substring.dedup_substrings(make_docs(docs))) == brute_kept(docs)


def test_random_texts_under_few_keys(make_docs):
    docs, _ = random_docs(77, 80)
    docs = [(None if i % 5 == 4 else i % 5, text) for i, text in docs]
    for window in (20, 6):
        assert kept(substring.dedup_substrings(make_docs(docs), window)) == brute_kept(docs, window)


def test_unequal_words_with_equal_hashes(make_docs):
    one = "a"
    for _ in range(10):
        one += one.translate(str.maketrans("ab", "ba"))
    other = one.translate(str.maketrans("ab", "ba"))
    assert (substring.word_hashes(one.encode()) == substring.word_hashes(other.encode())).all()
    shared = " ".join(f"s{i}" for i in range(19))
    docs = [(1, f"{shared} {one} end"), (2, f"{shared} {other} end"), (3, f"{shared} {other} end")]
    assert [r[2] for r in kept(substring.dedup_substrings(make_docs(docs)))] == [0, 0, 21]


def test_spans_are_compared_before_they_go():
    words = [f"w{i}".encode() for i in range(30)]
    x = int(substring.np.bitwise_xor.reduce(substring._identities(words, substring.np.arange(3, 8), 20)))
    span = {"start": 3, "length": 5, "first": False, "copies": 2, "x": x}
    assert substring._verified(words, [span], 20)[0] == [[3, 27]]
    assert substring._verified(words[::-1], [span], 20)[0] == []
    assert substring._verified(words[:20], [span], 20)[0] == []
    assert substring._verified(words, [span | {"first": True}], 20) == ([], [[3, 27, 2]])


def test_passage_in_a_third_of_the_documents(make_docs):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = [(i, f"a{i} b{i} {passage} c{i}" if i % 3 == 0 else f"d{i}") for i in range(300)]
    assert kept(substring.dedup_substrings(make_docs(docs).repartition(5))) == brute_kept(docs)


def test_odd_rows(spark, make_docs, odd_rows):
    items = spark.createDataFrame([(1, "one TWO three"), (2, None), (2, "w1x1 w2x2 w3x3")], "item_id BIGINT, text STRING")
    docs = make_docs(odd_rows)
    assert hits(decontaminate.decontaminate(docs, items)) == brute_hits(odd_rows, [(1, "one two three"), (2, "w1x1 w2x2 w3x3")])
    assert kept(substring.dedup_substrings(docs)) == brute_kept(odd_rows)
    clean = decontaminate.clean(docs, items)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {1, 2, 3, 4, 5, 9, 10, 11}
    left = substring.without_repeats(docs, chars_col="n").collect()
    assert len(left) == len(odd_rows) and {r.others for r in left} == {"o"}
    texts = {r.doc_id: r.text for r in left}
    assert texts[11] == "  spaced   out  " and texts[1] is None and texts[8].endswith("end") and len(texts[8]) < 200
    assert {r.doc_id: r.n for r in left}[8] == len(texts[8])


def test_empty_tables(spark, make_docs):
    empty = make_docs([])
    items = spark.createDataFrame([], "item_id BIGINT, text STRING")
    assert decontaminate.decontaminate(empty, items).count() == 0
    assert hits(decontaminate.decontaminate(make_docs([(1, "a b")]), items)) == [(1, 2, 0, ())]
    assert substring.dedup_substrings(empty).count() == 0
    assert substring.without_repeats(empty, chars_col="n").count() == 0


def test_paths_have_the_sources_coordinates(make_docs):
    passage = " ".join(f"p{i}" for i in range(50))
    docs = make_docs([(1, "one two " + passage + " three"), (2, passage), (3, "four " + passage)])
    rows = {r.doc_id: r for r in substring.dedup_substrings(docs).collect()}
    assert rows[1].sources == [[2, 52, 3]] and rows[1].removed == [] and rows[2].removed == [[0, 50]] and rows[3].removed == [[1, 51]]


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{os.path.join(sf_dir, table)}.parquet'")
    want = con.sql(oracle.SQL[name])
    got = queries.QUERIES[name](spark, sf_dir).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_queries_against_brute_force(spark, sf_dir, documents):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op4_substring_dedup(spark, sf_dir).collect()}
    assert got == {k: (n, gone, hashlib.sha256(text.encode()).hexdigest()) for k, n, gone, text in brute_kept(documents)}
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in queries.op3_decontamination(spark, sf_dir).collect()}
    want = {k: (n, hit, len(i), hashlib.sha256(",".join(i).encode()).hexdigest()) for k, n, hit, i in brute_hits(documents, items)}
    assert got == want and any(w[1] for w in want.values())


def test_tables_are_made_once_in_a_worker(spark, tmp_path):
    """Eight tasks on fewer workers: a worker that goes on keeps the tables of its broadcast block."""
    from pyspark.sql.types import LongType, StructField, StructType

    item = [("q", "one two three four five six seven eight nine ten")]
    sent = decontaminate._send(spark, item, 10)

    def run(batches):
        import os

        import pyarrow as pa

        new = sent.value.built is None
        found = sent.value.searches()
        assert found is sent.value.searches()
        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([os.getpid()], pa.int64()), pa.array([int(new)], pa.int64())], names=["pid", "new"])

    schema = StructType([StructField("pid", LongType()), StructField("new", LongType())])
    rows = spark.range(8).repartition(8).mapInArrow(run, schema).collect()
    assert len(rows) == 8 and sum(r.new for r in rows) == len({r.pid for r in rows})
