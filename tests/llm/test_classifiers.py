"""Classifiers: held-out accuracy, and defined results for odd rows."""

from __future__ import annotations

import os
import zlib

import numpy as np
import pytest

from srcatlas.llm import features, langid, quality, queries, toxicity
from srcatlas.llm.common import held_out


def other_third(key):
    return zlib.crc32(str(key).encode()) % 3 == 1


@pytest.fixture(scope="module")
def larger(sf_dir):
    """Enough rows to learn from."""
    path = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.01")
    if not os.path.isdir(path):
        pytest.skip("test tables are not there")
    return path


def test_held_out(spark):
    rows = spark.range(200).select("id", held_out("id").alias("h")).collect()
    assert [r.h for r in rows] == [other_third(r.id) for r in rows]


@pytest.mark.parametrize("count", [1, 2, 3, 4, 6, 7, 30])
def test_codewords_are_far_apart(count):
    code = langid.codewords(count)
    assert len({tuple(row) for row in code}) == count or count == 1
    for i in range(count):
        for j in range(i):
            assert (code[i] != code[j]).sum() >= code.shape[1] // 4
    assert all(0 < (column > 0).sum() < count for column in code.T)


def test_language_query(spark, larger):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{larger}/documents.parquet").collect()}
    rows = queries.op9_language_id(spark, larger).collect()
    assert len(rows) == len(truth) and all(r.held_out == other_third(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    apart = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in apart]) > 0.97


def test_samples_are_bounded_where_keys_repeat(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(langid, "PER_LANGUAGE", 4)
    monkeypatch.setattr(quality, "FITTED_ROWS", 6)
    monkeypatch.setattr(toxicity, "POSITIVES", 4)
    monkeypatch.setattr(toxicity, "UNLABELLED", 4)
    sentence = "the words of a text that is long enough for the labellers to vote on, so that it counts. "
    rows = [(k, sentence * 4 + f"copy {c}", "en") for k in range(3) for c in range(40)]
    rows += [(k, f"der hund und die katze {k} " * 9, "de") for k in range(10, 30)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING").repartition(5)
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 0), (11, 0)], "doc_id BIGINT, toxic INT")
    fitted = []
    monkeypatch.setattr(langid, "Model", lambda x, names: fitted.append(sorted(names)))
    langid.fit(docs, F.lit(True))
    assert fitted.pop() == ["de"] * 4 + ["en"] * 3
    monkeypatch.setattr(quality, "Scorer", lambda x, y: fitted.append(len(x)))
    quality.fit(docs)
    assert fitted.pop() == 6
    collected = []
    monkeypatch.setattr(toxicity, "sorted", lambda found: collected.extend(found) or sorted(collected), raising=False)
    toxicity.fit(docs, labels, F.lit(True))
    assert sorted(r[0] for r in collected) == [0] * 4 + [1] * 2


def test_no_task_ranks_a_whole_group(spark):
    rows = spark.range(0, 40_000, 1, 8).selectExpr("id DIV 2 AS id", "IF(id < 20, 'b', 'a') AS lang", "0 AS one")
    keys = sorted((r.h, r.id, r.lang) for r in rows.distinct().selectExpr("*", "xxhash64(id) AS h").collect())
    for group in ("lang", "one"):
        for bound in (5, 4000, 6000):
            found = features.smallest(rows, "id", group, bound)
            name = lambda k: k[2] if group == "lang" else 0  # noqa: B023, E731
            want = {(k[1], name(k)) for g in {name(k) for k in keys} for k in [k for k in keys if name(k) == g][:bound]}
            assert sorted(map(tuple, found.collect())) == sorted(want)
            plan = found._jdf.queryExecution().executedPlan().toString()
            ranks = [line for line in plan.split("Initial Plan")[-1].splitlines() if "WindowGroupLimit" in line and "salt" in line]
            assert len(ranks) == 2, plan


def test_of_rows_with_one_key_the_least_hash_is_taken(spark):
    rows = [(k % 7, f"text {k}", k % 2) for k in range(60)] * 2 + [(1, None, 1)]
    table = spark.createDataFrame(rows, "id BIGINT, text STRING, other INT")
    want = {}
    for r in table.selectExpr("*", "xxhash64(text) AS h").collect():
        want[r.id, r.other] = min(want.get((r.id, r.other), (r.h, r.text)), (r.h, r.text))
    for n in (1, 6):
        got = features.one_text_each(table.repartition(n)).collect()
        assert sorted((r.id, r.other, r.text) for r in got) == sorted((*k, t) for k, (_, t) in want.items())


def test_many_languages():
    rng = np.random.default_rng(1)
    alphabets = ["".join(chr(97 + c) for c in rng.choice(26, 6, replace=False)) for _ in range(12)]
    make = lambda a: " ".join("".join(rng.choice(list(a), 5)) for _ in range(40))
    names = [f"l{i:02d}" for i in range(12) for _ in range(20)]
    model = langid.Model(langid.vectors([make(alphabets[int(n[1:])]) for n in names]), names)
    number, score = model.predict(langid.vectors([make(alphabets[i]) for i in range(12)]))
    assert number.tolist() == list(range(12)) and (score > 0.3).all()


def test_language_of_odd_rows(make_docs, odd_rows, spark):
    train = spark.createDataFrame(
        [(i, t, l) for i, (t, l) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "de"), ("x", None), ("12", "en")] * 5)]
        + [(None, "the null key", "en")],
        "doc_id BIGINT, text STRING, lang STRING",
    )
    from pyspark.sql import functions as F

    model = langid.fit(train, F.lit(True))
    assert model.languages == ["de", "en"]
    docs = make_docs([*odd_rows, (50, "the dog and cat"), (51, "die katze und"), (52, "123 $$$")])
    rows = langid.predict(docs, model).collect()
    assert len(rows) == len(odd_rows) + 3
    got = {r.doc_id: r for r in rows}
    assert [got[i].lang_pred for i in (1, 2, 3, 52)] == ["und"] * 4 and got[1].score == 0 and got[52].rejected
    assert (got[50].lang_pred, got[51].lang_pred) == ("en", "de")
    kept = langid.accepted(docs, model)
    assert kept.columns == docs.columns and {1, 2, 3, 52}.isdisjoint({r.doc_id for r in kept.collect()}) and kept.count() == len(rows) - 4
    named = docs.withColumn("lang", F.when(F.col("doc_id") == 51, "xx"))
    assert {r.doc_id: r.lang for r in langid.accepted(named, model).collect() if r.doc_id in (50, 51)} == {50: "en", 51: "xx"}
    none = langid.fit(train.where("false"), F.lit(True))
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}
    one = langid.fit(train.where("lang = 'en'"), F.lit(True))
    assert {r.lang_pred for r in langid.predict(docs, one).collect()} == {"und", "en"}
    assert langid.predict(make_docs([]), model).count() == langid.accepted(make_docs([]), model).count() == 0


def test_toxicity_query(spark, larger):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    rows = queries.op10_toxicity(spark, larger).collect()
    assert len(rows) == spark.read.parquet(f"{larger}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == other_third(r.doc_id) for r in rows)
    apart = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([p for t, p in apart if t == 1]) > 0.6 and np.mean([p for t, p in apart if t == 0]) < 0.03


def test_toxicity_of_odd_rows(spark, make_docs, odd_rows):
    from pyspark.sql import functions as F

    rows = [(i, f"nice words number n{i} " + ("you zblarg" if i % 4 == 0 else "you friend")) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(150)] + [(0, 0), (None, 1), (3, None)], "doc_id BIGINT, toxic INT")
    docs = make_docs(rows)
    model = toxicity.fit(docs, labels, F.lit(True))
    got = {r.doc_id: r for r in toxicity.score(make_docs([*rows, *[(1000 + i, t) for i, (_, t) in enumerate(odd_rows)]]), model).collect()}
    assert len(got) == len(rows) + len(odd_rows)
    assert all(got[i].predicted == int(i % 4 == 0) for i in range(200))
    assert all(got[1000 + i].predicted == 0 for i in range(len(odd_rows)))
    blank = toxicity.fit(docs, labels.where("false"), F.lit(True))
    assert {r.score for r in toxicity.score(docs, blank).collect()} == {0.0}
    assert toxicity.score(make_docs([]), model).count() == 0
    assert toxicity.score(make_docs(odd_rows), toxicity.fit(make_docs([]), labels, F.lit(True))).count() == len(odd_rows)


def test_risk_on_negatives_is_kept_above_zero():
    rng = np.random.default_rng(0)
    n = toxicity.STRONGEST + len(toxicity.LEVELS)
    positive = rng.normal(1.5, 1, (300, n))
    unlabelled = np.concatenate([rng.normal(1.5, 1, (200, n)), rng.normal(-1.5, 1, (800, n))])
    model = toxicity.Model(np.zeros(4))
    model.fit(positive, unlabelled, 0.2)
    score = lambda x: 1 / (1 + np.exp(-(((x - model.mean) / model.spread) @ model.weights[:-1] + model.weights[-1])))
    assert (score(rng.normal(1.5, 1, (500, n))) > 0.5).mean() > 0.95 and (score(rng.normal(-1.5, 1, (500, n))) < 0.5).mean() > 0.95


def test_labellers_accuracies_are_found():
    rng = np.random.default_rng(3)
    n = len(quality.LABELLERS)
    truth = rng.random(20_000) < 0.85
    right = rng.uniform(0.7, 0.95, n)
    cast = np.where(rng.random((len(truth), n)) < right, truth[:, None], ~truth[:, None]).astype(int)
    cast[rng.random(cast.shape) < 0.2] = quality.NONE
    patterns, counts = np.unique(quality._pattern(cast), return_counts=True)
    model = quality.LabelModel(patterns, counts)
    found = np.array([(a + b) / 2 for a, b in model.accuracy.values()])
    assert np.abs(found - right).max() < 0.03 and abs(model.share - 0.85) < 0.02
    assert ((model.posterior(quality._pattern(cast)) > 0.5) == truth).mean() > 0.95


def test_quality_query(spark, larger):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    rows = queries.op8_quality(spark, larger).collect()
    assert len(rows) == spark.read.parquet(f"{larger}/documents.parquet").count()
    known = [(truth[r.doc_id], r.keep) for r in rows if r.doc_id in truth]
    assert np.mean([k for t, k in known if t == 1]) > 0.98 and np.mean([k for t, k in known if t == 0]) < 0.2


def test_quality_of_odd_rows(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    rows = quality.score(docs, quality.fit(docs)).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(odd_rows) and got[1].score == got[2].score == got[3].score == 0 and all(0 <= r.score <= 1 for r in rows)
    empty = make_docs([])
    assert quality.score(empty, quality.fit(empty)).count() == 0
    assert quality.score(docs, quality.fit(empty)).count() == len(odd_rows)
