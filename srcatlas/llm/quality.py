"""Quality classifier from weak labels.

Several heuristic labellers look at a text and vote good, bad or not at all; they overlap and err. How often
each pattern of votes occurs is counted over all rows. From these counts expectation-maximisation
estimates, without any true label, how often each labeller is right about good and about bad texts, and
with that the probability that a pattern belongs to a good text.

These posteriors are the labels of a linear scorer over hashed features (character runs with case and symbols kept,
and levels of the measures that the labellers look at), fitted on at most ``FITTED_ROWS`` rows, those whose keys
have the least hash. Every row is scored from its whole text.

Defined cases: a null text is the empty text; a text without words gets no votes, and the score 0; an empty table
gives no rows; every input row gives one output row.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType

from srcatlas.llm.common import Batches, id_field, map_batches, two_columns
from srcatlas.llm.features import Words, code_points, groups, mix, one_text_each, smallest

#: Rows that the scorer is fitted on.
FITTED_ROWS = 4000
FEATURES = 4096
LEVELS = 8
ROUNDS = 100
STEPS = 300
DECAY = 1e-4
GOOD, BAD, NONE = 1, 0, 2

# Frequent short words of English, French, German and Spanish.
COMMON = (
    "the of and to in is that for it as was with be by on are this an at from or et la le les de des en un une que qui dans pour sur au du est "
    "der die das und den von mit zu ein eine nicht auf ist im dem sich als el los las y es por con para su una se no lo del al"
).split()

_U = np.uint64


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """1 letter, 2 capital letter, 3 digit, 4 white space, 0 other, of each code point."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        char = chr(c)
        if char.isalpha():
            out[c] = 2 if char.isupper() else 1
        elif char.isdigit():
            out[c] = 3
        elif char.isspace():
            out[c] = 4
    return out


@lru_cache(maxsize=1)
def _common_hashes() -> np.ndarray:
    points, owner = code_points(COMMON)
    return Words(points, owner, kinds()[points] != 4).hashes()


#: Of each labeller: its measure, bad from here on, good up to here; or the other way round if bad is below good.
LABELLERS = (
    ("symbols", 0.15, 0.08),
    ("capitals", 0.3, 0.1),
    ("doubles", 0.15, 0.03),
    ("bars", 0.05, 0.0),
    ("distinct", 0.25, 0.45),
    ("endings", 0.005, 0.02),
    ("lines", 0.4, 0.2),
    ("common", 0.03, 0.12),
    ("digits", 0.3, 0.1),
)


def measures(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(a column per labeller, words) of each text."""
    points, owner = code_points(texts)
    kind = kinds()[points]
    n = len(texts)

    def share(what: np.ndarray, of: np.ndarray, where: np.ndarray) -> np.ndarray:
        return np.bincount(where[what], minlength=n) / np.maximum(1, np.bincount(where[of], minlength=n))

    words = Words(points, owner, kind != 4)
    hashed, w = words.hashes(), words.owner
    total = np.bincount(w, minlength=n)
    every = np.ones(len(w), bool)
    again = np.concatenate([[False], (hashed[1:] == hashed[:-1]) & (w[1:] == w[:-1])]) if len(w) else every
    order = np.lexsort((hashed, w))
    fresh = np.concatenate([[True], (hashed[order][1:] != hashed[order][:-1]) | (w[order][1:] != w[order][:-1])]) if len(w) else every
    # Long texts repeat words by nature: what counts is the number of distinct words against a power of all.
    distinct = np.bincount(w[order][fresh], minlength=n) / np.maximum(1, total) ** 0.85
    lines = Words(points, owner, points != 10)
    lo, lh = lines.owner, lines.hashes()
    line_order = np.lexsort((lh, lo))
    same = np.concatenate([[False], (lh[line_order][1:] == lh[line_order][:-1]) & (lo[line_order][1:] == lo[line_order][:-1])]) if len(lo) else np.zeros(0, bool)
    last = points[words.ends - 1] if len(w) else np.zeros(0, np.uint32)
    letters = letter_runs(points, owner, kind)
    out = {
        "symbols": share(kind == 0, kind != 4, owner),
        "capitals": share(kind == 2, (kind == 1) | (kind == 2), owner),
        "doubles": share(again, every, w),
        "bars": share((words.sizes == 1) & (last == ord("|")), every, w),
        "distinct": distinct,
        "endings": share(np.isin(last, [ord(c) for c in ".!?"]), every, w),
        "lines": share(same, np.ones(len(lo), bool), lo[line_order]),
        "common": share(np.isin(letters.hashes(), _common_hashes()), np.ones(len(letters.owner), bool), letters.owner),
        "digits": share(kind == 3, kind != 4, owner),
    }
    return np.stack([out[name] for name, _, _ in LABELLERS], axis=1), total


def letter_runs(points: np.ndarray, owner: np.ndarray, kind: np.ndarray) -> Words:
    """Runs of letters, ASCII capitals in lower case."""
    lower = np.where((points >= 65) & (points <= 90), points + 32, points)
    return Words(lower, owner, (kind == 1) | (kind == 2))


def votes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(votes, measures): ``GOOD``, ``BAD`` or ``NONE`` of each labeller."""
    found, total = measures(texts)
    out = np.full(found.shape, NONE)
    for i, (_, bad, good) in enumerate(LABELLERS):
        value = found[:, i]
        if bad > good:
            out[value <= good, i], out[value >= bad, i] = GOOD, BAD
        else:
            out[value >= good, i], out[value <= bad, i] = GOOD, BAD
    out[total == 0] = NONE
    return out, found


def _pattern(cast: np.ndarray) -> np.ndarray:
    return cast @ 3 ** np.arange(cast.shape[1])


class LabelModel:
    """How often each labeller is right, by expectation-maximisation over patterns of votes."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray):
        n = len(LABELLERS)
        cast = patterns[:, None] // 3 ** np.arange(n) % 3
        weight = counts.astype(np.float64)
        good, bad = (cast == GOOD).sum(axis=1), (cast == BAD).sum(axis=1)
        #: Probability of a good text for each pattern; at first the share of votes, which lean to good.
        p = (good + 1.5) / (good + 3.0 * bad + 2.0)
        for _ in range(ROUNDS):
            #: Probability of a good vote by good and by bad texts, given a vote.
            self.right = np.zeros((2, n))
            for label, share in ((GOOD, p), (BAD, 1 - p)):
                yes = ((cast == GOOD) * (weight * share)[:, None]).sum(axis=0)
                no = ((cast == BAD) * (weight * share)[:, None]).sum(axis=0)
                prior = (2.0, 1.0) if label == GOOD else (1.0, 2.0)
                self.right[label] = (yes + prior[0]) / (yes + no + 3.0)
            self.share = (weight * p).sum() / max(1.0, weight.sum())
            p = self.posterior(patterns)
        self.accuracy = {name: (self.right[GOOD, i], 1 - self.right[BAD, i]) for i, (name, _, _) in enumerate(LABELLERS)}

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of a good text."""
        cast = patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
        odds = np.log(self.share + 1e-9) - np.log(1 - self.share + 1e-9)
        odds = odds + ((cast == GOOD) * np.log(self.right[GOOD] / self.right[BAD])).sum(axis=1)
        odds = odds + ((cast == BAD) * np.log((1 - self.right[GOOD]) / (1 - self.right[BAD]))).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def vectors(texts: list[str], found: np.ndarray) -> np.ndarray:
    """Hashed features: runs of two and three characters, and levels of the measures."""
    points, owner = code_points(texts)
    hashed = points.astype(_U) * _U(0x9E3779B97F4A7C15)
    out = np.zeros(len(texts) * FEATURES, np.float32)
    for n in (2, 3):
        if len(points) < n:
            break
        hashed = hashed[:-1] * _U(0xD1342543DE82EF95) + points[n - 1 :].astype(_U) * _U(0x9E3779B97F4A7C15)
        same = owner[: len(hashed)] == owner[n - 1 :]
        feature = (mix(hashed[same] + _U(n)) >> _U(52)).astype(np.int64)
        out += np.bincount(owner[: len(hashed)][same] * FEATURES + feature, minlength=len(out)).astype(np.float32)
    out = np.sqrt(out.reshape(len(texts), FEATURES))
    out /= np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-9)
    for i, (_, bad, good) in enumerate(LABELLERS):
        edges = np.linspace(min(bad, max(good, 0.0)) / 2, max(bad, good) * 1.25, LEVELS - 1)
        level = np.digitize(found[:, i], edges)
        feature = (mix((np.int64(i * LEVELS) + level).astype(_U) + _U(1 << 20)) >> _U(52)).astype(np.int64)
        out[np.arange(len(texts)), feature] += 0.3
    return out


class Scorer:
    """Linear scorer of hashed features."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        """Fit to rows of features, with a last column of ones, and to their probabilities."""
        self.weights = np.zeros(FEATURES + 1)
        if not len(x):
            return
        # Both labels weigh the same, however rare bad texts are.
        weight = y / max(y.sum(), 1e-9) + (1 - y) / max((1 - y).sum(), 1e-9)
        first, second = np.zeros_like(self.weights), np.zeros_like(self.weights)
        for step in range(1, STEPS + 1):
            p = 1 / (1 + np.exp(-(x @ self.weights.astype(np.float32))))
            target = y / max(y.sum(), 1e-9)
            slope = x.T @ (weight * p - target).astype(np.float32) + DECAY * np.append(self.weights[:-1], 0)
            first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
            self.weights -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality."""
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[LabelModel, Scorer]:
    """The label model from all rows, the scorer from a bounded sample of them."""
    texts = two_columns(docs, id_col, text_col)
    counted = StructType([StructField("pattern", LongType()), StructField("n", LongType())])

    def count(batches: Batches) -> Batches:
        for batch in batches:
            for _, part in groups(batch.column(1).to_pylist()):
                patterns, n = np.unique(_pattern(votes(part)[0]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(patterns.astype(np.int64)), pa.array(n)], names=counted.names)

    # At most three to the number of labellers.
    table = map_batches(texts, count, counted).groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").toPandas()
    model = LabelModel(table["pattern"].to_numpy(np.int64), table["n"].to_numpy(np.int64))
    keys = texts.select("id", F.lit(0).alias("one")).where("id IS NOT NULL")
    chosen = smallest(keys, "id", "one", FITTED_ROWS).select("id")
    schema = StructType([StructField("y", DoubleType()), StructField("x", BinaryType())])

    def describe(batches: Batches) -> Batches:
        for batch in batches:
            for _, part in groups(batch.column(1).to_pylist()):
                cast, found = votes(part)
                some = np.flatnonzero((cast != NONE).any(axis=1))
                x, y = vectors(part, found)[some], model.posterior(_pattern(cast))[some]
                packed = pa.array([row.astype(np.float16).tobytes() for row in x], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(y), packed], names=schema.names)

    sample = one_text_each(texts.join(F.broadcast(chosen), "id").select("id", "text"))
    # Two bytes a feature: at most 32 MB.
    found = map_batches(sample, describe, schema).collect()
    found = sorted((row.y, bytes(row.x)) for row in found)
    matrix = np.zeros((len(found), FEATURES + 1), np.float32)
    matrix[:, FEATURES] = 1
    for i, (_, x) in enumerate(found):
        matrix[i, :FEATURES] = np.frombuffer(x, np.float16)
    return model, Scorer(matrix, np.array([y for y, _ in found]))


def score(docs: DataFrame, model: tuple[LabelModel, Scorer], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, score, posterior, keep): the scorer's and the label model's probability of good quality."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([id_field(docs, id_col), StructField("score", DoubleType()), StructField("posterior", DoubleType())])

    def run(batches: Batches) -> Batches:
        labels, scorer = sent.value
        for batch in batches:
            scores, posteriors = [np.zeros(0)], [np.zeros(0)]
            for _, part in groups(batch.column(1).to_pylist()):
                cast, found = votes(part)
                some = (cast != NONE).any(axis=1)
                scores.append(np.where(some, scorer.scores(vectors(part, found)), 0.0))
                posteriors.append(np.where(some, labels.posterior(_pattern(cast)), 0.0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(scores)), pa.array(np.concatenate(posteriors))], names=schema.names
            )

    return map_batches(two_columns(docs, id_col, text_col), run, schema).withColumn("keep", F.col("score") >= 0.5)
