"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic texts are positive examples; all others are unlabelled, the toxic ones among them
included. Two risks are estimated from these, with the class prior taken out of the unlabelled part and the
rest never let below zero:

1. For each hashed word and word beginning, the share of positive texts that hold it is compared with the
   share among negative ones, which is what the unlabelled share leaves once the prior's part of
   the positive share is taken away, zero at least. Their log ratio is the feature's evidence. These
   counts cover all rows that may be learned from.
2. A text is described by its strongest pieces of evidence, and a logistic classifier is fitted to
   that by gradient steps on the non-negative risk: where the estimated risk on negatives is below zero, the
   step goes back up instead. Fitted on at most ``POSITIVES`` and ``UNLABELLED`` rows.

Defined cases: a null text, an empty text and a text without letters are described by zeros and get the score
that follows; without any positive example every score is 0; rows with a null label count as unlabelled; of several
labels of one key, one positive is enough; every input row gives one output row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from srcatlas.llm import bloom
from srcatlas.llm.common import Batches, id_field, map_batches, two_columns
from srcatlas.llm.features import Words, code_points, groups, letters, mix, one_text_each, smallest

#: Rows that the classifier is fitted on.
POSITIVES = 3000
UNLABELLED = 6000
FEATURE_BITS = 18
#: Texts that a feature must be in beyond chance, on either side of the ratio.
SMOOTHING = 4.0
BEGINNINGS = (4, 5)
#: Strongest pieces of evidence that describe a text, and the levels at which they are counted.
STRONGEST = 4
LEVELS = (1.0, 2.0, 3.0, 4.0)
STEPS = 3000
RATE = 0.05
DECAY = 1e-3

_U = np.uint64


def text_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of the distinct features of each text, in order."""
    points, owner = code_points([t.lower() for t in texts])
    words = Words(points, owner, letters()[points])
    found = []
    for longest in (None, *BEGINNINGS):
        long = slice(None) if longest is None else words.sizes > longest
        hashed = mix(words.hashes(longest)[long] + _U(longest or 0)) >> _U(64 - FEATURE_BITS)
        found.append((words.owner[long] << FEATURE_BITS) | hashed.astype(np.int64))
    pairs = np.unique(np.concatenate(found))
    return pairs >> FEATURE_BITS, pairs & ((1 << FEATURE_BITS) - 1)


def describe(texts: list[str], evidence: np.ndarray) -> np.ndarray:
    """Strongest evidence of each text, and how many pieces reach each level."""
    owner, feature = text_features(texts)
    weight = evidence[feature]
    strong = weight > 0
    owner, weight = owner[strong], weight[strong].astype(np.float64)
    order = np.lexsort((-weight, owner))
    owner, weight = owner[order], weight[order]
    place = np.arange(len(owner)) - np.searchsorted(owner, owner)
    out = np.zeros((len(texts), STRONGEST + len(LEVELS)))
    top = place < STRONGEST
    out[owner[top], place[top]] = weight[top]
    for i, level in enumerate(LEVELS):
        out[:, STRONGEST + i] = np.log1p(np.bincount(owner[weight >= level], minlength=len(texts)))
    return out


class Model:
    """Evidence of each feature and the classifier of descriptions."""

    def __init__(self, evidence: np.ndarray):
        self.evidence = evidence.astype(np.float32)
        n = STRONGEST + len(LEVELS)
        self.mean, self.spread = np.zeros(n), np.ones(n)
        self.weights: np.ndarray | None = None

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> None:
        """Gradient steps on the non-negative risk."""
        both = np.concatenate([positive, unlabelled])
        self.mean, self.spread = both.mean(axis=0), both.std(axis=0) + 1e-6
        p, u = (np.concatenate([(x - self.mean) / self.spread, np.ones((len(x), 1))], axis=1) for x in (positive, unlabelled))
        w = np.zeros(p.shape[1])
        first, second = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, STEPS + 1):
            up, uu = 1 / (1 + np.exp(-p @ w)), 1 / (1 + np.exp(-u @ w))
            # Risk of positives as positives, of unlabelled as negatives, of positives as negatives.
            as_positive = -(p * (1 - up)[:, None]).mean(axis=0)
            negative = np.logaddexp(0, u @ w).mean() - prior * np.logaddexp(0, p @ w).mean()
            gradient = (u * uu[:, None]).mean(axis=0) - prior * (p * up[:, None]).mean(axis=0)
            slope = prior * as_positive + gradient if negative >= 0 else -gradient
            slope = slope + DECAY * np.append(w[:-1], 0)
            first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
            w -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        self.weights = w

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1."""
        if self.weights is None:
            return np.zeros(len(texts))
        x = (describe(texts, self.evidence) - self.mean) / self.spread
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -50, 50)))


def _counts(texts: DataFrame, among: np.ndarray) -> np.ndarray:
    """Texts (columns id, text) with each feature, for those that ``among`` holds."""
    schema = StructType([StructField("feature", IntegerType()), StructField("n", LongType())])
    sent = texts.sparkSession.sparkContext.broadcast(np.packbits(among))

    def run(batches: Batches) -> Batches:
        total = np.zeros(1 << FEATURE_BITS, np.int64)
        for batch in batches:
            for _, part in groups(batch.column(1).to_pylist()):
                total += np.bincount(text_features(part)[1], minlength=len(total))
        some = np.flatnonzero((total > 0) & np.unpackbits(sent.value).astype(bool))
        for at in range(0, len(some), 50_000):
            part = some[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], names=schema.names)

    # At most 2^FEATURE_BITS rows.
    table = map_batches(texts, run, schema).groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << FEATURE_BITS, np.int64)
    out[table["feature"].to_numpy(np.int64)] = table["n"].to_numpy(np.int64)
    return out


def fit(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    prior: float | None = None,
) -> Model:
    """Fit on the rows for which ``learn`` (an expression over ``id``) holds.

    ``prior`` is the share of toxic texts among the unlabelled; if not given, the toxic share of labelled rows is taken to
    hold for the rows without a label too.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    texts = two_columns(docs, id_col, text_col).where(learn)
    keys = texts.select("id").join(known, "id", "left").select("id", "label", F.coalesce(F.col("label") == 1, F.lit(False)).alias("positive"))
    total, labelled, toxic = keys.agg(F.count("*"), F.count("label"), F.count_if("positive")).first()
    model = Model(np.zeros(1 << FEATURE_BITS))
    if not toxic:
        return model
    if prior is None:
        share = toxic / labelled
        prior = min(0.9, max(share * (total - labelled) / max(1, total - toxic), 0.001))
    confirmed = known.where("label = 1").select("id")
    p = _counts(bloom.narrowed(texts, confirmed, "id").join(confirmed, "id", "left_semi"), np.ones(1 << FEATURE_BITS, bool))
    # Only what two positive texts hold can be evidence.
    again = p > 1
    u = _counts(texts, again) - p
    p, u = p / toxic, u / max(1, total - toxic)
    negative = np.maximum(0, (u - prior * p) / (1 - prior))
    floor = SMOOTHING / toxic
    model.evidence[:] = np.where(again, np.log((p + floor) / (negative + floor)), 0)
    chosen = smallest(keys.where("id IS NOT NULL"), "id", "positive", max(POSITIVES, UNLABELLED))
    sample = one_text_each(texts.join(F.broadcast(chosen), "id").select("id", "text", "positive"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([StructField("positive", IntegerType()), StructField("x", ArrayType(DoubleType()))])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for at, part in groups(batch.column(1).to_pylist()):
                x = describe(part, sent.value.evidence)
                positive = batch.column(2).slice(at, len(part)).cast(pa.int32())
                yield pa.RecordBatch.from_arrays([positive, pa.array(x.tolist(), pa.list_(pa.float64()))], names=schema.names)

    described = sorted(map(tuple, map_batches(sample, run, schema).collect()))
    x = np.array([r[1] for r in described])
    positive = np.array([r[0] for r in described]) == 1
    if positive.any() and not positive.all():
        spread = np.random.default_rng(3).permutation
        model.fit(spread(x[positive])[:POSITIVES], spread(x[~positive])[:UNLABELLED], prior)
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, score, predicted) for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([id_field(docs, id_col), StructField("score", DoubleType())])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            found = [sent.value.scores(part) for _, part in groups(batch.column(1).to_pylist())]
            scores = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=schema.names)

    out = map_batches(two_columns(docs, id_col, text_col), run, schema)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
