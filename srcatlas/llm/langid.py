"""Language ID by error-correcting output codes.

Each language has a codeword of bits. For each bit a linear classifier over hashed character
n-grams (one to three letters) tells the languages with a one from those with a zero. A text's
margins are compared with all codewords: each bit adds the logistic loss of its margin,
weighted by how well its classifier does on rows that it was not fitted on, and the codeword with the
least loss wins. If the second one is close, the result is flagged as ambiguous.

Fitted on at most ``PER_LANGUAGE`` rows of each language (those whose keys have the least hash);
every row is predicted from its whole text.

Defined cases: a text that is null or has no letters gets ``und`` with score 0 and is rejected; rows whose language or
text is null or that have no letters are not learned from; with one language learned, every text with letters gets it; with
none, every text gets ``und``, but only texts without letters are rejected; every input row gives one output row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, StringType, StructField, StructType

from srcatlas.llm.common import Batches, id_field, map_batches, two_columns
from srcatlas.llm.features import code_points, groups, letters, mix, one_text_each, smallest

UNKNOWN = "und"
#: Rows of each language that the classifiers are fitted on.
PER_LANGUAGE = 300
FEATURES = 4096
#: Steepness of the loss: least squares margins are about one.
STEEP = 6.0
RIDGE = 0.5
#: A softmax over codewords below this is ambiguous.
SURE = 0.6

_U = np.uint64


def vectors(texts: list[str]) -> np.ndarray:
    """Unit vectors of roots of n-gram counts; zero for texts without letters."""
    points, owner = code_points([t.lower() for t in texts])
    letter = letters()[points]
    keep = letter | np.concatenate([[False], letter[:-1]])  # of other characters, one between words
    points, owner, letter = np.where(letter, points, 32)[keep].astype(_U), owner[keep], letter[keep]
    out = np.zeros(len(texts) * FEATURES, np.float32)
    hashed = points * _U(0x9E3779B97F4A7C15)
    for n in (1, 2, 3):
        if len(points) < n:
            break
        if n > 1:
            hashed = hashed[:-1] * _U(0xD1342543DE82EF95) + points[n - 1 :] * _U(0x9E3779B97F4A7C15)
        same = (owner[: len(hashed)] == owner[n - 1 :]) & (letter[: len(hashed)] | letter[n - 1 :])
        feature = (mix(hashed[same] + _U(n)) >> _U(52)).astype(np.int64)
        out += np.bincount(owner[: len(hashed)][same] * FEATURES + feature, minlength=len(out)).astype(np.float32)
    out = np.sqrt(out.reshape(len(texts), FEATURES))
    length = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(length > 0, length, 1)


def codewords(count: int) -> np.ndarray:
    """A row of -1 and 1 for each language.

    Up to 6 languages: all ways to part them; more: the random code whose codewords are furthest apart.
    """
    if count <= 6:
        return np.array([[1 if (c >> i) & 1 else -1 for c in range(1, 1 << (count - 1))] for i in range(count)]).reshape(count, -1)
    rng = np.random.default_rng(7)
    best, most = None, -1
    for _ in range(200):
        code = rng.choice([-1, 1], (count, 15 * int(np.ceil(np.log2(count)))))
        apart = (code.shape[1] - code @ code.T) // 2 + code.shape[1] * np.eye(count, dtype=int)
        if (np.abs(code.sum(axis=0)) < count).all() and apart.min() > most:
            best, most = code, apart.min()
    return best


def _ridge(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return x.T @ np.linalg.solve(x @ x.T + RIDGE * np.eye(len(x)), y)


class Model:
    """Languages, their codewords, and one linear classifier per bit."""

    def __init__(self, x: np.ndarray, names: list[str]):
        self.languages = sorted(set(names))
        self.code = codewords(len(self.languages)).astype(np.float64) if self.languages else np.zeros((0, 0))
        x = np.concatenate([x, np.ones((len(x), 1))], axis=1).astype(np.float64) if len(x) else np.zeros((0, FEATURES + 1))
        which = np.searchsorted(self.languages, names) if names else np.zeros(0, int)
        y = self.code[which]
        self.weights = _ridge(x, y).astype(np.float32) if y.size else np.zeros((FEATURES + 1, self.code.shape[1]), np.float32)
        # Weight of a bit: its right answers on every fifth row, when fitted on the others.
        self.trust = np.ones(self.code.shape[1])
        apart = np.arange(len(x)) % 5 == 0
        if y.size and apart.any() and not apart.all():
            right = (x[apart] @ _ridge(x[~apart], y[~apart])) * y[apart] > 0
            self.trust = np.maximum(2 * right.mean(axis=0) - 1, 0.05)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the language, softmax of its loss) for each row."""
        margins = x @ self.weights[:-1] + self.weights[-1]
        loss = np.logaddexp(0, -STEEP * margins[:, None, :] * self.code[None]) @ self.trust
        weight = np.exp(loss.min(axis=1, keepdims=True) - loss)
        return loss.argmin(axis=1), weight.max(axis=1) / weight.sum(axis=1)

    def label(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, whether it is ambiguous, and whether the text is rejected, of each text."""
        names: list[str] = []
        scores, rejected = [np.zeros(0)], [np.zeros(0, bool)]
        for _, part in groups(texts):
            x = vectors(part)
            some = x.any(axis=1)
            rejected.append(~some)
            if not self.languages:
                some[:] = False
            number, score = self.predict(x) if self.languages else (np.zeros(len(x), int), np.zeros(len(x)))
            names += [self.languages[n] if s else UNKNOWN for n, s in zip(number.tolist(), some.tolist(), strict=True)]
            scores.append(np.where(some, score, 0.0).astype(np.float64))
        score = np.concatenate(scores)
        return names, score, score < SURE, np.concatenate(rejected)


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit the classifiers on the rows for which ``learn`` holds."""
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"), learn.alias("learn")
    ).where("learn AND lang IS NOT NULL AND text IS NOT NULL AND id IS NOT NULL")
    chosen = smallest(rows, "id", "lang", PER_LANGUAGE).withColumnRenamed("lang", "chosen")
    sample = one_text_each(rows.join(F.broadcast(chosen), "id").where("lang = chosen").select("id", "text", "lang"))
    schema = StructType([StructField("lang", StringType()), StructField("x", BinaryType())])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for at, part in groups(batch.column(1).to_pylist()):
                x = vectors(part)
                good = np.flatnonzero(x.any(axis=1))
                lang = batch.column(2).slice(at, len(part)).take(pa.array(good))
                yield pa.RecordBatch.from_arrays(
                    [lang.cast(pa.string()), pa.array([x[i].astype(np.float16).tobytes() for i in good], pa.binary())], names=schema.names
                )

    found = sorted(map(tuple, map_batches(sample, run, schema).collect()), key=lambda r: (bytes(r[1]), r[0]))
    x = np.array([np.frombuffer(r[1], np.float16) for r in found], np.float32).reshape(-1, FEATURES)
    return Model(x, [r[0] for r in found])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, lang_pred, score, ambiguous, rejected) for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType(
        [
            id_field(docs, id_col),
            StructField("lang_pred", StringType()),
            StructField("score", DoubleType()),
            StructField("ambiguous", BooleanType()),
            StructField("rejected", BooleanType()),
        ]
    )

    def run(batches: Batches) -> Batches:
        for batch in batches:
            names, scores, ambiguous, rejected = sent.value.label(batch.column(1).to_pylist())
            columns = [pa.array(names, pa.string()), pa.array(scores), pa.array(ambiguous), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    return map_batches(two_columns(docs, id_col, text_col), run, schema)


def accepted(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, with all columns, that ``predict`` does not reject; where ``lang_col`` is null it gets the predicted language."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)
    unnamed = docs.columns.index(lang_col) if lang_col in docs.columns else None

    def run(batches: Batches) -> Batches:
        for batch in batches:
            names, _, _, rejected = sent.value.label(batch.column(place).to_pylist())
            if unnamed is not None:
                given = batch.column(unnamed)
                batch = batch.set_column(unnamed, batch.schema.field(unnamed), pc.coalesce(given, pa.array(names, pa.string()).cast(given.type)))
            yield batch.filter(pa.array(~rejected))

    return map_batches(docs, run, docs.schema)
