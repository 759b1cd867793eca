"""Hashed features of whole texts, computed for many texts in one go."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Places up to this are cut in each partition before rows are shuffled for a window.
EARLY_CUT = "spark.sql.optimizer.windowGroupLimitThreshold"
#: Parts of a group that are cut apart.
SALTS = 64
#: Characters of texts that are looked at together.
GROUP_CHARS = 1 << 19

_U = np.uint64
_STEP = _U(0x9FB21C651E98DF25)
_INVERSE = _U(pow(int(_STEP), -1, 1 << 64))


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values."""
    values = (values ^ (values >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return values ^ (values >> _U(32))


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def groups(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Texts in a row of a bounded size, a longer one alone, with the number of the first."""
    at, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if i > at and size + n > GROUP_CHARS:
            yield at, [t or "" for t in texts[at:i]]
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, [t or "" for t in texts[at:]]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of the texts with a line feed behind each, and the text that each belongs to."""
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return points, np.repeat(np.arange(len(texts)), sizes)


class Words:
    """Words of one kind of character in many texts, and hashes of their beginnings."""

    def __init__(self, points: np.ndarray, owner: np.ndarray, inside: np.ndarray):
        edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.owner = owner[self.starts]
        self.sizes = self.ends - self.starts
        values = mix((points.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15))
        n = len(points)
        powers = np.concatenate([[_U(1)], np.cumprod(np.full(n, _STEP, _U), dtype=_U)])
        self._sums = np.concatenate([np.zeros(1, _U), np.cumsum(values * powers[:n], dtype=_U)])
        self._down = np.concatenate([[_U(1)], np.cumprod(np.full(n, _INVERSE, _U), dtype=_U)])

    def hashes(self, longest: int | None = None) -> np.ndarray:
        """A hash of each word, or of its first ``longest`` characters."""
        ends = self.ends if longest is None else np.minimum(self.ends, self.starts + longest)
        return mix((self._sums[ends] - self._sums[self.starts]) * self._down[self.starts])


def smallest(rows: DataFrame, id_col: str, group: str, bound: int) -> DataFrame:
    """(key, group): at most ``bound`` distinct keys of each group, those with the least hash.

    Each partition keeps ``bound`` keys of a group and salt, then each salt, so that no task reads a whole group.
    """
    conf = rows.sparkSession.conf
    if int(conf.get(EARLY_CUT)) < bound:
        conf.set(EARLY_CUT, str(bound))
    least = [F.xxhash64(id_col), F.col(id_col)]
    ranked = rows.select(id_col, group).distinct().withColumn("salt", F.pmod(F.xxhash64(id_col), F.lit(SALTS)))
    for groups_of in ([group, "salt"], [group]):
        ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy(*groups_of).orderBy(*least))).where(F.col("place") <= bound)
    return ranked.select(id_col, group)


def one_text_each(rows: DataFrame) -> DataFrame:
    """Of rows (id, text, others) one for each value of all columns but ``text``: the text with the least hash."""
    least = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least")
    return rows.groupBy(*[c for c in rows.columns if c != "text"]).agg(least).select(*[F.col("least.text") if c == "text" else c for c in rows.columns])
