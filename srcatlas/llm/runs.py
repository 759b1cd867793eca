"""Periodic runs of words by a dictionary of basic factors.

Many texts are laid one behind another as numbers of their words, with a number of its own behind each text. At level k
every place has the name of its basic factor, the 2^k words that start there, made from two names of the level before.
A place whose factor doesn't occur again in its text is left out from there on, since no longer factor can.

In a run of period q and at least four periods, a factor of 2^k >= q > 2^(k-1) words occurs again exactly q words
later, at most twice its own length away, and so on: successors with equal steps are arithmetic progressions, of three terms
at least. Their steps are the proposed periods. Each proposal is extended over all words that equal the word a
period later, and proposals that end up as the same run are one. A step is the distance to the next occurrence of a factor
no shorter than the step, so that the run has no smaller period.

Defined cases: a null or empty text has no words and no run; a text of one word over and over is one run of period one;
very long texts take about 60 bytes a word while they are worked on; equal rows give equal output, ties don't
arise as runs are told apart by start and period; an empty table gives an empty result; other columns aren't
read, so that their names can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from srcatlas.functions.text import bind
from srcatlas.llm.common import Batches, id_field, map_batches, texts_as_bytes, two_columns

#: Texts are worked on together up to this many words.
GROUP_WORDS = 1 << 19
#: A run has at least so many words and so many periods.
LEAST_WORDS = 6
LEAST_PERIODS = 4

RUN = StructType([StructField("start", LongType()), StructField("length", LongType()), StructField("period", LongType())])


def _named(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].reshape(-1).astype(np.int64)


def _successors(place: np.ndarray, name: np.ndarray) -> np.ndarray:
    """For each place, in rising order, the index of the next one with the same name, or -1."""
    order = np.argsort(name, kind="stable")
    nxt = np.full(len(place), -1, np.int64)
    same = np.flatnonzero(name[order[1:]] == name[order[:-1]])
    nxt[order[same]] = order[same + 1]
    return nxt


def _proposals(place: np.ndarray, nxt: np.ndarray, size: int) -> np.ndarray:
    """(first place, period) of arithmetic progressions of three terms, one for each stretch of neighbouring places."""
    step = np.where(nxt >= 0, place[nxt] - place, 0)
    again = np.where(nxt >= 0, step[nxt], 0)
    found = np.flatnonzero((step == again) & (2 * step > size) & (step <= size))
    if not len(found):
        return np.empty((0, 2), np.int64)
    at, period = place[found], step[found]
    new = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(period) != 0)])
    return np.stack([at[new], period[new]], axis=1)


def _extended(words: np.ndarray, base: np.ndarray, sizes: np.ndarray, proposals: np.ndarray) -> np.ndarray:
    """(text, start in it, length, period) of the proposed runs, each once, in that order."""
    text = np.searchsorted(base, proposals[:, 0], side="right") - 1
    order = np.lexsort((proposals[:, 1], text))
    text, places, periods = text[order], proposals[order, 0], proposals[order, 1]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(text) != 0) | (np.diff(periods) != 0)])) if len(text) else np.empty(0, np.int64)
    out = [np.empty((0, 4), np.int64)]
    for a, b in zip(new.tolist(), [*new[1:].tolist(), len(text)], strict=False):
        number, period = int(text[a]), int(periods[a])
        own = words[base[number] : base[number] + sizes[number]]
        # Between two words that differ from the word a period later lies a stretch with the period.
        differ = np.concatenate([[-1], np.flatnonzero(own[period:] != own[:-period]), [len(own) - period]])
        side = np.unique(np.searchsorted(differ, places[a:b] - base[number]))
        start = differ[side - 1] + 1
        length = differ[side] - start + period
        keep = length >= max(LEAST_WORDS, LEAST_PERIODS * period)
        runs = np.stack([np.full(len(side), number), start, length, np.full(len(side), period)], axis=1)
        out.append(runs[keep])
    runs = np.concatenate(out)
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def find_runs(lists: list[list[bytes]]) -> list[np.ndarray]:
    """(start, length, period) of all runs of each list of words, by start and period."""
    numbers: dict[bytes, int] = {}
    sizes = np.array([len(words) for words in lists], np.int64)
    base = np.cumsum(sizes + 1) - sizes - 1
    # A number of its own behind each text keeps runs inside.
    whole = np.empty(int((sizes + 1).sum()), np.int64)
    for words, start in zip(lists, base.tolist(), strict=True):
        whole[start : start + len(words)] = [numbers.setdefault(w, len(numbers)) for w in words]
    whole[base + sizes] = len(numbers) + np.arange(len(lists))
    longest = int(sizes.max(initial=0))
    place, name, size, proposed = np.arange(len(whole)), whole, 1, [np.empty((0, 2), np.int64)]
    # A level serves periods above half the size of its factors.
    while len(place) and (size // 2 + 1) * LEAST_PERIODS <= longest:
        nxt = _successors(place, name)
        proposed.append(_proposals(place, nxt, size))
        again = nxt >= 0
        again[nxt[again]] = True
        place, name = place[again], _named(name[again])
        # The factor here and the one behind it make one of the next level.
        behind = np.searchsorted(place, place + size)
        behind[behind == len(place)] = 0
        both = np.flatnonzero(place[behind] == place + size)
        name = _named(name[both] * len(whole) + name[behind[both]])
        place, size = place[both], 2 * size
    runs = _extended(whole, base, sizes, np.concatenate(proposed))
    bounds = np.searchsorted(runs[:, 0], np.arange(len(lists) + 1))
    return [runs[bounds[i] : bounds[i + 1], 1:] for i in range(len(lists))]


def _in_groups(texts: list[bytes | None]):
    """(number of the first, lists of words) of texts in a row."""
    at, held, size = 0, [], 0
    for i, text in enumerate(texts):
        held.append((text or b"").split())
        size += len(held[-1])
        if size >= GROUP_WORDS:
            yield at, held
            at, held, size = i + 1, [], 0
    if held:
        yield at, held


def _collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run holds behind its first period."""
    if not len(runs):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, n_words, runs, collapsed) of every row: runs by start and period, and the text with each run's first period only."""
    runs_type = ArrayType(RUN)
    schema = StructType([id_field(docs, id_col), StructField("n_words", LongType()), StructField("runs", runs_type), StructField("collapsed", StringType())])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for at, lists in _in_groups(texts_as_bytes(batch.column(1))):
                found = find_runs(lists)
                flat = np.concatenate(found)
                offsets = np.cumsum([0, *map(len, found)])
                parts = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], names=RUN.names)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(lists)),
                        pa.array([len(words) for words in lists], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), parts),
                        pa.array([_collapsed(words, r) for words, r in zip(lists, found, strict=True)], pa.binary()).cast(pa.string()),
                    ],
                    names=schema.names,
                )

    return map_batches(two_columns(docs, id_col, text_col), run, schema)


def longest_run(runs: Column) -> Column:
    """The run of greatest length, of equal ones that with the smallest start, then period; null without runs."""
    order = F.transform(runs, lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    return F.array_min(order)


def runs_digest(runs: Column) -> Column:
    """SHA-256 of a line ``start,length,period`` for every run."""
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in RUN.names]), F.lit("\n")))
    return F.sha2(F.array_join(lines, ""), 256)


def with_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Key and text, a tenth of the texts with their tail replaced by repeats of its beginning, chosen by the key's crc32."""
    code = F.crc32(F.col("id").cast("string"))
    g = F.floor(code / 10).cast("long")

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % F.greatest(n, F.lit(1))
        period = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")

        def word(i: Column) -> Column:
            at = F.when(i < a, i).otherwise(a + (i - a) % period)
            return F.get(words, at.cast("int"))

        changed = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), word), " ")
        return F.when(n > 0, changed).otherwise(F.lit(""))

    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    text = F.when(code % 10 == 0, bind(words, repeated)).otherwise(F.col("text"))
    return two_columns(docs, id_col, text_col).select(F.col("id").alias(id_col), text.alias(text_col))
