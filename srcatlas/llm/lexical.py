"""Ranked lexical search: MaxScore with bounds of single terms and of term pairs.

1. The items' distinct terms are read in blocks of a bounded size; each block is searched in one pass over the
   documents, whose postings for the block's terms are written once. Document frequencies, the number of documents and
   their length come from these postings, and from them the terms' weights.
2. The postings are inverted by segments of documents and written as an index. A segment has the places and impact factors of
   every term and, per chunk of documents, the greatest impact; for each pair of terms that are neighbours by weight
   in an item it has the intersection list: the chunks in which documents hold both, with the greatest joint impact.
3. For an item the terms are put in rising order of weight. The bound of the first j + 1 terms is the less of the bound of j
   and the next term's impact, and of the bound of j - 1 and the pair's bound, which is the joint impact or, where
   larger, that of one of the two alone. Chunks whose bound stays under the k-th best score so far are skipped;
   elsewhere only terms that lift the bound to that score bring documents in, the others only add to
   documents that can still reach it. Documents are dropped if their bound is less, so that ties are kept.
4. Each task holds k documents an item; the best of all are ranked. A first round over a few segments gives a score that
   k documents reach, from which the tasks start.

A document is known by its row: equal rows are documents of their own.

Defined cases: a null or empty text has no terms, isn't counted as a document and never found; items without terms have no
result; rows of one item key, null among them, are one item; equal scores are ranked by rising document key, a null key
last; very long texts are held one batch at a time; without items, documents or common terms the result is empty;
other columns aren't read, so that their names can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    IntegerType,
    LongType,
    StructField,
    StructType,
)

from srcatlas.llm.common import Batches, id_field, map_batches, texts_as_bytes, two_columns
from srcatlas.session import materialize

#: Pairs of item and term searched in one pass; a block ends with a whole item.
BLOCK_TERMS = 200_000
#: Documents of a segment and of a chunk.
SEGMENT = 4096
CHUNK = 128
CHUNKS = SEGMENT // CHUNK
#: Segments of the first round.
FIRST_SEGMENTS = 2

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Digits, letters and everything beyond U+007F, A-Z in lower case."""
    return text.translate(_TABLE).split()


class Items(NamedTuple):
    """A block of items: keys, each item's term numbers, and the terms."""

    keys: list
    terms: list[list[int]]
    vocabulary: list[bytes]


def item_blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[Items]:
    """The items with their distinct terms, in blocks of a bounded size."""
    lower = F.translate(F.col(text_col).cast("string"), _UPPER, _LOWER)
    pairs = items.select(F.col(item_col).alias("item"), F.explode(F.regexp_extract_all(lower, F.lit(_TERM), F.lit(0))).alias("term"))
    keys, terms, numbers, size = [], [], {}, 0
    for row in pairs.distinct().orderBy("item", "term").toLocalIterator():
        if not keys or row.item != keys[-1]:
            if size >= BLOCK_TERMS:
                yield Items(keys, terms, list(numbers))
                keys, terms, numbers, size = [], [], {}, 0
            keys.append(row.item)
            terms.append([])
        terms[-1].append(numbers.setdefault(row.term.encode(), len(numbers)))
        size += 1
    if keys:
        yield Items(keys, terms, list(numbers))


def postings(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(id, n, terms, counts) of every row of (id, text) with a term: its length and how often it holds each term of the vocabulary."""
    whole = ArrayType(IntegerType())
    schema = StructType([docs.schema["id"], StructField("n", LongType()), StructField("terms", whole), StructField("counts", whole)])
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Batches) -> Batches:
        number = {term: i for i, term in enumerate(sent.value)}
        for batch in batches:
            rows, sizes, terms, counts = [], [], [], []
            for row, text in enumerate(texts_as_bytes(batch.column(1))):
                words = terms_of(text or b"")
                if words:
                    own, times = np.unique(np.array([i for w in words if (i := number.get(w)) is not None], np.int32), return_counts=True)
                    rows.append(row)
                    sizes.append(len(words))
                    terms.append(own)
                    counts.append(times.astype(np.int32))
            offsets = pa.array(np.cumsum([0, *map(len, terms)]), pa.int32())
            flat = [pa.array(np.concatenate(x) if x else np.empty(0, np.int32)) for x in (terms, counts)]
            lists = [pa.ListArray.from_arrays(offsets, x) for x in flat]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()), *lists], names=schema.names)

    return map_batches(docs, run, schema)


class Plan:
    """What an item block needs where the index is built and read."""

    def __init__(self, items: Items, documents: int, length: int, frequency: dict[int, int], k: int):
        self.documents, self.length, self.k = documents, length, k
        self.weight = np.zeros(len(items.vocabulary), np.int64)
        for term, df in frequency.items():
            self.weight[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
        #: Of each item the terms by rising weight and the numbers of the pairs of neighbours.
        self.terms, self.pairs = [], []
        #: Number of each pair of terms.
        self.number: dict[tuple[int, int], int] = {}
        for terms in items.terms:
            own = sorted((t for t in terms if self.weight[t] > 0), key=lambda t: (self.weight[t], t))
            self.terms.append(np.array(own, np.int64))
            self.pairs.append(np.array([self.number.setdefault(p, len(self.number)) for p in zip(own, own[1:], strict=False)], np.int64))
        self.keys = items.keys
        #: A score that k documents of each item reach.
        self.reached = np.zeros(len(self.keys), np.int64)

    def factors(self, n: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """What a term's weight is multiplied by in documents of n terms that hold it so often."""
        m = 50 + (50 * n * self.documents) // self.length
        return (1_000_000_000 * counts) // (1000 * counts + 20 * m)


_BLOBS = ("terms", "ends", "places", "factors", "pairs", "chunks", "joint")


def index(posted: DataFrame, plan) -> DataFrame:
    """One row per segment: (ids, terms, ends, places, factors, pairs, chunks, joint).

    ``terms`` have their postings in ``places`` and ``factors`` up to ``ends``; ``joint`` is the greatest impact of a pair in a chunk.
    """
    schema = StructType([StructField("ids", ArrayType(posted.schema["id"].dataType)), *[StructField(b, BinaryType()) for b in _BLOBS]])

    def run(batches: Batches) -> Batches:
        partners: dict[int, list[tuple[int, int]]] = {}
        for (a, b), number in plan.value.number.items():
            partners.setdefault(a, []).append((b, number))
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            while size >= SEGMENT:
                table = pa.Table.from_batches(held).combine_chunks()
                yield _segment(table.slice(0, SEGMENT), plan.value, partners, schema.names)
                held = table.slice(SEGMENT).to_batches()
                size -= SEGMENT
        if size:
            yield _segment(pa.Table.from_batches(held).combine_chunks(), plan.value, partners, schema.names)

    return map_batches(posted, run, schema)


def _flat(table: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    lists = table.column(column).combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()


def _segment(table: pa.Table, plan: Plan, partners: dict, names: list[str]) -> pa.RecordBatch:
    sizes, terms = _flat(table, "terms")
    counts = _flat(table, "counts")[1].astype(np.int64)
    place = np.repeat(np.arange(len(sizes)), sizes)
    factor = plan.factors(table.column("n").to_numpy()[place], counts)
    order = np.argsort(terms, kind="stable")
    terms, place, factor = terms[order], place[order], factor[order]
    own, starts = np.unique(terms, return_index=True)
    ends = np.append(starts, len(terms))[1:].astype(np.int64)
    impact = factor * plan.weight[terms]
    at = {t: slice(a, b) for t, a, b in zip(own.tolist(), starts.tolist(), ends.tolist(), strict=True)}
    keys, joint = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for a, others in partners.items():
        others = [(at[b], number) for b, number in others if b in at] if a in at else []
        if not others:
            continue
        mine = np.zeros(SEGMENT, np.int64)
        holds = np.zeros(SEGMENT, bool)
        mine[place[at[a]]] = impact[at[a]]
        holds[place[at[a]]] = True
        theirs = np.concatenate([place[s] for s, _ in others])
        pair = np.repeat([number for _, number in others], [s.stop - s.start for s, _ in others])
        both = holds[theirs]
        keys.append((pair * CHUNKS + theirs // CHUNK)[both])
        joint.append((mine[theirs] + np.concatenate([impact[s] for s, _ in others]))[both])
    keys, joint = np.concatenate(keys), np.concatenate(joint)
    order = np.argsort(keys, kind="stable")
    keys, joint = keys[order], joint[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    joint = np.maximum.reduceat(joint, first) if len(first) else joint
    blobs = [
        own.astype(np.int32), ends.astype(np.int32), place.astype(np.uint16), factor.astype(np.int32),
        (keys[first] // CHUNKS).astype(np.int32), (keys[first] % CHUNKS).astype(np.uint8), joint,
    ]
    ids = table.column("id").combine_chunks()
    ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
    listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    return pa.RecordBatch.from_arrays([listed, *[pa.array([b.tobytes()], pa.binary()) for b in blobs]], names=names)


class Segment:
    """A segment as it is searched."""

    def __init__(self, blobs: list[bytes], plan: Plan):
        types = (np.int32, np.int32, np.uint16, np.int32, np.int32, np.uint8, np.int64)
        terms, ends, place, factor, pairs, chunks, joint = (np.frombuffer(b, t) for b, t in zip(blobs, types, strict=True))
        starts = np.concatenate([[0], ends])[:-1].astype(np.int64)
        self.place = place.astype(np.int64)
        self.impact = factor * np.repeat(plan.weight[terms], ends - starts)
        #: The last row is that of terms that don't occur.
        self.row = np.full(len(plan.weight), len(terms), np.int64)
        self.row[terms] = np.arange(len(terms))
        self.bounds = list(zip(starts.tolist(), ends.tolist(), strict=True)) + [(0, 0)]
        self.greatest = np.zeros((len(terms) + 1, CHUNKS), np.int64)
        np.maximum.at(self.greatest, (np.repeat(np.arange(len(terms)), ends - starts), self.place // CHUNK), self.impact)
        self.joint = np.zeros((len(plan.number), CHUNKS), np.int64)
        self.joint[pairs, chunks] = joint

    def bound(self, rows: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """Greatest scores of the first j terms in each chunk, for every j."""
        single = self.greatest[rows]
        out = np.zeros((len(rows) + 1, CHUNKS), np.int64)
        if len(rows):
            out[1] = single[0]
        double = np.maximum(self.joint[pairs], np.maximum(single[:-1], single[1:])) if len(pairs) else None
        for j in range(1, len(rows)):
            np.minimum(out[j] + single[j], out[j - 1] + double[j - 1], out=out[j + 1])
        return out

    def search(self, terms: np.ndarray, pairs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, score) of the documents that score ``least`` or more."""
        rows = self.row[terms]
        bound = self.bound(rows, pairs)
        if not len(rows) or not (bound[-1] >= least).any():
            return np.empty(0, np.int64), np.empty(0, np.int64)
        score = np.zeros(SEGMENT, np.int64)
        in_play = np.zeros(SEGMENT, bool)
        chunk = np.arange(SEGMENT) // CHUNK
        for j in range(len(rows) - 1, -1, -1):
            a, b = self.bounds[rows[j]]
            if a < b:
                place = self.place[a:b]
                # Terms that lift the bound to the least score bring documents in.
                brings = bound[j + 1] >= least
                if not brings.all():
                    taken = brings[place // CHUNK] | in_play[place]
                    place = place[taken]
                    score[place] += self.impact[a:b][taken]
                else:
                    score[place] += self.impact[a:b]
                in_play[place] = True
            if not (bound[j] >= least).all():
                in_play &= score + bound[j][chunk] >= least
                if not in_play.any() and not (bound[j] >= least).any():
                    break
        found = np.flatnonzero(in_play & (score >= least))
        return found, score[found]


class Best:
    """The k best documents of one item, seen so far."""

    def __init__(self, k: int, least: int):
        self.k, self.least = k, max(1, least)
        self.rows: list[tuple] = []

    def add(self, places: np.ndarray, scores: np.ndarray, ids: pa.Array) -> None:
        if len(places) > self.k:
            # Ties at the last place are told apart by key.
            keep = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            places, scores = places[keep], scores[keep]
        found = [(-s, i is None, i) for s, i in zip(scores.tolist(), ids.take(pa.array(places)).to_pylist(), strict=True)]
        self.rows = sorted([*self.rows, *found], key=lambda r: r if not r[1] else (*r[:2], 0))[: self.k]
        if len(self.rows) == self.k:
            self.least = max(self.least, -self.rows[-1][0])


def _found(indexed: DataFrame, plan, item_field: StructField, id_type) -> DataFrame:
    """(item, id, score): the best documents of every item in each task."""
    schema = StructType([item_field, StructField("id", id_type), StructField("score", LongType())])

    def run(batches: Batches) -> Batches:
        p = plan.value
        best = [Best(p.k, least) for least in p.reached.tolist()]
        for batch in batches:
            for row in range(len(batch)):
                ids = batch.column(0)[row].values
                segment = Segment([batch.column(c)[row].as_py() for c in range(1, 8)], p)
                for terms, pairs, own in zip(p.terms, p.pairs, best, strict=True):
                    places, scores = segment.search(terms, pairs, own.least)
                    if len(places):
                        own.add(places, scores, ids)
        out = [(key, r[2], -r[0]) for key, own in zip(p.keys, best, strict=True) for r in own.rows]
        types = [to_arrow_type(f.dataType) for f in schema.fields]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=schema.names)

    return map_batches(indexed, run, schema)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def search(
    docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id"
) -> DataFrame:
    """(item, rank, key, score): the k best rows of ``docs`` for every item, as far as they score above 0."""
    spark = docs.sparkSession
    texts = two_columns(docs, id_col, text_col)
    item_field = id_field(items, item_col, "item")
    id_type = docs.schema[id_col].dataType
    found = spark.createDataFrame([], StructType([item_field, StructField("id", id_type), StructField("score", LongType())]))
    for block in item_blocks(items, item_col, text_col):
        posted = materialize(postings(texts, block.vocabulary), "postings")
        documents, length = posted.agg(F.count("*"), F.sum("n")).first()
        # As many rows as the block has terms.
        frequency = {r.term: r.n for r in posted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}
        plan = Plan(block, documents, length or 1, frequency, k)
        indexed = materialize(index(posted, spark.sparkContext.broadcast(plan)), "index")
        first = _found(indexed.limit(FIRST_SEGMENTS), spark.sparkContext.broadcast(plan), item_field, id_type)
        reached = _ranked(first, k).where(F.col("rank") == k).select("item", "score").collect()
        place = {key: i for i, key in enumerate(plan.keys)}
        for row in reached:
            plan.reached[place[row.item]] = row.score
        found = found.unionByName(_found(indexed, spark.sparkContext.broadcast(plan), item_field, id_type))
    ranked = _ranked(found, k)
    return ranked.select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
