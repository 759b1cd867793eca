"""Nearest neighbours by cosine as a block matrix join.

Queries and rows are packed into blocks of bounded size, tables of a few large rows each. Query blocks are dealt over the rows
of a grid of cells and row blocks over its columns; a join on the cell brings every query block together with every row block in
exactly one task, and neither goes through the driver. The join streams: a task holds one pair of blocks, the tile, and heaps
for one query block at a time.

Of both sides of a tile the unit vectors are rounded to 8 bits, and the
tile's product of these small whole numbers, exact in single precision, gives all cosines up to
a bound that follows from the lengths of the rounding errors. Only pairs whose upper bound
reaches the fifth best lower bound so far are computed again from the original vectors in
double precision. A heap for each query keeps the best of a cell, and the cells' heaps are merged by a
top-k per query.

Equal vectors have equal scores, so of those in a block only rows of the k + 1 smallest distinct keys can matter,
one of which may be the query's own, and k rows of each; the others are left out when the block is packed.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no
part; a query is compared with vectors of its own length; ties go to the smaller key; of rows with one key
all take part as candidates but for the query's own key; rows of a repeated query key count as one query
with the least such vector; keys are whole numbers, null keys take no part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from srcatlas.llm.common import Batches
from srcatlas.session import materialize

#: Rows of a block of either side, and of a tile.
TILE_ROWS = 2048
#: Queries that are compared with a tile at once: 32 MB for each array of their pairs.
TILE_QUERIES = 2000
#: Numbers of a block, where vectors are long: 2 MB in double precision.
BLOCK_NUMBERS = 1 << 18
#: Query blocks and row blocks of a cell, or fewer: a task's work.
QUERY_BLOCKS, ROW_BLOCKS = 64, 64
#: Columns multiplied at once: products of 8-bit numbers stay exact in single precision.
EXACT_COLUMNS = 1024


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, vectors) of the usable rows, apart for each length of vector."""
    column = batch.column(1)
    ids = batch.column(0)
    sizes = np.asarray(column.value_lengths().fill_null(0))
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
    starts = np.cumsum(sizes) - sizes
    known = np.asarray(ids.is_valid())
    keys = ids.fill_null(0).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero((sizes == size) & known)
        matrix = values[starts[rows][:, None] + np.arange(size)]
        good = np.isfinite(matrix).all(axis=1) & (matrix != 0).any(axis=1)
        if good.any():
            yield keys[rows[good]].astype(np.int64), matrix[good]


class Rounded:
    """Unit vectors in 8 bits: scale times whole numbers, and the length of the error."""

    def __init__(self, matrix: np.ndarray):
        unit = matrix / np.abs(matrix).max(axis=1, keepdims=True)  # no overflow in the squares
        unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
        self.scale = np.abs(unit).max(axis=1) / 127
        self.whole = np.rint(unit / self.scale[:, None]).astype(np.int8)
        self.error = np.sqrt(((unit - self.whole * self.scale[:, None]) ** 2).sum(axis=1)) + 1e-9

    def part(self, rows: slice) -> Rounded:
        """Some of the rows."""
        out = object.__new__(Rounded)
        out.scale, out.whole, out.error = self.scale[rows], self.whole[rows], self.error[rows]
        return out

    def product(self, other: Rounded) -> tuple[np.ndarray, np.ndarray]:
        """Cosines of all pairs and how far they may be off."""
        total = np.zeros((len(self.whole), len(other.whole)))
        for at in range(0, self.whole.shape[1], EXACT_COLUMNS):
            part = slice(at, at + EXACT_COLUMNS)
            total += self.whole[:, part].astype(np.float32) @ other.whole[:, part].astype(np.float32).T
        cosine = total * self.scale[:, None] * other.scale[None, :]
        off = self.error[:, None] + other.error[None, :] + self.error[:, None] * other.error[None, :]
        return cosine, off


def cosines(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows, sums taken from the first component to the last."""
    dot, a, b = np.zeros(len(left)), np.zeros(len(left)), np.zeros(len(left))
    for i in range(left.shape[1]):
        dot += left[:, i] * right[:, i]
        a += left[:, i] * left[:, i]
        b += right[:, i] * right[:, i]
    return dot / (np.sqrt(a) * np.sqrt(b))


def few_copies(keys: np.ndarray, matrix: np.ndarray, k: int) -> np.ndarray:
    """Rows without copies of a vector beyond its k + 1 smallest distinct keys, k rows of each."""
    rows = np.ascontiguousarray(matrix + 0.0).view(np.dtype((np.void, matrix.shape[1] * 8))).ravel()
    _, same = np.unique(rows, return_inverse=True)
    order = np.lexsort((keys, same))
    vector, key = same[order], keys[order]
    other = np.diff(vector, prepend=-1) != 0
    new = other | np.concatenate([[True], key[1:] != key[:-1]])
    at, number = np.arange(len(order)), np.cumsum(new)
    of_key = at - np.flatnonzero(new)[number - 1]
    of_vector = number - number[other][np.cumsum(other) - 1]
    return order[(of_vector <= k) & (of_key < k)]


class Best:
    """The k best of each query of one length, in heaps."""

    def __init__(self, keys: np.ndarray, matrix: np.ndarray, k: int):
        self.keys, self.matrix, self.k = keys, matrix, k
        self.rounded = Rounded(matrix)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in keys]
        self.bar = np.full(len(keys), -np.inf)

    def add(self, keys: np.ndarray, matrix: np.ndarray) -> None:
        """Compare the queries with a block of rows."""
        for at in range(0, len(keys), TILE_ROWS):
            tile = slice(at, at + TILE_ROWS)
            rounded = Rounded(matrix[tile])
            for first in range(0, len(self.keys), TILE_QUERIES):
                self._tile(first, keys[tile], matrix[tile], rounded)

    def _tile(self, first: int, keys: np.ndarray, matrix: np.ndarray, rounded: Rounded) -> None:
        """Compare ``TILE_QUERIES`` queries from the ``first`` with the rows of a tile."""
        some = slice(first, first + TILE_QUERIES)
        cosine, off = self.rounded.part(some).product(rounded)
        own = self.keys[some, None] == keys[None, :]
        low = np.where(own, -np.inf, cosine - off)
        bar = self.bar[some]
        if low.shape[1] >= self.k:
            bar = np.maximum(bar, np.partition(low, -self.k, axis=1)[:, -self.k])
        query, row = np.nonzero((cosine + off >= bar[:, None]) & ~own)
        query += first
        for part in range(0, len(query), 1 << 16):
            q, r = query[part : part + (1 << 16)], row[part : part + (1 << 16)]
            scores = cosines(self.matrix[q], matrix[r])
            for i, score, key in zip(q.tolist(), scores.tolist(), keys[r].tolist(), strict=True):
                heap = self.heaps[i]
                if len(heap) < self.k:
                    heapq.heappush(heap, (score, -key))
                elif heap[0] < (score, -key):
                    heapq.heapreplace(heap, (score, -key))
        for i in np.unique(query).tolist():
            if len(self.heaps[i]) == self.k:
                # A bound on doubles that may differ in the last place.
                self.bar[i] = max(self.bar[i], self.heaps[i][0][0] - 1e-9)


def _usable(vector: Column) -> Column:
    """Whether a vector has components, all of them finite and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


BLOCK = "block bigint, size int, ids binary, vectors binary"


def _packed(vectors: DataFrame, k: int | None = None) -> DataFrame:
    """(block, size, ids, vectors): rows (id, vector) of a task in blocks of vectors of one length.

    With ``k``, copies of a vector that can't be among any query's k nearest are left out.
    """

    def run(batches: Batches) -> Batches:
        number = TaskContext.get().partitionId() << 32
        open_: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        held = 0

        def block(size: int) -> pa.RecordBatch:
            nonlocal number
            parts = open_.pop(size)
            keys, matrix = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            if k is not None:
                taken = few_copies(keys, matrix, k)
                keys, matrix = keys[taken], matrix[taken]
            number += 1
            values = [[number - 1], [size], [keys.tobytes()], [np.ascontiguousarray(matrix).tobytes()]]
            types = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=["block", "size", "ids", "vectors"])

        for batch in batches:
            for keys, matrix in _vectors(batch):
                size = matrix.shape[1]
                most = max(1, min(TILE_ROWS, BLOCK_NUMBERS // size))
                at = 0
                while at < len(keys):
                    parts = open_.setdefault(size, [])
                    room = most - sum(len(p[0]) for p in parts)
                    parts.append((keys[at : at + room], matrix[at : at + room]))
                    held += parts[-1][1].size
                    at += room
                    if sum(len(p[0]) for p in parts) == most:
                        held -= most * size
                        yield block(size)
            if held > 4 * BLOCK_NUMBERS:  # many lengths
                for size in list(open_):
                    yield block(size)
                held = 0
        for size in list(open_):
            yield block(size)

    return vectors.mapInArrow(run, BLOCK)


def _array(batch: pa.RecordBatch, name: str, row: int, kind: type) -> np.ndarray:
    return np.frombuffer(batch[name][row].as_buffer(), kind)


def nearest(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, key, score): each query's k nearest rows but itself, rank from 1."""
    key = F.col(id_col).cast("long").alias("id")
    vector = F.col(vector_col).cast("array<double>").alias("vector")
    vectors = rows.select(key, vector)
    asked = rows.where(is_query).select(key, vector).where(F.col("id").isNotNull() & _usable(F.col("vector")))
    queries = materialize(_packed(asked.groupBy("id").agg(F.min("vector").alias("vector"))), "query-blocks")
    # The grid: its size follows from how many blocks there are, so that a cell's work is bounded.
    down = max(1, -(-queries.count() // QUERY_BLOCKS))
    across = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // (TILE_ROWS * ROW_BLOCKS)))
    place = F.xxhash64("block")
    left = queries.select(
        "size", F.pmod(place, F.lit(down)).alias("down"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("across"),
        F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"),
    )
    right = _packed(vectors, k).select(
        "size", F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("down"), F.pmod(place, F.lit(across)).alias("across"), "ids", "vectors"
    )
    cell = ["size", "down", "across"]
    tasks = down * across
    whole = [F.col(c).cast("bigint").alias(c) if c != "size" else F.col(c) for c in cell]
    left = left.select(*whole, "q_block", "q_ids", "q_vectors").repartition(tasks, *cell)
    right = right.select(*whole, "ids", "vectors").repartition(tasks, *cell)
    # Merged, a query block meets all row blocks of its cell one after another.
    tiles = left.hint("merge").join(right, cell).select("q_block", "size", "q_ids", "q_vectors", "ids", "vectors")
    schema = StructType(
        [StructField("query_id", LongType()), StructField(id_col, LongType()), StructField("score", DoubleType())]
    )

    def run(batches: Batches) -> Batches:
        best, block = None, None
        for batch in batches:
            for row, number in enumerate(batch["q_block"].to_pylist()):
                size = batch["size"][row].as_py()
                if number != block:
                    if best is not None:
                        yield from _heaps(best, schema.names)
                    queries = _array(batch, "q_vectors", row, np.float64).reshape(-1, size).copy()
                    best, block = Best(_array(batch, "q_ids", row, np.int64).copy(), queries, k), number
                best.add(_array(batch, "ids", row, np.int64), _array(batch, "vectors", row, np.float64).reshape(-1, size))
        if best is not None:
            yield from _heaps(best, schema.names)

    found = tiles.mapInArrow(run, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", id_col, "score")


def _heaps(best: Best, names: list[str]) -> Iterator[pa.RecordBatch]:
    """(query, key, score) of all heaps."""
    out = [(q, -n, s) for q, heap in zip(best.keys.tolist(), best.heaps, strict=True) for s, n in heap]
    if out:
        q, n, s = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(n, pa.int64()), pa.array(s, pa.float64())], names=names)
