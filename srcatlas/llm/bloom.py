"""A filter of bounded size for a table of 64-bit hashes; only ever a means to send less.

The filter consists of blocks; a hash belongs to one block and sets three bits there. Blocks are filled where
the hashes are and only the finished ones come to the driver, at most ``MAX_BLOCKS`` of them. With more hashes
than that serves, more foreign ones pass it; callers must be right whatever passes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from srcatlas.llm.common import Batches, map_batches

BLOCK_BITS = 1 << 19
BITS_PER_HASH = 12
#: 32 MB.
MAX_BLOCKS = 512


def _bits(hashes: np.ndarray) -> list[np.ndarray]:
    mixed = hashes * np.uint64(0xFF51AFD7ED558CCD)
    return [((mixed >> np.uint64(s)) & np.uint64(BLOCK_BITS - 1)).astype(np.int64) for s in (45, 26, 7)]


def _block(hashes: np.ndarray, blocks: int) -> np.ndarray:
    return (hashes >> np.uint64(33)).astype(np.int64) % blocks


class Bloom:
    """The filter as one array of bytes."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.blocks = max(1, len(data) * 8 // BLOCK_BITS)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each hash may be in the table; never wrong about one that is."""
        if not len(self.data):
            return np.zeros(len(hashes), bool)
        base = _block(hashes, self.blocks) * BLOCK_BITS
        found = np.ones(len(hashes), bool)
        for bit in _bits(hashes):
            at = base + bit
            found &= (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 != 0
        return found


def build(hashes: DataFrame, column: str) -> Bloom:
    """The filter of a column of signed 64-bit hashes."""
    count = hashes.count()
    if not count:
        return Bloom(np.zeros(0, np.uint8))
    blocks = min(MAX_BLOCKS, -(-count * BITS_PER_HASH // BLOCK_BITS))
    schema = StructType([StructField("block", IntegerType()), StructField("data", BinaryType())])

    def run(batches: Batches) -> Batches:
        filled: dict[int, np.ndarray] = {}
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            owner = _block(values, blocks)
            bits = np.stack(_bits(values))
            for block in np.unique(owner).tolist():
                data = filled.setdefault(block, np.zeros(BLOCK_BITS // 8, np.uint8))
                own = bits[:, owner == block].ravel()
                np.bitwise_or.at(data, own >> 3, np.left_shift(1, own & 7).astype(np.uint8))
        for block, data in filled.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([data.tobytes()])], names=schema.names)

    # Dealt so that a block is filled by one task.
    owner = F.expr(f"shiftrightunsigned({column}, 33) % {blocks}")
    parts = map_batches(hashes.select(F.col(column)).repartition(min(blocks, 64), owner), run, schema)
    out = np.zeros((blocks, BLOCK_BITS // 8), np.uint8)
    for row in parts.toLocalIterator():
        out[row.block] |= np.frombuffer(row.data, np.uint8)
    return Bloom(out.ravel())


def narrowed(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows whose ``column`` may be among that of ``keys``, with all columns; filtered where they are read.

    A join of what is left then moves few foreign rows.
    """
    hashed = build(keys.select(F.xxhash64(column).alias("hash")), "hash")
    sent = rows.sparkSession.sparkContext.broadcast(hashed)
    marked = rows.select(F.xxhash64(column).alias("__hash"), *rows.columns)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            keep = sent.value.holds(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            yield batch.filter(pa.array(keep))

    return map_batches(marked, run, marked.schema).drop("__hash")
