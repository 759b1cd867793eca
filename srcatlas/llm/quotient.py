"""Counting quotient filters: how often each fingerprint occurs, without loss.

A fingerprint of p bits is a quotient, its upper bits, and a remainder, the rest. The remainders of one quotient are a
run, kept in rising order; a quotient with a run is marked in ``occupied`` and the last slot of a run in ``run_ends``,
so that the n-th marked quotient owns the n-th run. A slot whose fingerprint occurred more than once is marked in
``counted`` and has its counter in ``counts``. Nothing of the fingerprint is thrown away: the filter gives back exactly
the fingerprints put in, and two filters are merged by merging their runs.

A table's filter is cut into blocks of quotients, so that blocks can be built where the fingerprints are and merged
apart from each other. A fingerprint with very many occurrences is one slot of each part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from srcatlas.llm.common import Batches, map_batches

#: Fingerprints that a block of the merged filter holds at most on average.
BLOCK_SLOTS = 1 << 16
#: Quotients of one block.
QUOTIENTS = 1 << 12
#: Fingerprints gathered before they are put in order; also the slots merged at once.
GATHERED = 1 << 21

_U = np.uint64

BLOCKS = StructType([StructField("block", LongType()), *[StructField(c, BinaryType()) for c in ("occupied", "run_ends", "remainders", "counted", "counts")]])


class Block(NamedTuple):
    """One block: fingerprints of ``bits`` bits, less the ``block`` number in front, in rising order with their counts."""

    values: np.ndarray
    counts: np.ndarray

    def packed(self, width: int) -> list[bytes]:
        """The slots: quotients and remainders of values of ``width`` bits."""
        low = _low_bits(width)
        quotient = (self.values >> _U(low)).astype(np.int64)
        occupied = np.zeros(QUOTIENTS, bool)
        occupied[quotient] = True
        ends = np.append(np.diff(quotient) != 0, True)[: len(quotient)]
        many = self.counts > 1
        remainder = (self.values & _U((1 << low) - 1)).astype(_remainder_type(low))
        return [np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(), remainder.tobytes(), np.packbits(many).tobytes(), self.counts[many].tobytes()]

    @staticmethod
    def unpacked(parts: list[bytes], width: int) -> Block:
        low = _low_bits(width)
        remainder = np.frombuffer(parts[2], _remainder_type(low)).astype(_U)
        n = len(remainder)
        occupied, ends, many = (np.unpackbits(np.frombuffer(parts[i], np.uint8)).astype(bool) for i in (0, 1, 3))
        # The slot's run is the number of run ends before it, the run's quotient the marked one of that number.
        run = np.cumsum(ends[:n]) - ends[:n]
        quotient = np.flatnonzero(occupied)[run].astype(_U)
        counts = np.ones(n, np.int64)
        counts[many[:n]] = np.frombuffer(parts[4], np.int64)
        return Block((quotient << _U(low)) | remainder, counts)


def _low_bits(width: int) -> int:
    return max(0, width - (QUOTIENTS.bit_length() - 1))


def _remainder_type(low: int) -> type:
    return np.uint32 if low <= 32 else np.uint64


def merged(blocks: Iterable[Block]) -> Block:
    """One block out of several: their runs merged by remainder, the counts of equal ones added."""
    blocks = list(blocks)
    values, counts = np.concatenate([b.values for b in blocks]), np.concatenate([b.counts for b in blocks])
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)
    return Block(values[first], np.add.reduceat(counts, first) if len(first) else counts)


def block_bits(rows: int, bits: int) -> int:
    """Leading bits that number the blocks of a filter for so many rows."""
    return min(bits, max(0, (max(1, rows) - 1) // BLOCK_SLOTS).bit_length())


def _cut(block: Block, lead: int, bits: int) -> Iterator[tuple[int, Block]]:
    """(block number, block) of the parts of a whole filter."""
    width = bits - lead
    number = block.values >> _U(width) if lead else np.zeros(len(block.values), _U)
    starts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if len(number) else []
    inner = block.values & _U((1 << width) - 1) if width else np.zeros(len(block.values), _U)
    for a, b in zip(starts, [*starts[1:], len(number)], strict=True):
        yield int(number[a]), Block(inner[a:b], block.counts[a:b])


def _row(number: int, block: Block, width: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([number]), *[pa.array([p], pa.binary()) for p in block.packed(width)]], names=BLOCKS.names)


def build(fingerprints: DataFrame, column: str, rows: int, bits: int = 64) -> DataFrame:
    """The merged filter of a column of fingerprints (the ``bits`` low bits of a long), one row per block.

    Filters are built per partition, cut into blocks, and the blocks of one number merged.
    """
    lead = block_bits(rows, bits)
    width = bits - lead

    def local(batches: Batches) -> Batches:
        held, waiting, size = [], [], 0
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(_U)
            waiting.append(Block(values, np.ones(len(values), np.int64)))
            size += len(values)
            if size >= GATHERED:
                held, waiting, size = [merged([*held, *waiting])], [], 0
        if held or waiting:
            for number, block in _cut(merged([*held, *waiting]), lead, bits):
                yield _row(number, block, width)

    def joined(batches: Batches) -> Batches:
        number, waiting, size = None, [], 0
        for batch in batches:
            for row, n in enumerate(batch.column(0).to_pylist()):
                if n != number and waiting:
                    yield _row(number, merged(waiting), width)
                    waiting, size = [], 0
                number = n
                waiting.append(Block.unpacked([batch.column(c)[row].as_py() for c in range(1, 6)], width))
                size += len(waiting[-1].values)
                if size >= GATHERED + BLOCK_SLOTS:
                    waiting = [merged(waiting)]
                    size = len(waiting[0].values)
        if waiting:
            yield _row(number, merged(waiting), width)

    parts = map_batches(fingerprints.select(column), local, BLOCKS)
    return map_batches(parts.repartition("block").sortWithinPartitions("block"), joined, BLOCKS)


def entries(blocks: DataFrame, rows: int, bits: int = 64, least: int = 1) -> DataFrame:
    """(fp, n): the fingerprints of a filter that occurred at least so often."""
    lead = block_bits(rows, bits)
    width = bits - lead
    schema = StructType([StructField("fp", LongType()), StructField("n", LongType())])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for row, number in enumerate(batch.column(0).to_pylist()):
                block = Block.unpacked([batch.column(c)[row].as_py() for c in range(1, 6)], width)
                keep = block.counts >= least
                front = _U(number << width) if width < 64 else _U(0)
                values = (block.values[keep] | front).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(block.counts[keep])], names=schema.names)

    return map_batches(blocks, run, schema)
