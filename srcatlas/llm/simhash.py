"""SimHash near-dedup: fingerprints of word shingles, linked at few differing bits.

Candidate search is fuzzy hashing with the binary Golay code of length 23. Each 23-bit
word lies at most 3 bits from exactly one codeword. Its keys are that codeword and, at a
distance of 3, also the five codewords at a distance of 4. Two words that differ in at most
2 bits always have a key in common.

A fingerprint is cut into segments of 22, 21 and 21 bits. Two differing bits leave one
segment intact, and of the intact segments one is followed (in a ring) by a segment with at
most one differing bit. So the key of a join is an intact segment and a codeword of the
segment behind it: about 16 keys of 33 bits for each distinct fingerprint. Candidates are
then verified by counting the bits in which they differ.

A bucket with many fingerprints isn't paired out. Two fingerprints differ in at most two
bits exactly if a third value lies at most one bit from either, so such fingerprints are
gathered by these values: at most 65 fingerprints can lie around one value, and tying each
to the smallest gives the same components.

Defined cases: a null text and a text without words have fingerprint zero, linked like any
other; a text with fewer words than a shingle is one shingle; repeated rows keep their own
output row; a null key is never a component's name, unless all keys in it are null; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from xxhash import xxh64_intdigest

from srcatlas.llm.common import Batches, id_field, map_batches, restored, texts_as_bytes, two_columns, with_others
from srcatlas.llm.components import connected_components
from srcatlas.session import materialize

#: Seed of the shingle hash, as in Spark's own xxhash64.
SEED = 42
#: First bit and number of bits of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Buckets up to this size are paired out.
PAIRED = 16
#: The generator polynomial of the code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
_BLOCK = 1 << 16


def words(text: bytes) -> list[bytes]:
    """Words between blanks and U+0009 to U+000D, with A-Z in lower case."""
    return text.lower().split()


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """Hashes of all shingles, repeats included."""
    found = words(text)
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    if len(found) <= size:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(found) - size + 1].tolist()
    digest = xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: bytes | None, size: int) -> int:
    """A bit is set if it is set in over half of the shingles' hashes."""
    hashes = shingle_hashes(text or b"", size)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        block = hashes[at : at + _BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, fp): the 64 bits as a signed number, for every row."""
    schema = StructType([id_field(docs, id_col), StructField("fp", LongType())])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            found = [fingerprint(text, size) for text in texts_as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=schema.names)

    return map_batches(two_columns(docs, id_col, text_col), run, schema)


class Golay:
    """Tables of the code, made from its polynomial."""

    def __init__(self):
        single = np.arange(23)
        patterns = [0, *(1 << single).tolist()]
        patterns += [(1 << a) | (1 << b) for a in range(23) for b in range(a)]
        patterns += [(1 << a) | (1 << b) | (1 << c) for a in range(23) for b in range(a) for c in range(b)]
        patterns = np.array(patterns, np.int64)
        #: The error of least weight for each remainder.
        self.error = np.zeros(2048, np.int64)
        self.error[self.remainder(patterns)] = patterns
        codewords = np.arange(4096, dtype=np.int64) << 11
        codewords |= self.remainder(codewords)
        seven = codewords[np.bitwise_count(codewords) == 7]
        #: For remainders with an error of weight 3, the five codewords of weight 7 that cover it.
        self.covers = np.zeros((2048, 5), np.int64)
        self.three = np.bitwise_count(self.error) == 3
        for r in np.flatnonzero(self.three).tolist():
            self.covers[r] = seven[(seven & self.error[r]) == self.error[r]]

    @staticmethod
    def remainder(values: np.ndarray) -> np.ndarray:
        """Values of 23 bits modulo the generator."""
        left = values.copy()
        for bit in range(22, 10, -1):
            left ^= ((left >> bit) & 1) * (GENERATOR << (bit - 11))
        return left

    def keys(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, codeword index) of every key of the values."""
        rest = self.remainder(values)
        nearest = values ^ self.error[rest]
        far = np.flatnonzero(self.three[rest])
        others = nearest[far, None] ^ self.covers[rest[far]]
        return np.concatenate([np.arange(len(values)), np.repeat(far, 5)]), np.concatenate([nearest, others.ravel()]) >> 11


def golay_keys(prints: DataFrame) -> DataFrame:
    """(key, fp): the join keys of distinct fingerprints."""
    schema = StructType([StructField("key", LongType()), StructField("fp", LongType())])

    def run(batches: Batches) -> Batches:
        code = Golay()
        for batch in batches:
            bits = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            parts = [((bits >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
            for i, intact in enumerate(parts):
                at, index = code.keys(parts[(i + 1) % len(parts)])
                key = (np.int64(i) << 34) | (intact[at] << 12) | index
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(bits.view(np.int64)[at])], names=schema.names)

    return map_batches(prints.select("fp"), run, schema)


def links(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """(u, v): links that connect distinct fingerprints at ``max_bits`` or fewer differing bits, at most 2.

    Not all pairs, but the components are those of all pairs.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("the keys serve up to two differing bits")
    keyed = golay_keys(prints)
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(keyed.join(sizes, "key"), "keys")
    few = shared.where(F.col("n") <= PAIRED).select("key", "fp")
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits
    paired = few.withColumnRenamed("fp", "u").join(few.withColumnRenamed("fp", "v"), "key").where((F.col("u") < F.col("v")) & near)
    many = shared.where(F.col("n") > PAIRED).select("fp").distinct()
    return paired.select("u", "v").unionByName(_dense_links(many, max_bits)).distinct()


def _dense_links(prints: DataFrame, max_bits: int) -> DataFrame:
    """Links for fingerprints of large buckets, found by values one bit away instead of by pairs."""
    beside = F.expr("explode(transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")
    if max_bits == 2:
        values = prints.select("fp", beside.alias("value")).unionByName(prints.select("fp", F.col("fp").alias("value")))
        # At most 65 fingerprints lie around a value.
        around = values.groupBy("value").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
        return around.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")).where("u < v")
    if max_bits == 1:
        return prints.select(F.col("fp").alias("u"), beside.alias("v")).where("u < v").join(prints.withColumnRenamed("fp", "v"), "v").select("u", "v")
    return prints.select(F.col("fp").alias("u"), F.col("fp").alias("v")).where("false")


def _labelled(docs: DataFrame, shingle: int, max_bits: int, id_col: str, text_col: str) -> DataFrame:
    """(key, fp, component, component_id) for every row; ``component`` is a fingerprint that tells components apart."""
    prints = materialize(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min(id_col).alias("least"))
    found = connected_components(links(nodes, max_bits)).withColumnRenamed("node", "fp")
    joined = nodes.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    names = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = joined.join(names, "component").select("fp", "component", "component_id")
    return prints.join(labels, "fp").select(id_col, "fp", "component", "component_id")


def near_duplicates(
    docs: DataFrame, shingle: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(key, fp, component_id) for every row; the component's name is the smallest key that can be reached."""
    return _labelled(docs, shingle, max_bits, id_col, text_col).select(id_col, "fp", "component_id")


def deduplicate(
    docs: DataFrame, shingle: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row of ``docs`` for each component, that with the smallest key, with all columns.

    Rows with a null key take part in linking but all stay, since nothing tells them apart. Of rows of a component with
    one key, that with the least fingerprint stays, then with the least hash of its text, text and other columns; rows with
    one key in several components may each stay for their own.
    """
    found = materialize(_labelled(docs, shingle, max_bits, id_col, text_col), "components")
    own = F.col(id_col) == F.col("component_id")
    keys = found.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("rows"), F.count_if(own).alias("named")).where("named > 0")
    once, more = (keys.where(c).select(id_col) for c in ("rows = 1", "rows > 1"))
    kept = docs.join(once.hint("shuffle_hash"), id_col, "left_semi").select(docs.columns)
    if not more.isEmpty():
        least = found.where(own).groupBy("component", F.col(id_col).alias("id")).agg(F.min("fp").alias("print")).select("id", "print")
        kept = kept.unionByName(_one_of_each(docs.join(more.hint("shuffle_hash"), id_col, "left_semi").select(docs.columns), least, shingle, id_col, text_col))
    return kept.unionByName(docs.where(F.col(id_col).isNull()))


def _one_of_each(docs: DataFrame, wanted: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """One row of ``docs`` for each (id, print) of ``wanted``, by an aggregate that combines first."""
    rows = with_others(docs, id_col, text_col)
    schema = StructType([*rows.schema.fields, StructField("print", LongType())])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            found = [fingerprint(text, size) for text in texts_as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=schema.names)

    printed = map_batches(rows, run, schema).join(wanted, ["id", "print"], "left_semi")
    order = F.struct(F.xxhash64("text"), F.col("text"), F.to_json("others"))
    one = printed.groupBy("id", "print").agg(F.min_by(F.struct("text", "others"), order).alias("row")).select("row.*")
    return restored(one, docs.columns, text_col)
