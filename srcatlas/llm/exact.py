"""Exact dedup: counting quotient filters find repeated fingerprints, bytes decide.

1. Texts are normalised (without blanks and U+0009 to U+000D) and leave a narrow row: key, fingerprint, code points of
   the original text, digest. These rows are written once.
2. Counting quotient filters of the fingerprints are built per partition and merged without loss by sorted remainders.
3. Fingerprints with a count above one are routed on by a filter of bounded size, which may let others through but
   holds none back: their normalised texts meet by fingerprint and digest and are compared as bytes, copies in one
   partition as one text. A digest with two different texts (the digest isn't trusted) is told apart by the text itself.
4. Groups are counted and their best row is chosen by an aggregate that combines first. Groups with more than
   a thousandth of all rows are at most a thousand and are sent to the rows; the other rows meet their group in a join.

Defined cases: a null text counts as empty, with no code points, and all empty texts are one group; texts of white space
only are empty; very long texts are held one batch at a time; of equal texts the row with the most code points in the
original stays, then the smallest key (a null key after all others), and of rows equal in both exactly one; repeated
rows are members like any other; an empty table gives an empty result; other columns aren't read, so that their names
can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType
from xxhash import xxh64_intdigest

from srcatlas.llm import bloom, quotient
from srcatlas.llm.common import Batches, id_field, map_batches, texts_as_bytes, two_columns
from srcatlas.session import materialize

#: Blanks and U+0009 to U+000D.
SPACES = b" \t\n\x0b\x0c\r"
#: A group with more than this share of all rows is sent to the rows; there are at most a thousand.
HOT_SHARE = 1000

Digest = Callable[[bytes], bytes]


def sha256(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def _fingerprint(data: bytes, bits: int) -> int:
    return xxh64_intdigest(data) >> (64 - bits)


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def narrow_rows(docs: DataFrame, bits: int, digest: Digest) -> DataFrame:
    """(id, fp, chars, digest) of every row of (id, text)."""
    schema = StructType([docs.schema["id"], StructField("fp", LongType()), StructField("chars", LongType()), StructField("digest", BinaryType())])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            chars = pc.fill_null(pc.utf8_length(batch.column(1)).cast(pa.int64()), 0)
            prints, digests = [], []
            for text in texts_as_bytes(batch.column(1)):
                plain = (text or b"").translate(None, SPACES)
                prints.append(_fingerprint(plain, bits))
                digests.append(digest(plain))
            yield pa.RecordBatch.from_arrays([batch.column(0), _signed(prints), chars, pa.array(digests, pa.binary())], names=schema.names)

    return map_batches(docs, run, schema)


def _routed_texts(docs: DataFrame, repeated, bits: int, digest: Digest) -> DataFrame:
    """(id, chars, fp, digest, plain): rows whose fingerprint may be repeated, with the normalised bytes."""
    schema = StructType(
        [docs.schema["id"], StructField("chars", LongType()), StructField("fp", LongType()), StructField("digest", BinaryType()), StructField("plain", BinaryType())]
    )

    def run(batches: Batches) -> Batches:
        for batch in batches:
            plain = [(t or b"").translate(None, SPACES) for t in texts_as_bytes(batch.column(1))]
            prints = np.array([_fingerprint(p, bits) for p in plain], np.uint64)
            keep = np.flatnonzero(repeated.value.holds(prints))
            chars = pc.fill_null(pc.utf8_length(batch.column(1)).cast(pa.int64()), 0)
            kept = [plain[i] for i in keep.tolist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(keep)),
                    chars.take(pa.array(keep)),
                    pa.array(prints[keep].view(np.int64)),
                    pa.array([digest(p) for p in kept], pa.binary()),
                    pa.array(kept, pa.binary()),
                ],
                names=schema.names,
            )

    return map_batches(docs, run, schema)


def _split(rows: DataFrame, repeated) -> DataFrame:
    """The rows with a column ``routed``: whether the fingerprint may be repeated."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            held = repeated.value.holds(batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64))
            yield batch.append_column("routed", pa.array(held))

    return map_batches(rows, run, StructType.fromJson(rows.schema.jsonValue()).add("routed", "boolean"))


def _settled(rows: DataFrame, same: list[str], total: int) -> DataFrame:
    """(id, fp, digest, keep_id, group_size, kept) of rows that are equal if they agree in ``same``; ``row`` tells rows apart."""
    best = F.min(F.struct((-F.col("chars")).alias("fewer"), F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row")))
    groups = rows.groupBy(*same).agg(F.count("*").alias("group_size"), best.alias("best")).where("group_size > 1")
    groups = groups.select(*same, "group_size", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"))
    if "plain" in same:
        # Texts have no bound that would let them be sent.
        met = rows.join(groups, same, "left")
    else:
        groups = materialize(groups, "groups")
        hot = F.broadcast(groups.where(F.col("group_size") * HOT_SHARE > total))
        cold = groups.where(F.col("group_size") * HOT_SHARE <= total)
        met = rows.join(hot, same).unionByName(rows.join(hot, same, "left_anti").join(cold, same, "left"))
    alone = F.col("keep_row").isNull()
    return met.select(
        "id",
        "digest",
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        (alone | (F.col("keep_row") == F.col("row"))).alias("kept"),
    )


def filter_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """The counting quotient filter of the normalised texts, one row per block; ``quotient.entries`` reads it."""
    rows = materialize(narrow_rows(two_columns(docs, id_col, text_col), bits, sha256), "prints")
    return quotient.build(rows, "fp", rows.count(), bits)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64, digest: Digest = sha256) -> DataFrame:
    """(key, keep_id, group_size, kept, digest) for every row, dropped ones too.

    ``bits`` is the length of the fingerprints; with fewer, or with a weaker digest, more texts are compared.
    """
    if not 1 <= bits <= 64:
        raise ValueError("a fingerprint has 1 to 64 bits")
    texts = two_columns(docs, id_col, text_col)
    # Written with a number for each row, since the passes below must see the same ones.
    rows = materialize(narrow_rows(texts, bits, digest).withColumn("row", F.monotonically_increasing_id()), "prints")
    total = rows.count()
    counted = materialize(quotient.build(rows, "fp", total, bits), "quotients")
    repeated = docs.sparkSession.sparkContext.broadcast(bloom.build(quotient.entries(counted, total, bits, least=2), "fp"))
    routed = _routed_texts(texts, repeated, bits, digest)
    differing = routed.groupBy("fp", "digest", "plain").agg(F.count("*").alias("n")).groupBy("fp", "digest").agg(F.count("*").alias("texts")).where("texts > 1")
    differing = materialize(differing.select("fp", "digest"), "differing")
    marked = _split(rows, repeated)
    alone = marked.where("NOT routed").select("id", "digest", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"))
    shared = marked.where("routed").drop("routed")
    if differing.isEmpty():
        found = _settled(shared, ["fp", "digest"], total)
    else:
        by_text = routed.join(differing, ["fp", "digest"], "left_semi").withColumn("row", F.monotonically_increasing_id())
        found = _settled(shared.join(differing, ["fp", "digest"], "left_anti"), ["fp", "digest"], total)
        found = found.unionByName(_settled(materialize(by_text, "texts"), ["fp", "digest", "plain"], total))
    return alone.unionByName(found).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", "digest")
