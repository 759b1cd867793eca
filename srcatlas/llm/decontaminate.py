"""Benchmark decontamination by Wu-Manber search over words.

Letters of the search are words. Windows of benchmark items are the patterns. For each
length of window, a table says for every block of up to three words how far the search may
move on at least; a block that no window holds lets it pass over all positions that the
block rules out. Where a block ends a window, that block's bucket names the windows, and
only those with the same first word are compared word by word.

The benchmark is read in blocks of bounded size, and each block is one pass over the
documents, chained without a shuffle; so neither the broadcast nor a worker's tables grow
with the benchmark.

Defined cases: a null text has no words, and neither hits nor is hit; an item with fewer
words than a window is one window, an item without words none; equal windows of several
items count for each; rows of an item with the same key are one item; an item with a null
key marks words but is not listed; every document row gives one output row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from srcatlas.llm.common import Batches, id_field, map_batches, restored, texts_as_bytes, two_columns, with_others
from srcatlas.session import materialize

#: Bytes of benchmark text in one pass over the documents.
PASS_BYTES = 2_000_000
#: Passes that run in one go; their result is then written.
PASSES_TOGETHER = 4
#: Words of a block.
BLOCK = 3

# Lower case for A-Z; every other ASCII character but digits and letters is a gap.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))

Window = tuple[bytes, ...]


def words(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters (in lower case), digits and characters beyond ASCII."""
    return text.translate(_LOWER).split() if text else []


class WuManber:
    """Finds windows of one length."""

    def __init__(self, windows: dict[Window, list]):
        self.length = len(next(iter(windows)))
        self.block = min(BLOCK, self.length)
        #: What a block unknown to all windows allows.
        self.skip = self.length - self.block + 1
        self.shift: dict[Window, int] = {}
        #: Windows by their last block, then by their first word.
        self.buckets: dict[Window, dict[bytes, list[tuple[Window, list]]]] = {}
        for window, items in windows.items():
            for end in range(self.block, self.length + 1):
                key, left = window[end - self.block : end], self.length - end
                self.shift[key] = min(left, self.shift.get(key, self.skip))
            self.buckets.setdefault(window[-self.block :], {}).setdefault(window[0], []).append((window, items))

    def search(self, text: list[bytes]) -> Iterator[tuple[int, list]]:
        """(start, items) of every occurrence, from the left."""
        shift, skip, length, block = self.shift.get, self.skip, self.length, self.block
        end, total = length, len(text)
        while end <= total:
            key = tuple(text[end - block : end])
            move = shift(key, skip)
            if move:
                end += move
                continue
            start = end - length
            for window, items in self.buckets[key].get(text[start], ()):
                if tuple(text[start:end]) == window:
                    yield start, items
            end += 1


def searchers(items: list[tuple[int, list[bytes]]], window: int) -> list[WuManber]:
    """One search per length of window; items are (number, words)."""
    by_length: dict[int, dict[Window, list[int]]] = {}
    for number, text in items:
        size = min(window, len(text))
        for at in range(len(text) - size + 1 if size else 0):
            owners = by_length.setdefault(size, {}).setdefault(tuple(text[at : at + size]), [])
            if not owners or owners[-1] != number:
                owners.append(number)
    return [WuManber(windows) for _, windows in sorted(by_length.items())]


def scan(text: list[bytes], searches: list[WuManber]) -> tuple[list[list[int]], list[int]]:
    """Merged [start, end) spans of the words hit, and the sorted numbers of the items found."""
    found, numbers = [], set()
    for search in searches:
        for start, items in search.search(text):
            found.append((start, start + search.length))
            numbers.update(items)
    return merge(found), sorted(numbers)


def merge(spans: list) -> list[list[int]]:
    """Union of [start, end) spans."""
    out: list[list[int]] = []
    for start, end in sorted(map(tuple, spans)):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def _passes(benchmark: DataFrame, pass_bytes: int) -> Iterator[list[tuple]]:
    """Items in blocks of bounded size, read one after another."""
    block, size = [], 0
    for key, text in benchmark.where("text IS NOT NULL").toLocalIterator():
        block.append((key, text))
        size += len(text)
        if size >= pass_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """(key, n_words, n_hit, n_items, items, spans, contaminated) for every row.

    ``items`` are the keys of items with occurring windows as sorted strings, ``spans`` the [start, end) word
    positions that windows cover.
    """
    out = _scanned(docs, benchmark, window, id_col, text_col, item_col, item_text_col, pass_bytes)
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        "items",
        "spans",
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """The rows of ``docs`` that no window occurs in, with all columns."""
    out = _scanned(docs, benchmark, window, id_col, text_col, item_col, item_text_col, pass_bytes, whole=True)
    return restored(out.where("n_hit = 0"), docs.columns, text_col)


def _scanned(
    docs: DataFrame, benchmark: DataFrame, window: int, id_col: str, text_col: str, item_col: str, item_text_col: str, pass_bytes: int, whole: bool = False
) -> DataFrame:
    """All passes over the documents; ``whole`` also gives back text and other columns."""
    spark = docs.sparkSession
    texts = with_others(docs, id_col, text_col) if whole else two_columns(docs, id_col, text_col)
    others = [texts.schema["others"]] if whole else []
    schema = StructType(
        [
            id_field(docs, id_col, "id"),
            StructField("text", StringType()),
            StructField("n_words", LongType()),
            StructField("n_hit", LongType()),
            StructField("items", ArrayType(StringType())),
            StructField("spans", ArrayType(ArrayType(IntegerType()))),
            *others,
        ]
    )
    out = texts.withColumns({"items": F.lit(None).cast("array<string>"), "spans": F.lit(None).cast("array<array<int>>")})
    blocks = list(_sent(spark, two_columns(benchmark, item_col, item_text_col), window, pass_bytes)) or [_send(spark, [], window)]
    for number, sent in enumerate(blocks):
        given = out.select("id", "text", "items", "spans", *[f.name for f in others])
        out = _one_pass(given, sent, schema, with_text=whole or number < len(blocks) - 1)
        if number % PASSES_TOGETHER == PASSES_TOGETHER - 1 and number < len(blocks) - 1:
            out = materialize(out, "scanned")
    return out


def _sent(spark, items: DataFrame, window: int, pass_bytes: int) -> Iterator:
    # Rows of one item stay in one block as long as they fit there.
    for block in _passes(items.orderBy("id"), pass_bytes):
        yield _send(spark, block, window)


class Block:
    """Keys and words of one bounded block of items, and the tables of their windows.

    The tables aren't sent. A worker makes them for its first task and, since they hang on the broadcast value, keeps them
    for its further tasks until it drops that value.
    """

    def __init__(self, window: int, keys: list[str | None], texts: list[list[bytes]]):
        self.window, self.keys, self.texts = window, keys, texts
        self.built: list[WuManber] | None = None

    def searches(self) -> list[WuManber]:
        if self.built is None:
            self.built = searchers(list(enumerate(self.texts)), self.window)
        return self.built


def _send(spark, block: list[tuple], window: int):
    """Broadcast the keys and words of one bounded block."""
    keys = [None if key is None else str(key) for key, _ in block]
    return spark.sparkContext.broadcast(Block(window, keys, [words(text.encode()) for _, text in block]))


def _one_pass(docs: DataFrame, sent, schema: StructType, with_text: bool) -> DataFrame:
    def run(batches: Batches) -> Batches:
        keys, searches = sent.value.keys, sent.value.searches()
        for batch in batches:
            n_words, n_hit, items, spans = [], [], [], []
            before = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            for text, (old_items, old_spans) in zip(texts_as_bytes(batch.column(1)), before, strict=True):
                found = words(text)
                hit, numbers = scan(found, searches)
                if old_spans:
                    hit = merge(hit + old_spans)
                n_words.append(len(found))
                n_hit.append(sum(end - start for start, end in hit))
                items.append(sorted({keys[i] for i in numbers if keys[i] is not None} | set(old_items or ())))
                spans.append(hit)
            text = batch.column(1) if with_text else pa.nulls(len(batch), pa.string())
            arrays = [
                pa.array(n_words, pa.int64()),
                pa.array(n_hit, pa.int64()),
                pa.array(items, pa.list_(pa.string())),
                pa.array(spans, pa.list_(pa.list_(pa.int32()))),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), text, *arrays, *batch.columns[4:]], names=schema.names)

    return map_batches(docs, run, schema)
