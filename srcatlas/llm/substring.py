"""Substring dedup by a compacted De Bruijn graph of word windows.

A window of 20 words is an edge of the graph from its first to its last 19 words. Its identity is its minimizer's hash and 64 bits
of the BLAKE2b digest of its words, joined by blanks.

1. Among the 5-word runs of a window the one with the least hash is its minimizer. Minimizers that occur only once can't belong
   to a repeated window; those that occur more often go into a filter of bounded size, which only spares rows.
2. Windows that pass are dealt by minimizer, in pieces of neighbouring windows with the same one, equal pieces of a batch as one; a
   minimizer with very many occurrences is dealt window by window. There each window finds its first occurrence (least key,
   then start), the number of its occurrences and two sums of their places. A window goes on with the path of the one before it exactly if all
   occurrences of one follow those of the other: numbers are equal and sums differ by one step each.
3. The pieces of paths so found are joined at their ends, by source coordinates, numbers and sums. A path has its source, its length
   and its windows' identities combined.
4. Occurrences of the paths' heads are joined with them and go to their documents. There the words of the whole span are compared
   with the source through the identities of all its windows, and go if they are equal and the span isn't the source itself.

Defined cases: a null text has no words; texts shorter than a window lose none; a window that overlaps its
earlier copy in one document counts as a copy; very long texts are hashed in parts, but the places of their repeated windows are
held at once; rows with the same key are one document: of equal windows those with the least key and start stay, in every row
that has them there, and no other; a null key comes before all others; ties are broken by a hash of the text, which changes
no result; every input row gives one output row; an empty table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from srcatlas.llm import bloom
from srcatlas.llm.common import Batches, id_field, map_batches, restored, texts_as_bytes, two_columns, with_others
from srcatlas.session import materialize

#: Words of the runs among which a window's minimizer is chosen.
SEED_WORDS = 5
#: Texts are hashed together up to this many bytes.
GROUP_BYTES = 1 << 20
#: Rows that are put in order together after the shuffle; more rows of one part are folded.
ORDERED_ROWS = 50_000
#: A minimizer with more occurrences than this, and than its share of all, is dealt by window.
HOT_ROWS = 20_000
HOT_SHARE = 1e-4

_U = np.uint64
_BYTE_STEP = _U(0x9FB21C651E98DF25)
_WORD_STEP = _U(0xD1342543DE82EF95)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> _U(32))) * _U(0xD6E8FEB86659FD93)
    values = (values ^ (values >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return values ^ (values >> _U(32))


_BYTE_VALUES = _mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_BYTE_VALUES[_SPACE] = 0


class _Powers:
    """Powers of the step and of its inverse, as many as were needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(0, _U)

    def grow(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            inverse = pow(int(_BYTE_STEP), -1, 1 << 64)
            self.up = np.cumprod(np.concatenate([[_U(1)], np.full(n, _BYTE_STEP, _U)]), dtype=_U)
            self.down = np.cumprod(np.concatenate([[_U(1)], np.full(n, inverse, _U)]), dtype=_U)


_POWERS = _Powers()


def word_hashes(data: bytes) -> np.ndarray:
    """A hash of every word between blanks and U+0009 to U+000D."""
    out, at = [], 0
    while at < len(data):
        end = at + GROUP_BYTES
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        block = np.frombuffer(data[at:end], np.uint8)
        at = end
        word = ~_SPACE[block]
        edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        _POWERS.grow(len(block))
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTE_VALUES[block] * _POWERS.up[: len(block)], dtype=_U)])
        out.append(_mix((sums[ends] - sums[starts]) * _POWERS.down[starts]))
    return np.concatenate(out) if out else np.empty(0, _U)


def run_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` words, put together from runs of doubling sizes."""
    out, have, power, step, width = None, 0, hashes, _WORD_STEP, 1
    while True:
        if size & width:
            if out is None:
                out = power
            else:
                n = max(0, len(hashes) - have - width + 1)
                out = out[:n] * step + power[have : have + n]
            have += width
        if have == size:
            return out
        n = max(0, len(power) - width)
        power = power[:n] * step + power[width : width + n]
        step, width = _U(int(step) ** 2 % (1 << 64)), width * 2


class Group:
    """Windows of several texts in a row."""

    def __init__(self, texts: list[bytes], window: int):
        parts = [word_hashes(t) for t in texts]
        self.sizes = np.array([len(p) for p in parts], np.int64)
        words = np.concatenate(parts) if parts else np.empty(0, _U)
        owner = np.repeat(np.arange(len(parts)), self.sizes)
        first = np.cumsum(self.sizes) - self.sizes
        runs = min(SEED_WORDS, window)
        seeds = _mix(run_hashes(words, runs))
        edges = _mix(run_hashes(words, window))
        inside = np.flatnonzero(owner[: len(edges)] == owner[window - 1 :]) if len(edges) else np.empty(0, np.int64)
        # The place in the low bits: of equal hashes the first counts.
        least = (seeds & ~_U(0xFFFFFFF)) | np.arange(len(seeds), dtype=_U)
        span, width = window - runs + 1, 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if span > width:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        #: Of each window inside one text: the text, the start in it, the window's hash, its minimizer's place and hash.
        self.owner = owner[inside]
        self.start = inside - first[self.owner]
        self.edge = edges[inside]
        self.place = (least[inside] & _U(0xFFFFFFF)).astype(np.int64)
        self.seed = seeds[self.place]

    def seeds(self) -> np.ndarray:
        """Hash of every place that is a minimizer."""
        return self.seed[np.flatnonzero(np.diff(self.place, prepend=-1))]


def _groups(texts: list[bytes | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in a row of a bounded size, with the number of the first."""
    at, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or b"")
        if size >= GROUP_BYTES or i == len(texts) - 1:
            yield at, [t or b"" for t in texts[at : i + 1]]
            at, size = i + 1, 0


def _seed_counts(docs: DataFrame, window: int) -> DataFrame:
    schema = StructType([StructField("seed", LongType()), StructField("n", LongType())])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for _, texts in _groups(texts_as_bytes(batch.column(1))):
                seeds, counts = np.unique(Group(texts, window).seeds(), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(seeds.view(np.int64)), pa.array(counts)], names=schema.names)

    return map_batches(docs, run, schema).groupBy("seed").agg(F.sum("n").alias("n"))


def _identities(words: list[bytes], starts: np.ndarray, window: int) -> np.ndarray:
    """64 bits of the BLAKE2b digest of the windows that start at these words."""
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begin = np.concatenate([[0], ends[:-1] + 1])[starts].tolist()
    digest = hashlib.blake2b
    return np.frombuffer(b"".join([digest(joined[a:b], digest_size=8).digest() for a, b in zip(begin, ends[starts + window - 1].tolist(), strict=True)]), "<i8")


class _Taken:
    """The windows of a group whose minimizer may be repeated, with their identities."""

    def __init__(self, part: list[bytes], window: int, seeds):
        group = Group(part, window)
        taken = seeds.holds(group.seed)
        self.owner, self.start, self.place, self.seed = group.owner[taken], group.start[taken], group.place[taken], group.seed[taken]
        cuts = [*np.flatnonzero(np.diff(self.owner, prepend=-1)).tolist(), len(self.owner)]
        found = [_identities(part[self.owner[a]].split(), self.start[a:b], window) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.edge = np.concatenate(found) if found else np.empty(0, np.int64)


_PIECE = ("copies", "m1", "m2")


def _marks(doc: np.ndarray) -> list[np.ndarray]:
    """Two numbers of 31 bits for a document, so that sums of them can't overflow."""
    return [(doc.view(_U) >> _U(33)).astype(np.int64), doc & 0x7FFFFFFF]


def _summed(order: np.ndarray, first: np.ndarray, columns: list[np.ndarray]) -> list[np.ndarray]:
    return [np.add.reduceat(c[order], first) if len(first) else c[:0] for c in columns]


def _pieces(docs: DataFrame, window: int, repeated, hot: np.ndarray) -> DataFrame:
    """(part, seed, whole, id, start, doc, copies, m1, m2, windows): pieces of windows whose minimizer may be repeated."""
    number = {c: StructField(c, LongType()) for c in ("part", "seed", "whole", "doc", *_PIECE)}
    schema = StructType(
        [
            *[number[c] for c in ("part", "seed", "whole")],
            docs.schema["id"],
            StructField("start", IntegerType()),
            *[number[c] for c in ("doc", *_PIECE)],
            StructField("windows", ArrayType(LongType())),
        ]
    )

    def run(batches: Batches) -> Batches:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            # In the order of keys; rows with one key have one number.
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i]))
            key = np.cumsum([i > 0 and ids[order[i]] != ids[order[i - 1]] for i in range(len(order))])
            docs = batch.column(2).to_numpy()[order]
            texts = texts_as_bytes(batch.column(1))
            for at, part in _groups([texts[i] for i in order]):
                w = _Taken(part, window, repeated.value)
                split = np.isin(w.seed, hot)
                new = (np.diff(w.place, prepend=-1) != 0) | (np.diff(w.start, prepend=-2) != 1) | (np.diff(w.owner, prepend=-1) != 0) | split
                begin = np.flatnonzero(new)
                if not len(begin):
                    continue
                size = np.diff(np.append(begin, len(w.edge)))
                within = np.arange(len(w.edge)) - np.repeat(begin, size)
                whole = np.add.reduceat(_mix(w.edge.view(_U) + _mix(within.astype(_U) + _U(1))), begin).view(np.int64)
                owner, start, seed = at + w.owner[begin], w.start[begin], w.seed[begin].view(np.int64)
                # Of equal pieces the one with the least key and start counts.
                by = np.lexsort((start, key[owner], whole, seed))
                first = np.flatnonzero(np.concatenate([[True], (np.diff(seed[by]) != 0) | (np.diff(whole[by]) != 0)]))
                sums = _summed(by, first, [np.ones(len(by), np.int64), *[m + start for m in _marks(docs[owner])]])
                pick = by[first]
                listed = np.repeat(begin[pick] - np.cumsum(size[pick]) + size[pick], size[pick]) + np.arange(size[pick].sum())
                lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(size[pick])).astype(np.int32), w.edge[listed])
                deal = np.where(split[begin[pick]], _mix(seed[pick].view(_U)) + w.edge[begin[pick]].view(_U), seed[pick].view(_U)).view(np.int64)
                columns = [deal, seed[pick], whole[pick], batch.column(0).take(pa.array([order[i] for i in owner[pick].tolist()], pa.int64()))]
                columns += [start[pick].astype(np.int32), docs[owner[pick]], *sums, lists]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=schema.names)

    return map_batches(docs, run, schema)


def _folded(table: pa.Table) -> pa.Table:
    """Equal pieces of rows in the order of keys and starts as one row, that of the first."""
    part, whole = table.column("part").to_numpy(), table.column("whole").to_numpy()
    order = np.lexsort((whole, part))
    first = np.flatnonzero(np.concatenate([[True], (np.diff(part[order]) != 0) | (np.diff(whole[order]) != 0)]))
    sums = dict(zip(_PIECE, _summed(order, first, [table.column(c).to_numpy() for c in _PIECE]), strict=True))
    back = np.argsort(order[first])
    kept = table.take(pa.array(order[first][back]))
    return pa.table({c: pa.array(sums[c][back]) if c in sums else kept.column(c) for c in table.column_names})


def _fragments(pieces: DataFrame) -> DataFrame:
    """(seed, edge, id, start, doc, length, copies, m1, m2, x): parts of paths inside of pieces, at their first occurrence."""
    number = {c: StructField(c, LongType()) for c in ("seed", "edge", "doc", "length", *_PIECE, "x")}
    front = [number["seed"], number["edge"], pieces.schema["id"], StructField("start", IntegerType())]
    schema = StructType([*front, *[number[c] for c in ("doc", "length", *_PIECE, "x")]])

    def settle(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        lists = table.column("windows").combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(len(size)), size)
        offset = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        edge = lists.flatten().to_numpy()
        part, seed = table.column("part").to_numpy()[row], table.column("seed").to_numpy()[row]
        start = table.column("start").to_numpy().astype(np.int64)[row] + offset
        copies = table.column("copies").to_numpy()[row]
        marks = [table.column(m).to_numpy()[row] + copies * offset for m in _PIECE[1:]]
        # Rows are in the order of keys; a key's rows have one number.
        ids = table.column("id")
        same = pc.fill_null(pc.equal(ids.slice(1), ids.slice(0, len(ids) - 1)), False).to_numpy() | (ids.slice(1).is_null().to_numpy() & ids.slice(0, len(ids) - 1).is_null().to_numpy())
        key = np.concatenate([[0], np.cumsum(~same)])[row]
        order = np.lexsort((start, key, edge, seed, part))
        new = np.concatenate([[True], *[np.diff(c[order]) != 0 for c in (edge,)]])
        new[1:] |= (np.diff(seed[order]) != 0) | (np.diff(part[order]) != 0)
        new = np.flatnonzero(new)
        copies, *marks = _summed(order, new, [copies, *marks])
        first = order[new]
        # Repeated windows, in the order of their places; neighbours with equal occurrences are on one path.
        keep = np.flatnonzero(copies > 1)
        keep = keep[np.argsort(first[keep], kind="stable")]
        first, copies, marks = first[keep], copies[keep], [m[keep] for m in marks]
        ends = np.concatenate([[True], (np.diff(first) != 1) | (np.diff(row[first]) != 0) | (np.diff(copies) != 0)]) if len(first) else np.empty(0, bool)
        for m in marks:
            ends[1:] |= np.diff(m) != copies[1:]
        head = np.flatnonzero(ends)
        at = first[head]
        columns = [seed[at], edge[at], table.column("id").combine_chunks().take(pa.array(row[at])), start[at].astype(np.int32)]
        columns += [table.column("doc").to_numpy()[row[at]], np.diff(np.append(head, len(first))), copies[head], *[m[head] for m in marks]]
        columns.append(np.bitwise_xor.reduceat(edge[first], head) if len(head) else edge[:0])
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else c.combine_chunks() if isinstance(c, pa.ChunkedArray) else pa.array(c) for c in columns], names=schema.names)

    def run(batches: Batches) -> Batches:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= ORDERED_ROWS:
                table = pa.Table.from_batches(held)
                part = table.column("part").to_numpy()
                cut = int(np.flatnonzero(part != part[-1])[-1]) + 1 if part[0] != part[-1] else 0
                if cut:
                    yield settle(table.slice(0, cut))
                held = _folded(table.slice(cut)).to_batches()
                # Pieces that differ are more rows than are folded next time.
                rows = min(sum(map(len, held)), ORDERED_ROWS // 2)
        if held:
            yield settle(pa.Table.from_batches(held))

    ordered = pieces.repartition("part").sortWithinPartitions("part", "id", "start")
    return map_batches(ordered, run, schema)


def _paths(fragments: DataFrame) -> DataFrame:
    """(seed, edge, source, source_start, length, copies, x): paths without branches, by their first window.

    ``length`` counts windows, ``x`` combines the identities of all of them.
    """
    end = [(F.col(m) + F.col("copies") * F.col("length")).alias(m) for m in _PIECE[1:]]
    before = fragments.select("doc", (F.col("start") + F.col("length")).cast("int").alias("start"), "copies", *end, F.lit(True).alias("goes_on")).distinct()
    linked = fragments.join(before, ["doc", "start", *_PIECE], "left")
    # A document's own pieces, bounded by its length.
    along = Window.partitionBy("doc").orderBy("start")
    begins = F.col("goes_on").isNull()
    own = linked.withColumn("head", F.last(F.when(begins, F.col("start")), ignorenulls=True).over(along))
    return (
        own.groupBy("doc", "head")
        .agg(
            *[F.max(F.when(begins, F.col(c))).alias(c) for c in ("seed", "edge", "id", "copies")],
            F.sum("length").alias("length"),
            F.bit_xor("x").alias("x"),
        )
        .select("seed", "edge", F.col("id").alias("source"), F.col("head").alias("source_start"), "length", "copies", "x")
    )


def _heads(docs: DataFrame, window: int, seeds, heads) -> DataFrame:
    """(seed, edge, id, start, doc): the windows that may be the head of a path."""
    schema = StructType([*[StructField(c, LongType()) for c in ("seed", "edge")], docs.schema["id"], StructField("start", IntegerType()), StructField("doc", LongType())])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for at, part in _groups(texts_as_bytes(batch.column(1))):
                w = _Taken(part, window, seeds.value)
                some = heads.value.holds(w.edge.view(_U))
                rows = pa.array(at + w.owner[some])
                columns = [pa.array(w.seed[some].view(np.int64)), pa.array(w.edge[some]), batch.column(0).take(rows)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(w.start[some].astype(np.int32)), batch.column(2).take(rows)], names=schema.names)

    return map_batches(docs, run, schema)


def dedup_substrings(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, n_words, n_removed, kept, removed, sources) for every row.

    ``kept`` are the words left, joined by one space; ``removed`` the [start, end) word positions that went;
    ``sources`` the [start, end, copies] of the compacted paths whose first occurrence lies in the document.
    """
    return _without_repeats(docs, two_columns(docs, id_col, text_col), window, _removed_schema(docs, id_col), _details)


def without_repeats(
    docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars"
) -> DataFrame:
    """The rows of ``docs``, with all columns, and the words left as text where words went.

    A text that loses none stays as it is; ``chars_col``, if there is one, counts the characters that are left.
    """
    texts = with_others(docs, id_col, text_col)
    schema = StructType([StructField("text", StringType()), StructField("changed", BooleanType()), texts.schema["others"]])
    found = _without_repeats(docs, texts, window, schema, _changed_text)
    size = F.when(F.col("changed"), F.length("text").cast("long")).otherwise(F.col("others").getField(chars_col)) if chars_col in docs.columns else None
    return restored(found, docs.columns, text_col, **({chars_col: size} if size is not None else {}))


def _removed_schema(docs: DataFrame, id_col: str) -> StructType:
    return StructType(
        [
            id_field(docs, id_col),
            StructField("n_words", LongType()),
            StructField("n_removed", LongType()),
            StructField("kept", StringType()),
            StructField("removed", ArrayType(ArrayType(IntegerType()))),
            StructField("sources", ArrayType(ArrayType(LongType()))),
        ]
    )


def _without_repeats(docs: DataFrame, texts: DataFrame, window: int, schema: StructType, finish) -> DataFrame:
    if not SEED_WORDS <= window <= SEED_WORDS + 60:
        raise ValueError(f"a window has {SEED_WORDS} to {SEED_WORDS + 60} words")
    spark = docs.sparkSession
    # What tells a document from all others: a hash of its key and text.
    doc = F.xxhash64("id", F.lit(1), "text").alias("doc")
    plain = texts.select("id", "text", doc)
    seeds = materialize(_seed_counts(plain, window).where("n > 1"), "seeds")
    total = seeds.agg(F.sum("n")).first()[0] or 0
    # At most 1 / HOT_SHARE of them.
    hot = [r.seed for r in seeds.where(F.col("n") > max(HOT_ROWS, int(total * HOT_SHARE))).select("seed").collect()]
    repeated = spark.sparkContext.broadcast(bloom.build(seeds, "seed"))
    pieces = _pieces(plain, window, repeated, np.array(hot, np.int64).view(_U))
    paths = materialize(_paths(materialize(_fragments(pieces), "fragments")), "paths")
    begun = spark.sparkContext.broadcast(bloom.build(paths.select("seed").distinct(), "seed"))
    heads = spark.sparkContext.broadcast(bloom.build(paths, "edge"))
    met = _heads(plain, window, begun, heads).join(paths, ["seed", "edge"])
    first = F.col("id").eqNullSafe(F.col("source")) & (F.col("start") == F.col("source_start"))
    span = F.struct("start", "length", first.alias("first"), "copies", "x")
    # Bounded by the document's own length, also where rows are equal.
    own = met.groupBy(F.col("doc").alias("own")).agg(F.collect_set(span).alias("spans"))
    rows = texts.select("*", doc)
    joined = rows.join(own.hint("shuffle_hash"), rows["doc"] == own["own"], "left")
    joined = joined.select("id", "text", "spans", *[c for c in texts.columns if c == "others"])
    types = [to_arrow_type(f.dataType) for f in schema.fields if f.name != "others"][0 if "others" in schema.names else 1 :]

    def run(batches: Batches) -> Batches:
        for batch in batches:
            # Words of one text at a time.
            found = [finish(t, s or [], window) for t, s in zip(texts_as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True)]
            front, back = ([], batch.columns[3:]) if "others" in schema.names else (batch.columns[:1], [])
            made = [pa.array(x, t) for x, t in zip(zip(*found, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*front, *made, *back], names=schema.names)

    return map_batches(joined, run, schema)


def _verified(words: list[bytes], spans: list[dict], window: int) -> tuple[list[list[int]], list[list[int]]]:
    """(removed, sources): [start, end) of what goes, and [start, end, copies] of the paths that have their source here."""
    gone, sources = [], []
    spans = sorted(spans, key=lambda s: s["start"])
    if any(not s["first"] for s in spans):
        starts = np.concatenate([np.arange(s["start"], min(s["start"] + s["length"], len(words) - window + 1)) for s in spans if not s["first"]])
        own = _identities(words, starts, window)
    at = 0
    for s in spans:
        end = s["start"] + s["length"] + window - 1
        if s["first"]:
            sources.append([s["start"], end, s["copies"]])
            continue
        part = own[at : at + s["length"]]
        at += len(part)
        if len(part) == s["length"] and (np.bitwise_xor.reduce(part) == s["x"]):
            if gone and gone[-1][1] >= s["start"]:
                gone[-1][1] = max(gone[-1][1], end)
            else:
                gone.append([s["start"], end])
    return gone, sources


def _details(text: bytes | None, spans: list[dict], window: int) -> tuple:
    """(n_words, n_removed, kept, removed, sources) of one text."""
    words = (text or b"").split()
    gone, sources = _verified(words, spans, window)
    return len(words), sum(b - a for a, b in gone), _without(words, gone).decode(), gone, sources


def _changed_text(text: bytes | None, spans: list[dict], window: int) -> tuple:
    """(text, changed) of one text."""
    words = text.split() if any(not s["first"] for s in spans) else []
    gone = _verified(words, spans, window)[0] if words else []
    return (_without(words, gone) if gone else text or b"").decode() if text is not None else None, bool(gone)


def _without(words: list[bytes], spans: list[list[int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out += words[at:a]
        at = b
    return b" ".join(out + words[at:])
