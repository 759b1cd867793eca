"""Token counts by rank-synchronous merging of ragged arrays.

All pre-tokens of a batch lie in one flat array with the start of each. In a round
every pre-token merges its own lowest-ranked pair, all of them at once; what has no
pair left is done. Counts are the symbols that survive.

Defined cases: a null text is the empty text with no bytes and no tokens; a special
string inside a text is one token, as the library reads it by default; every input row
gives one output row.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from srcatlas.llm.common import Batches, id_field, map_batches, two_columns
from srcatlas.llm.pretokens import Splitter

#: Counts that a worker keeps beyond a batch, of words and of pre-tokens with so many characters at most.
KEPT = 500_000
KEPT_CHARS = 64
#: Characters of pre-tokens that are merged together.
MERGED_CHARS = 2_000_000
_NONE = np.int64(1 << 40)


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class Merges:
    """Pairs of symbol ids, their rank and the id that they merge into."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        self.first = np.zeros(256, np.int64)
        for byte, symbol in byte_symbols().items():
            self.first[byte] = vocabulary[symbol]
        self.width = np.int64(max(vocabulary.values()) + 1)
        ranked: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            ranked.setdefault(vocabulary[a] * int(self.width) + vocabulary[b], (rank, vocabulary[a + b]))
        self.pairs = np.array(sorted(ranked), np.int64)
        self.ranks = np.array([ranked[p][0] for p in self.pairs.tolist()], np.int64)
        self.made = np.zeros(len(merges), np.int64)
        for rank, symbol in ranked.values():
            self.made[rank] = symbol

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; ``_NONE`` where the vocabulary has no such merge."""
        if not len(self.pairs):
            return np.full(len(left), _NONE)
        wanted = left * self.width + right
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[at] == wanted, self.ranks[at], _NONE)

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols left of each piece when nothing more merges."""
        out = np.fromiter(map(len, pieces), np.int64, len(pieces))
        owner = np.repeat(np.arange(len(pieces)), out)
        symbols = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = np.full(len(symbols), _NONE)
        inside = np.flatnonzero(owner[:-1] == owner[1:])
        ranks[inside] = self.rank_of(symbols[inside], symbols[inside + 1])
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            lengths = np.diff(np.append(starts, len(symbols)))
            least = np.minimum.reduceat(ranks, starts)
            going = least < _NONE
            if not going.any():
                break
            wide = np.repeat(least, lengths)
            keep = np.repeat(going, lengths)
            if not going.all():  # pieces that are done leave
                symbols, ranks, owner, wide = symbols[keep], ranks[keep], owner[keep], wide[keep]
            hit = ranks == wide
            # Of a run of equal pairs, as in "aaaa", every second one merges, from the left.
            at = np.flatnonzero(hit)
            fresh = np.concatenate([[True], np.diff(at) > 1])
            run_start = np.maximum.accumulate(np.where(fresh, at, 0))
            at = at[(at - run_start) % 2 == 0]
            symbols[at] = self.made[ranks[at]]
            np.subtract.at(out, owner[at], 1)
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            changed = np.zeros(len(symbols), bool)
            changed[at] = True
            before = at[at > 0] - 1
            before = np.where(stay[before], before, before - 1)
            changed[before[before >= 0]] = True
            symbols, ranks, owner, changed = symbols[stay], ranks[stay], owner[stay], changed[stay]
            at = np.flatnonzero(changed)
            ranks[at] = _NONE
            at = at[at + 1 < len(symbols)]
            at = at[owner[at] == owner[at + 1]]
            ranks[at] = self.rank_of(symbols[at], symbols[at + 1])
        return out


class Counter:
    """Counts tokens of texts by a byte-level vocabulary file."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.merges = Merges(spec["model"]["vocab"], merges)
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.splitter = Splitter(pattern)
        self.pieces: dict[str, int] = {}
        self.words: dict[str, int] = {}

    def _learn(self, texts: list[str]) -> list[int]:
        """Counts of texts that are not cut any further, from those of their pre-tokens."""
        split, known = [self.splitter.find(text) for text in texts], self.pieces
        if len(known) > KEPT:
            known.clear()
        block, size = [], 0
        missing = list({p for pieces in split for p in pieces if p not in known})
        for i, piece in enumerate(missing):
            block.append(piece)
            size += len(piece)
            if size >= MERGED_CHARS or i == len(missing) - 1:
                known.update(zip(block, self.merges.counts([p.encode() for p in block]).tolist(), strict=True))
                block, size = [], 0
        out = [sum([known[p] for p in pieces]) for pieces in split]
        for piece in missing:
            if len(piece) > KEPT_CHARS:
                del known[piece]
        return out

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        out, firsts, cut = [], [], []
        for i, text in enumerate(texts):
            parts = self.special.split(text) if self.special else [text]
            out.append(len(parts) - 1)
            for part in parts:
                first, others = self.splitter.words(part)
                cut.append((i, others))
                if first:
                    firsts.append((i, first))
        for (i, _), n in zip(firsts, self._learn([text for _, text in firsts]), strict=True):
            out[i] += n
        known = self.words
        if len(known) > KEPT:
            known.clear()
        missing = list({word for _, others in cut for word in others if word not in known})
        known.update(zip(missing, self._learn([" " + word for word in missing]), strict=True))
        for i, others in cut:
            out[i] += sum([known[word] for word in others])
        for word in missing:
            if len(word) > KEPT_CHARS:
                del known[word]
        return out


@lru_cache(maxsize=2)
def counter(path: str, pattern: str) -> Counter:
    """One counter per worker and vocabulary."""
    return Counter(path, pattern)


def count_tokens(
    docs: DataFrame,
    path: str,
    pattern: str = public_tokenizers.PATTERN,
    limit: int = 512,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for every row."""
    schema = StructType([id_field(docs, id_col), StructField("n_bytes", LongType()), StructField("n_tokens", LongType())])

    def run(batches: Batches) -> Batches:
        own = counter(path, pattern)
        for batch in batches:
            texts = [text or "" for text in batch.column(1).to_pylist()]
            sizes = [len(t.encode()) for t in texts]
            counts = own.count(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=schema.names
            )

    return map_batches(two_columns(docs, id_col, text_col), run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
