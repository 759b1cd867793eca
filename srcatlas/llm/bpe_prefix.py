"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a byte string the encoding is unique, and so is its last
token. Storing that token per prefix is enough to read the whole encoding from
the end, to append bytes without looking at earlier ones again, and to re-encode
an edited text from the edit on.

A token ``t`` ends the prefix ``p`` exactly if it is a suffix of ``p`` and the
last token ``u`` of the rest stays unmerged beside it. Two neighbours stay
unmerged if no pair across their border ever has the lowest rank while the merges
inside them are under way; that is found by undoing those merges, latest first.

Defined cases: a null text is the empty text; the empty text has no ids and decodes
to no bytes; every input row gives one output row, also repeated ones; ids that the
vocabulary lacks are an error.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from srcatlas.llm.common import Batches, id_field, map_batches, two_columns
from srcatlas.llm.pretokens import Splitter

#: Encoded words, and pairs of tokens, that a worker keeps beyond a batch; others are found anew when needed.
KEPT_WORDS = 250_000
KEPT_PAIRS = 1_000_000
PAIR_PLACES = 1 << 21
#: Longer words are encoded anew each time.
KEPT_WORD_CHARS = 64
#: Byte strings up to this length are encoded side by side.
COLUMN_BYTES = 32


def read_ranks(path: str) -> dict[bytes, int]:
    """Lines of base64 token and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Vocabulary:
    """Ranks of byte strings and what follows from them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.lengths = {rank: len(token) for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.width = max(self.tokens, default=0) + 1
        self._halves: dict[int, tuple[int, int] | None] = {}
        #: Whether two tokens stay apart, by left * width + right.
        self.beside: dict[int, bool] = {}
        # A state is the longest end of the bytes so far that begins a token; found when first needed.
        self._beginnings = {token[:n] for token in ranks for n in range(len(token) + 1)} | {b""}
        self._states: dict[bytes, int] = {b"": 0}
        self._texts = [b""]
        #: The longest token that ends in a state, -1 if none.
        self.ends_in = [-1]
        #: Next state, by state * 256 + byte.
        self.steps: dict[int, int] = {}
        #: The longest token that is a proper end of a token, -1 if none.
        self.shorter = {rank: self._longest_end(token[1:]) for rank, token in self.tokens.items()}

    def _longest_end(self, text: bytes) -> int:
        return next((self.ranks[text[i:]] for i in range(len(text)) if text[i:] in self.ranks), -1)

    def step(self, state: int, byte: int) -> int:
        """The state after one more byte."""
        text = self._texts[state] + bytes([byte])
        while text not in self._beginnings:
            text = text[1:]
        if text not in self._states:
            self._states[text] = len(self._texts)
            self._texts.append(text)
            self.ends_in.append(self._longest_end(text))
        self.steps[state * 256 + byte] = self._states[text]
        return self._states[text]

    @staticmethod
    def from_file(path: str) -> Vocabulary:
        return Vocabulary(read_ranks(path))

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a single byte."""
        if token not in self._halves:
            self._halves[token] = self._find_halves(token)
        return self._halves[token]

    def _find_halves(self, token: int) -> tuple[int, int] | None:
        text = self.tokens[token]
        if len(text) == 1:
            return None
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 2:
            pairs = [self.ranks.get(parts[i] + parts[i + 1], token) for i in range(len(parts) - 1)]
            least = min(pairs)
            if least >= token:
                raise ValueError(f"token {token} is not made by its own merges")
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether the encoding of both tokens' bytes is just these two tokens."""
        if len(self.beside) > KEPT_PAIRS:
            self.beside.clear()
        found = self.beside[left * self.width + right] = self._stay_apart(left, right)
        return found

    def _stay_apart(self, left: int, right: int) -> bool:
        above_left = above_right = len(self.ranks) + 1  # rank of the merge that ends the part
        tokens, ranks = self.tokens, self.ranks
        while True:
            across = ranks.get(tokens[left] + tokens[right])
            # Of equal ranks the one further left merges first.
            if across is not None and across < above_left and across <= above_right:
                return False
            halves_left, halves_right = self.halves(left), self.halves(right)
            if halves_left is None and halves_right is None:
                return True
            if halves_left is None or (halves_right is not None and right >= left):
                above_right, right = right, halves_right[0]
            else:
                above_left, left = left, halves_left[1]


class PrefixEncoder:
    """The last token of every prefix of a growing byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = b""
        self.last: list[int] = []
        self.states = [0]
        self.append(data)

    def append(self, data: bytes) -> None:
        """Add bytes at the end; earlier prefixes keep their tokens."""
        own = self.vocabulary
        steps, beside, lengths, shorter, ends_in, width = own.steps, own.beside, own.lengths, own.shorter, own.ends_in, own.width
        last, states, end, state = self.last, self.states, len(self.data), self.states[-1]
        for byte in data:
            after = steps.get(state * 256 + byte)
            state = own.step(state, byte) if after is None else after
            end += 1
            token = ends_in[state]
            while token >= 0 and (begin := end - lengths[token]):
                apart = beside.get(last[begin - 1] * width + token)
                if apart is None:
                    apart = own.stay_apart(last[begin - 1], token)
                if apart:
                    break
                token = shorter[token]
            if token < 0:
                raise ValueError(f"no token ends at byte {end}")
            last.append(token)
            states.append(state)
        self.data += data

    def replace(self, begin: int, end: int, data: bytes) -> None:
        """Exchange ``data[begin:end]``; only prefixes that reach the edit are encoded again.

        Behind the edit, work stops as soon as ``longest`` prefixes in a row end in the same token as
        before: a token looks back over at most that many bytes.
        """
        rest, old, old_states = self.data[end:], self.last[end:], self.states[end + 1 :]
        self.data, self.last, self.states = self.data[:begin], self.last[:begin], self.states[: begin + 1]
        self.append(data)
        same = 0
        for i in range(len(rest)):
            if same >= self.vocabulary.longest:
                self.data += rest[i:]
                self.last += old[i:]
                self.states += old_states[i:]
                return
            self.append(rest[i : i + 1])
            same = same + 1 if self.last[-1] == old[i] else 0

    def ids(self) -> list[int]:
        """The encoding, read from the end."""
        out, end, lengths = [], len(self.data), self.vocabulary.lengths
        while end:
            token = self.last[end - 1]
            out.append(token)
            end -= lengths[token]
        return out[::-1]


class PrefixColumns:
    """The same for many short byte strings at once: one prefix of each per step."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        top = vocabulary.width
        self.lengths = np.zeros(top, np.int64)
        self.shorter = np.full(top, -1, np.int64)
        for token, n in vocabulary.lengths.items():
            self.lengths[token], self.shorter[token] = n, vocabulary.shorter[token]
        self.steps = np.full((1024, 256), -1, np.int32)  # grows with the states seen
        self.ends_in = np.full(1024, -1, np.int64)
        # Pairs of tokens that were looked up: a table of hashed places, the next free one on a clash.
        self.keys = np.full(PAIR_PLACES, -1, np.int64)
        self.apart = np.zeros(PAIR_PLACES, bool)
        self.pairs = 0

    def _step(self, states: np.ndarray, data: np.ndarray) -> np.ndarray:
        out = self.steps[states, data]
        for key in np.unique(states[out < 0].astype(np.int64) * 256 + data[out < 0]).tolist():
            state = self.vocabulary.step(key // 256, key % 256)
            while state >= len(self.ends_in):
                self.steps = np.concatenate([self.steps, np.full_like(self.steps, -1)])
                self.ends_in = np.concatenate([self.ends_in, np.full_like(self.ends_in, -1)])
            self.steps[key // 256, key % 256] = state
            self.ends_in[state] = self.vocabulary.ends_in[state]
        return self.steps[states, data]

    @staticmethod
    def _place(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % PAIR_PLACES

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, or of the free place where it belongs."""
        at = self._place(keys)
        clash = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0))
        while len(clash):
            at[clash] = (at[clash] + 1) % PAIR_PLACES
            there = self.keys[at[clash]]
            clash = clash[(there != keys[clash]) & (there >= 0)]
        return at

    def _stay_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.vocabulary.width + right
        at = self._find(keys)
        new = np.unique(keys[self.keys[at] < 0])
        if len(new):
            if self.pairs + len(new) > PAIR_PLACES // 2:
                self.keys[:], self.pairs = -1, 0
                new = np.unique(keys)
            for key in new.tolist():
                at = self._find(np.array([key]))
                self.keys[at] = key
                self.apart[at] = self.vocabulary._stay_apart(*divmod(key, self.vocabulary.width))
            self.pairs += len(new)
            at = self._find(keys)
        return self.apart[at]

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each string; those longer than ``COLUMN_BYTES`` are encoded one by one."""
        out = [PrefixEncoder(self.vocabulary, p).ids() if len(p) > COLUMN_BYTES else [] for p in pieces]
        sizes = np.array([len(p) if len(p) <= COLUMN_BYTES else 0 for p in pieces], np.int64)
        order = np.argsort(-sizes, kind="stable")
        order = order[: np.count_nonzero(sizes)]
        if not len(order):
            return out
        sizes = sizes[order]
        columns = np.zeros((sizes[0], len(order)), np.uint8)
        flat = np.frombuffer(b"".join([pieces[i] for i in order.tolist()]), np.uint8)
        row = np.repeat(np.arange(len(order)), sizes)
        columns[np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes), row] = flat
        last = np.zeros((sizes[0], len(order)), np.int64)
        states = np.zeros(len(order), np.int32)
        for end in range(1, sizes[0] + 1):
            n = np.searchsorted(-sizes, -end, "right")
            states = self._step(states[:n], columns[end - 1, :n])
            tokens = self.ends_in[states]
            todo = np.arange(n)
            while len(todo):
                trial = tokens[todo]
                if (trial < 0).any():
                    raise ValueError("a byte is missing in the vocabulary")
                begin = end - self.lengths[trial]
                fails = np.flatnonzero(begin)
                fails = fails[~self._stay_apart(last[begin[fails] - 1, todo[fails]], trial[fails])]
                todo = todo[fails]
                tokens[todo] = self.shorter[trial[fails]]
            last[end - 1, :n] = tokens
        ids, owners = [], []
        ends, rows = sizes.copy(), np.arange(len(order))
        while len(rows):
            tokens = last[ends - 1, rows]
            ids.append(tokens)
            owners.append(rows)
            ends = ends - self.lengths[tokens]
            rows, ends = rows[ends > 0], ends[ends > 0]
        for rows, tokens in zip(reversed(owners), reversed(ids), strict=True):
            for i, token in zip(order[rows].tolist(), tokens.tolist(), strict=True):
                out[i].append(token)
        return out


class Codec:
    """Texts to ids in decimal, and back."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.columns = PrefixColumns(vocabulary)
        self.splitter = Splitter(pattern)
        self.words: dict[str, bytes] = {}
        self.decimals = {rank: str(rank).encode() for rank in vocabulary.tokens}

    def _encode_parts(self, texts: list[str]) -> list[bytes]:
        split = [self.splitter.find(text) for text in texts]
        pieces = list({p for found in split for p in found})
        encoded = self.columns.encode([p.encode() for p in pieces])
        known = {p: b" ".join([self.decimals[i] for i in ids]) for p, ids in zip(pieces, encoded, strict=True)}
        return [b" ".join([known[p] for p in found]) for found in split]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text in decimal, joined by one space."""
        cut = [self.splitter.words(text) for text in texts]
        firsts = self._encode_parts([first for first, _ in cut])
        known = self.words
        if len(known) > KEPT_WORDS:
            known.clear()
        missing = list({word for _, others in cut for word in others if word not in known})
        known.update(zip(missing, self._encode_parts([" " + word for word in missing]), strict=True))
        out = []
        for first, (_, others) in zip(firsts, cut, strict=True):
            parts = [known[word] for word in others]
            out.append(b" ".join([first, *parts] if first else parts))
        for word in missing:
            if len(word) > KEPT_WORD_CHARS:
                del known[word]
        return out


class Decoder:
    """Ids in decimal to bytes; holds the tokens and nothing else."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = {str(rank).encode(): token for token, rank in ranks.items()}

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids in decimal."""
        return b"".join(map(self.tokens.__getitem__, ids.split()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec per worker and vocabulary."""
    return Codec(Vocabulary.from_file(path), pattern)


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    """One decoder per worker and vocabulary."""
    return Decoder(read_ranks(path))


def encode(
    docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(key, ids, n_tokens): ids in decimal joined by one space, for every row."""
    schema = StructType([id_field(docs, id_col), StructField("ids", StringType()), StructField("n_tokens", LongType())])

    def run(batches: Batches) -> Batches:
        own = codec(path, pattern)
        for batch in batches:
            ids = own.encode([text or "" for text in batch.column(1).to_pylist()])
            counts = [i.count(b" ") + 1 if i else 0 for i in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())],
                names=schema.names,
            )

    return map_batches(two_columns(docs, id_col, text_col), run, schema)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The columns of ``encoded`` that ``encode`` made, and ``decoded``, the bytes of the ids."""
    schema = StructType(
        [
            id_field(encoded, id_col),
            StructField("ids", StringType()),
            StructField("n_tokens", LongType()),
            StructField("decoded", BinaryType()),
        ]
    )

    def run(batches: Batches) -> Batches:
        own = decoder(path)
        for batch in batches:
            plain = batch.column(1).cast(pa.binary()).to_pylist()
            data = pa.array([own.decode(ids or b"") for ids in plain], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, data], names=schema.names)

    return map_batches(encoded.select(id_col, F.col(ids_col).alias("ids"), "n_tokens"), run, schema)
