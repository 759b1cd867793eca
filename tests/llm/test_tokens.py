"""Counting, encoding and decoding against the libraries."""

from __future__ import annotations

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from srcatlas.llm import bpe_prefix, queries, token_count

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SPEC = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [
    "a", "b", "the", " ", "  ", "\n", "\t", "\x1c", "\x1f", "\x85", "\xa0", "é", "ñ", "日本", "😀", "1", "23", "'s", "'ll", "!", "###", "<|endoftext|>",
    "<|", "​", " ", "　", "aaaa", "ing", "٣", "²", "́", "\x00", "\r\n",
]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    made = ["".join(rnd.choice(PARTS) for _ in range(rnd.randrange(40))) for _ in range(800)]
    return made + ["", "a" * 5000, " " * 3000, "ab" * 2000 + "c", "\x1c" * 7, " x", "x ", "<|endoftext|><|endoftext|>"]


@pytest.fixture(scope="module")
def reader():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_is_the_librarys(texts, reader):
    codec = bpe_prefix.codec(RANKS, public_tokenizers.PATTERN)
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert [int(i) for i in ids.split()] == reader.encode_ordinary(text)
        assert bpe_prefix.decoder(RANKS).decode(ids) == text.encode()


def test_counts_are_the_librarys(texts):
    library = Tokenizer.from_file(SPEC)
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert token_count.Counter(SPEC, public_tokenizers.PATTERN).count(texts) == want


def test_small_caches_change_nothing(texts, monkeypatch):
    want = token_count.Counter(SPEC, public_tokenizers.PATTERN).count(texts)
    monkeypatch.setattr(token_count, "KEPT", 5)
    monkeypatch.setattr(token_count, "MERGED_CHARS", 50)
    counter = token_count.Counter(SPEC, public_tokenizers.PATTERN)
    assert [n for i in range(0, len(texts), 30) for n in counter.count(texts[i : i + 30])] == want
    codec = bpe_prefix.Codec(bpe_prefix.Vocabulary.from_file(RANKS), public_tokenizers.PATTERN)
    ids = codec.encode(texts)
    monkeypatch.setattr(bpe_prefix, "KEPT_WORDS", 5)
    monkeypatch.setattr(bpe_prefix, "PAIR_PLACES", 1 << 12)
    small = bpe_prefix.Codec(codec.columns.vocabulary, public_tokenizers.PATTERN)
    assert [x for i in range(0, len(texts), 30) for x in small.encode(texts[i : i + 30])] == ids


def test_every_token_is_its_own_encoding():
    vocabulary = bpe_prefix.codec(RANKS, public_tokenizers.PATTERN).columns.vocabulary
    for token, data in vocabulary.tokens.items():
        if len(data) > 1:
            assert vocabulary.stay_apart(*vocabulary.halves(token)) is False


def test_appends_and_edits(reader):
    vocabulary = bpe_prefix.codec(RANKS, public_tokenizers.PATTERN).columns.vocabulary
    rnd = random.Random(2)
    for _ in range(150):
        text = "".join(rnd.choice(["a", "b", "the", "ing", "x", "er", "t", "h", "é"]) for _ in range(rnd.randrange(1, 80))).encode()
        begin = rnd.randrange(len(text) + 1)
        end = rnd.randrange(begin, len(text) + 1)
        new = rnd.choice([b"", b"th", b"zebra"])
        state = bpe_prefix.PrefixEncoder(vocabulary, text[:begin])
        state.append(text[begin:])
        assert state.ids() == reader._encode_single_piece(text)
        state.replace(begin, end, new)
        text = text[:begin] + new + text[end:]
        assert state.data == text and (state.ids() == reader._encode_single_piece(text) if text else not state.ids())


def test_odd_rows(make_docs, odd_rows, reader):
    docs = make_docs(odd_rows)
    encoded = bpe_prefix.encode(docs, RANKS)
    got = sorted(((str(r.doc_id), r.ids, r.n_tokens, bytes(r.decoded)) for r in bpe_prefix.decode(encoded, RANKS).collect()))
    want = [(i, t or "", reader.encode_ordinary(t or "")) for i, t in odd_rows]
    assert got == sorted((str(i), " ".join(map(str, ids)), len(ids), t.encode()) for i, t, ids in want)
    counts = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.count_tokens(docs, SPEC).collect())
    assert counts == sorted((str(i), len(t.encode()), len(ids), len(ids) > 512) for i, t, ids in want)
    assert bpe_prefix.encode(make_docs([]), RANKS).count() == token_count.count_tokens(make_docs([]), SPEC).count() == 0


def test_queries(spark, sf_dir, documents, reader):
    library = Tokenizer.from_file(SPEC)
    counts = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op6_token_counts(spark, sf_dir).collect()}
    coded = {r.doc_id: r for r in queries.op7_byte_bpe(spark, sf_dir).collect()}
    assert len(counts) == len(coded) == len(documents)
    for key, text in documents:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert counts[key] == (len((text or "").encode()), n, n > 512)
        ids = reader.encode_ordinary(text or "")
        assert coded[key].n_tokens == len(ids)
        assert coded[key].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert coded[key].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
