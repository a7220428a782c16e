"""Token counts and SentencePiece against the libraries."""

from __future__ import annotations

import hashlib

import pytest
import sentencepiece
from tokenizers import Tokenizer

from timberline.llm import sentencepieces, token_counts
from timberline.llm.queries import BYTE_BPE, PIECES

PARTS = [
    "a", "b", " ", "  ", "\n", "\r", "\t", "é", "𐍈", "▁", "<s>", "</s>", "<0x41>", "<unk>", "\x00",
    "<|endoftext|>", "<|endof", "\x1c", "\x85", "日本", "의", "the", "ing", " of", "'s", "'re", "'",
    "'ll", "'v", "123", "!!", "...", " ", "﻿", "​", "՘", "₏", "꟎", "AKIA",
    "==", " ", "\U0003fc3f", "̀", "�", "{\r", ");",
]


def strings(rng, n, parts=14):
    mixed = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(parts))) for _ in range(n)]
    wild = [
        "".join(
            chr(rng.choice([rng.randrange(1, 0x250), rng.randrange(0x250, 0xD800), rng.randrange(0xE000, 0x20000)]))
            for _ in range(rng.randrange(20))
        )
        for _ in range(n)
    ]
    return mixed + wild


@pytest.fixture(scope="module")
def byte_bpe():
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    return lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_counts_equal_library(rng, byte_bpe):
    counter = token_counts.PrefixCounter(BYTE_BPE)
    for text in strings(rng, 1500):
        assert counter.count(text) == byte_bpe(text), repr(text)


def test_counts_of_every_prefix(rng, byte_bpe):
    counter = token_counts.PrefixCounter(BYTE_BPE)
    for text in strings(rng, 300):
        want = [byte_bpe(text[:i]) for i in range(len(text) + 1)]
        assert counter.prefix_counts(text).tolist() == want, repr(text)


def test_token_frames(frame, byte_bpe):
    texts = ["It's the end", None, "", "x " * 600, "<|endoftext|>", "It's the end"]
    rows = frame(texts, [0, 1, None, 3, 4, 4])
    got = sorted(map(tuple, token_counts.count_tokens(rows, BYTE_BPE).collect()), key=str)
    want = sorted(
        (
            (i, len((t or "").encode()), byte_bpe(t or ""), byte_bpe(t or "") > 512)
            for i, t in zip([0, 1, None, 3, 4, 4], texts)
        ),
        key=str,
    )
    assert got == want
    for key, text, n in token_counts.truncate(frame(texts[:4]), BYTE_BPE, 5).collect():
        whole = texts[key] or ""
        fits = [i for i in range(len(whole) + 1) if byte_bpe(whole[:i]) <= 5]
        assert text == whole[: fits[-1]] and n == byte_bpe(text)
    table = {r.doc_id: r.counts for r in token_counts.prefix_table(frame(texts[:3]), BYTE_BPE).collect()}
    assert table[2] == [0] and table[1] == [0] and table[0][-1] == byte_bpe(texts[0])


def test_small_memos_change_nothing(rng, monkeypatch, byte_bpe, pieces):
    from timberline.llm import prefix_bpe

    for module in (token_counts, sentencepieces, prefix_bpe):
        monkeypatch.setattr(module, "MEMO", 3)
    counter, model = token_counts.PrefixCounter(BYTE_BPE), sentencepieces.PieceModel(PIECES)
    for text in strings(rng, 100):
        assert counter.count(text) == byte_bpe(text)
        assert model.encode(text) == pieces.encode(text)


def test_pieces_equal_library(rng, pieces):
    model = sentencepieces.PieceModel(PIECES)
    for text in strings(rng, 2500, 30):
        ids = pieces.encode(text)
        assert model.encode(text) == ids, repr(text)
        assert model.decode(ids) == pieces.decode(ids), repr(text)
        assert model.both(text)[2] == pieces.decode(ids)


def test_decoding_any_ids(rng, pieces):
    model = sentencepieces.PieceModel(PIECES)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32000)]) for _ in range(rng.randrange(9))]
        assert model.decode(ids) == pieces.decode(ids), ids


def test_piece_frames(frame, pieces):
    texts = ["Hello  world\n", None, "", "é" * 5000, "x" * 3000]
    for r in sentencepieces.round_trip(frame(texts), PIECES).collect():
        ids = pieces.encode(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(pieces.decode(ids).encode()).hexdigest()
    encoded = sentencepieces.encode(frame(texts), PIECES)
    back = {r.doc_id: r.text for r in sentencepieces.decode(encoded, PIECES).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}


def test_empty_tables(frame, spark):
    none = frame(["x"]).limit(0)
    assert token_counts.count_tokens(none, BYTE_BPE).count() == 0
    assert sentencepieces.round_trip(none, PIECES).count() == 0
