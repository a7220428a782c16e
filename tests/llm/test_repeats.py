"""Repeated byte strings against all starts."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest

from timberline.llm import suffix_dedup


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if counts[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, x in zip(d, gone) if not x)
        runs = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.fixture
def texts(rng):
    def words(n, vocabulary=300):
        return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))

    passages = [words(40) for _ in range(6)]
    out = []
    for _ in range(60):
        text = words(rng.randrange(80))
        for _ in range(rng.randrange(4)):
            text += f" {rng.choice(passages)[rng.randrange(30):]} {words(rng.randrange(40), 50000)}"
        out.append(text)
    out += ["", None, "short", "ab" * 300, "a" * 1000, "é" * 500, out[3], out[3], passages[0]]
    return [*out, f"é{passages[0]}ñ", "x" * 99, "x" * 100, "x" * 101]


@pytest.mark.parametrize("small", [3000, 2])
def test_equals_all_starts(frame, texts, small):
    got = suffix_dedup.remove_repeats(frame(texts), length=100, small=small).collect()
    want = brute(texts, 100)
    assert {r.doc_id: tuple(r)[1:] for r in got} == dict(enumerate(want))


def test_kept_bytes_and_ids(frame):
    a = "".join(chr(97 + i * i % 26) for i in range(500))
    rows = frame([a, a, f"{a}!", "z" * 50], [None, 3, 3, None])
    got = suffix_dedup.remove_repeats(rows, length=400, with_text=True).collect()
    assert sorted(bytes(r.kept) for r in got) == [b"", b"", b"!", b"z" * 50]


def test_anchors_by_slices(monkeypatch):
    values = np.random.default_rng(1).integers(0, 1 << 30, 5000, dtype=np.uint64) << np.uint64(30)
    values[1000:2000] = 7
    whole = suffix_dedup.anchors(values, 50)
    monkeypatch.setattr(suffix_dedup, "_SLICE", 333)
    assert whole.tolist() == suffix_dedup.anchors(values, 50).tolist()
    for i in range(0, len(values) - 49, 7):
        window = values[i : i + 50]
        assert i + 49 - int(np.argmin(window[::-1])) in set(whole.tolist())


@pytest.mark.parametrize("unit", ["a", "ab", "abcdefg ", "wor wor wor no"])
def test_stretches_of_few_bytes(frame, unit):
    """All anchors of such a stretch have one bucket and context; it is a row, not one per byte."""
    texts = [f"{i} {unit * (4000 // len(unit) + i)} {i}" for i in range(20)]
    found = suffix_dedup.text_anchors(frame(texts).withColumnRenamed("doc_id", "id"), 100)
    inner = found.groupBy("bucket", "context").count().agg({"count": "max"}).first()[0]
    assert inner <= 20
    assert found.agg({"n": "sum"}).first()[0] > 20 * 3000 // len(unit)
    got = suffix_dedup.remove_repeats(frame(texts), length=100).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == dict(enumerate(brute(texts, 100)))


def test_empty(frame):
    assert suffix_dedup.remove_repeats(frame(["x"]).limit(0)).count() == 0
