"""Fingerprints, pivot tables and components against plain loops."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from timberline.llm import simhash
from timberline.llm.queries import QUERIES


def plain_print(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    whole = [" ".join(words)] if words else []
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else whole
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Smallest id reached, for a list of (id, fingerprint)."""
    lows = [i for i, _ in prints]
    bits = np.array([p for _, p in prints], np.uint64)
    close = np.bitwise_count(bits[:, None] ^ bits) <= 2
    lows = np.array(lows)
    while True:
        now = np.where(close, lows, lows.max()).min(axis=1)
        if (now == lows).all():
            return lows.tolist()
        lows = now


def as_long(value):
    return value - 2**64 if value >= 2**63 else value


def test_query_equals_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    prints = [(r.doc_id, plain_print(r.text)) for r in docs]
    want = {i: (f"{p:016x}", c) for (i, p), c in zip(prints, plain_components(prints))}
    got = QUERIES["op12_simhash"](spark, sf_dir).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == want
    assert len(got) == len(docs)


def test_texts(frame):
    """Nulls, no words, few words, case, other spaces, repeated rows, ids with several texts."""
    texts = [None, "", " \t", "One", "one", "a b", "A\x0bB ", "a b c d", "É b c", "é b c", "a b c d", "x y z"]
    ids = [7, 3, 9, 1, 12, 5, 6, 20, 21, 22, 20, None]
    rows = simhash.near_duplicates(frame(texts, ids)).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.print, r.component_id is None) for r in rows)
    want = sorted((i is None, i or 0, as_long(plain_print(t)), i is None) for i, t in zip(ids, texts))
    assert got == want
    low = {r.doc_id: r.component_id for r in rows}
    assert low[7] == low[3] == low[9] == 3 and low[12] == 1 and low[6] == 5 and low[None] is None
    assert simhash.near_duplicates(frame([])).collect() == []


def test_other_columns(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b c")], "doc_id long, text string")
    odd = docs.selectExpr("*", "map(1, 2) AS `a.b`", "1 AS print", "2 AS id", "3 AS component_id")
    assert {r[0]: r[2] for r in simhash.near_duplicates(odd).collect()} == {1: 1, 2: 1}


def test_long_text_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(500))
    for piece in (1, 7, 498, 499):
        monkeypatch.setattr(simhash, "PIECE", piece)
        assert simhash.fingerprint(text) == plain_print(text)


def _clustered(rng):
    """Fingerprints in crowds: around centres, with one to six bits off, and chains."""
    out = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(150):
            out.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4, 6]))))
        for k in range(0, 40, 2):
            centre ^= 3 << k
            out.add(centre)
    return sorted(out)


@pytest.mark.parametrize("crowd", [2, 64, 10_000])
def test_links_connect_as_all_pairs(spark, monkeypatch, crowd):
    """The same components whether buckets are compared or taken as crowds."""
    from timberline.llm.graph import components

    monkeypatch.setattr(simhash, "CROWD", crowd)
    prints = _clustered(random.Random(1))
    frame = spark.createDataFrame([(as_long(p),) for p in prints], "print long").repartition(4)
    edges = simhash.links(frame)
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    assert edges.where(apart > 2).count() == 0
    root = {r.node: r.root for r in components(edges).collect()}
    want = plain_components([(n, p) for n, p in enumerate(prints)])
    groups = {}
    for p, low in zip(prints, want):
        groups.setdefault(low, set()).add(root.get(as_long(p), as_long(p)))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_every_link_meets_and_no_coordinate_is_far(spark):
    """Any two flipped bits leave a meeting in common; the coordinates differ by two at most."""
    rng = random.Random(2)
    base = rng.getrandbits(64)
    flips = [0, *(1 << i for i in range(64)), *(1 << i | 1 << j for i in range(64) for j in range(i))]
    prints = np.array([base ^ f for f in flips], np.uint64).view(np.int64)
    to = simhash.distances(prints)
    assert np.abs(to.astype(int) - to[0].astype(int)).max() <= simhash.RADIUS
    moved = simhash.coordinates(to)
    same = (moved == moved[0]).all(axis=2).sum(axis=1)
    assert same.min() >= simhash.GROUPS - simhash.RADIUS
    # and they tell apart what is far: hardly any of many strangers is within two everywhere
    strangers = simhash.distances(np.array([rng.getrandbits(64) for _ in range(5_000)], np.uint64).view(np.int64))
    assert (np.abs(strangers.astype(int) - to[0].astype(int)).max(axis=1) <= 2).sum() == 0
