"""Near duplicates against all pairs."""

from __future__ import annotations

import re

import pytest
from conftest import by_id

from timberline.llm import graph, ngram_join


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(rows, n, percent):
    """Components by id of all pairs; rows that share an id are one document."""
    sets = [(i, shingles(t, n)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for p, (i, a) in enumerate(sets):
        for j, b in sets[:p]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in root}


def family(rng, words, size, edits):
    """Copies of a text with some words replaced."""
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    for _ in range(size):
        text = list(base)
        for _ in range(rng.randrange(edits + 1)):
            text[rng.randrange(words)] = f"e{rng.randrange(40)}"
        yield " ".join(text)


@pytest.fixture
def corpus(rng):
    texts = []
    for words, size, edits in ((120, 60, 6), (40, 30, 3), (12, 30, 2), (9, 20, 2), (6, 20, 1), (700, 12, 40)):
        texts += family(rng, words, size, edits)
    hot = "this passage is in very many of the documents that there are"
    texts += [f"{hot} {' '.join(f'u{rng.randrange(9999)}' for _ in range(rng.randrange(25)))}" for _ in range(60)]
    texts += ["", None, "  \n", "one", "one", "ONE", "one two", "Ünï cödé", "ünï cödé", "x " * 400, "x " * 9]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80)])
def test_equals_all_pairs(frame, corpus, n, percent):
    got = ngram_join.near_duplicates(frame(corpus), n, percent)
    want = brute(list(enumerate(corpus)), n, percent)
    assert {r.doc_id: r.component_id for r in got.collect()} == want
    assert {r.doc_id: r.n_shingles for r in got.collect()} == {
        i: len(shingles(t, n)) for i, t in enumerate(corpus)
    }


def test_spread_and_blocks_change_nothing(frame, corpus, monkeypatch):
    for name, value in (("BLOCK", 3), ("MEMBERS", 2)):
        monkeypatch.setattr(ngram_join, name, value)
    got = ngram_join.near_duplicates(frame(corpus), 4, 85).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(list(enumerate(corpus)), 4, 85)


def test_signatures_lose_no_pair(rng):
    shingler = ngram_join.Shingler(4)
    for _ in range(300):
        words = rng.choice([5, 8, 12, 20, 33, 60, 150])
        a, b = (shingler(t) for t in family(rng, words, 2, max(1, words // 20)))
        common = len(set(a.tolist()) & set(b.tolist()))
        if 100 * common >= 85 * (len(a) + len(b) - common) and a.tolist() != b.tolist():
            shared = set(ngram_join.signatures(a, 85).tolist()) & set(ngram_join.signatures(b, 85).tolist())
            assert shared


def test_difference_bound():
    for size in range(1, 120):
        want = max(
            a + b - 2 * c
            for a in range(1, size + 1)
            for b in range(a, size + 1)
            for c in range(a + 1)
            if 100 * c >= 85 * (a + b - c)
        )
        assert ngram_join.most_different(size, 85) >= want


def test_ids(frame, rng):
    a = " ".join(f"w{i}" for i in range(60))
    b = a.replace("w30", "v30")
    c = " ".join(f"c{i}" for i in range(60))
    texts, ids = [a, b, c, a, c, "alone", None], [5, 9, 7, 7, None, None, None]
    got = ngram_join.near_duplicates(frame(texts, ids), 4, 85).collect()
    # id 7 has the texts a and c, so 5, 7 and 9 are one component
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == [
        (5, 5), (7, 5), (7, 5), (9, 5)
    ]
    assert sorted(str(r.component_id) for r in got if r.doc_id is None) == ["5", "None", "None"]


def test_empty(frame):
    assert ngram_join.near_duplicates(frame(["x"]).limit(0)).count() == 0
    assert by_id(ngram_join.near_duplicates(frame(["one of a kind"])))[0].component_id == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(99, 98), (50, 50)], "a long, b long")
    got = {r.node: r.root for r in graph.components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 98: 98, 99: 98}
