from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from timberline.functions.text import MODES, match, query_tokens, tokens

PIECES = [
    "time", "timeout", "Time", "out", "a", "b", "ab", "x_1", "_", "10", "été", "ñ", "我", "爱我",
    "ab我", "-", ".", " ", "  ", "\n", ":", "'", "ÀB", "٣", "q",
]


def bodies(seed: int, n: int = 400) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 9))) for _ in range(n)]


def brute(mode: str, t: list[str], query: str) -> bool:
    if mode == "MATCH_REGEXP":
        return any(re.search(query, x) for x in t)
    q = query_tokens(query)
    if not q:
        return False
    if mode == "MATCH_ANY":
        return bool(set(q) & set(t))
    if mode == "MATCH_ALL":
        return set(q) <= set(t)
    if mode == "MATCH_PHRASE_EDGE" and len(q) == 1:
        return any(q[0] in x for x in t)

    def fits(i: int, x: str) -> bool:
        if mode == "MATCH_PHRASE_EDGE" and i == 0:
            return x.endswith(q[0])
        if mode != "MATCH_PHRASE" and i == len(q) - 1:
            return x.startswith(q[-1])
        return x == q[i]

    return any(
        all(fits(i, t[s + i]) for i in range(len(q))) for s in range(len(t) - len(q) + 1)
    )


def test_driver_and_engine_cut_the_same_tokens(spark):
    texts = bodies(1)
    rows = spark.createDataFrame([(b,) for b in texts], "body string")
    for body, got in rows.select("body", tokens(F.col("body"))).collect():
        assert got == query_tokens(body)


@pytest.mark.parametrize("mode", list(MODES))
def test_modes_equal_brute_force(spark, mode):
    texts = bodies(2, 600)
    rows = spark.createDataFrame([(b,) for b in texts], "body string")
    queries = ["time", "a b", "time out", "10 a", "b 我", "我 爱", "x_1 ab", "Été", "- -", "a a", "爱 b"]
    if mode == "MATCH_REGEXP":
        queries = ["^tim.*", "b$", "^.$"]
    found = rows.select("body", *[match(F.col("body"), q, mode).alias(f"q{i}") for i, q in enumerate(queries)])
    hits = 0
    for row in found.collect():
        t = query_tokens(row["body"])
        for i, q in enumerate(queries):
            assert row[f"q{i}"] == brute(mode, t, q), (mode, q, row["body"])
            hits += row[f"q{i}"]
    assert hits > 20


def test_no_text_is_no_predicate_and_unknown_mode_means_any(spark):
    rows = spark.createDataFrame([("alpha beta",), ("",), (None,)], "body string")
    assert rows.where(match(F.col("body"), "", "MATCH_ALL")).count() == 3
    assert rows.where(match(F.col("body"), "beta zeta", "NO_SUCH")).count() == 1
    assert rows.where(match(F.col("body"), "--", "MATCH_ANY")).count() == 0


def test_index_equals_scan(spark, tmp_path):
    from timberline.operators.search import (
        build_term_index,
        read_term_index,
        search_index,
        write_term_index,
    )

    texts = bodies(3, 300)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, body string")
    built = build_term_index(docs, keys=["doc_id"])
    write_term_index(built, str(tmp_path / "index"))
    index = read_term_index(spark, str(tmp_path / "index"), built.schema)
    for mode in MODES:
        for query in ["^ti", "b$"] if mode == "MATCH_REGEXP" else ["time", "time out a", "a b", "b 我", "", "--"]:
            scan = docs.where(match(F.col("body"), query, mode))
            found = search_index(index, docs, query, mode, keys=["doc_id"])
            want = sorted(r.doc_id for r in scan.collect())
            assert sorted(r.doc_id for r in found.collect()) == want, (mode, query)
