"""Bidiagonalisation against a dense eigendecomposition."""

from __future__ import annotations

import random

import numpy as np
import pytest

from timberline.llm import whitening
from timberline.llm.queries import QUERIES


def dense(vectors):
    """Whole numbers, deviations, eigenvalues and whitened rows by numpy."""
    x = np.floor(1024 * np.asarray(vectors, float)).astype(np.int64) + 100_000
    n, total = len(x), x.sum(axis=0)
    deviation = ((n * x.astype(object) - total.astype(object)) ** 2).sum(axis=1)
    a = x - total / n
    e, u = np.linalg.eigh(a.T @ a / n)
    e, u = e[::-1], u[:, ::-1]
    return deviation.tolist(), e, a @ u / np.sqrt(np.maximum(e, 1e-30))


def held(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r.vec_id, {})[r.component] = r
    return out


def compare(got, ids, vectors, k, places=1e-9):
    deviation, e, w = dense(vectors)
    for c in range(1, k + 1):
        mine = np.array([got[i][c].whitened for i in ids])
        assert min(np.abs(mine - w[:, c - 1]).max(), np.abs(mine + w[:, c - 1]).max()) < places
        assert got[ids[0]][c].explained == pytest.approx(e[c - 1] / e.sum(), rel=1e-9)
    for i, d in zip(ids, deviation):
        assert len(got[i]) == k
        assert got[i][1].deviation == d and got[i][1].n == len(ids)
        assert got[i][1].identity_error < 1e-9


def test_query_equals_dense(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    got = held(QUERIES["op13_whitening"](spark, sf_dir))
    compare(got, [r[0] for r in rows], [r[1] for r in rows], 8)


def test_bad_vectors_and_columns(spark):
    rng = random.Random(2)
    good = [[rng.gauss(0, 1 + j) for j in range(3)] for _ in range(30)]
    bad = [None, [], [1.0, None, 2.0], [1.0, float("nan"), 2.0], [float("inf")] * 3, [1e300, 0.0, 0.0], [1.0]]
    rows = list(enumerate([*good, *bad]))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr(
        "*", "map(1, 2) AS `a.b`", "1 AS x", "2 AS n"
    )
    got = held(whitening.whiten(frame.repartition(4)))
    assert sorted(got) == list(range(30))
    compare(got, list(range(30)), good, 3)


def test_repeated_rows_and_null_ids(spark):
    rows = [(None, [1.0, 2.0]), (5, [3.0, 1.0]), (5, [3.0, 1.0]), (6, [0.0, 7.0])]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    found = sorted((r.vec_id or 0, r.component, r.n) for r in out.collect())
    assert found == [(0, 1, 4), (0, 2, 4), (5, 1, 4), (5, 1, 4), (5, 2, 4), (5, 2, 4), (6, 1, 4), (6, 2, 4)]


def test_nothing_to_scale(spark):
    schema = "vec_id long, embedding array<double>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).collect() == []
    # fewer rows than entries: as many components as there is deviation
    line = [(i, [float(i), 2.0 * i, 0.0]) for i in range(5)]
    assert {r.component for r in whitening.whiten(spark.createDataFrame(line, schema)).collect()} == {1}


@pytest.mark.parametrize("spread", ["flat", "steep", "equal"])
def test_expansion(spread):
    """Few steps where the leading components stand out, all where not, none lost where equal."""
    rng = np.random.default_rng(4)
    scale = {"flat": np.ones(40), "steep": 0.5 ** np.arange(40.0), "equal": np.repeat([5.0, 3.0, 1.0, 0.5], 10)}
    q, _ = np.linalg.qr(rng.standard_normal((200, 40)))
    turn, _ = np.linalg.qr(rng.standard_normal((40, 40)))
    if spread == "flat":
        a = rng.standard_normal((200, 40))
    else:
        a = q * scale[spread] @ turn
    calls = []

    def product(v):
        calls.append(1)
        return a.T @ (a @ v)

    s, vectors = whitening.components(product, 40, 8)
    true = np.linalg.svd(a, compute_uv=False)[:8]
    assert np.abs(s - true).max() < 1e-12 * true[0]
    assert np.abs(vectors @ vectors.T - np.eye(8)).max() < 1e-12
    assert np.abs(a.T @ (a @ vectors.T) - vectors.T * s**2).max() < 1e-11 * true[0] ** 2
    assert len(calls) <= 40
    if spread == "steep":
        assert len(calls) < 36


def test_what_a_restart_gives_up_still_counts():
    """B is U'A V also where a restart cut the expansion while the last vector still led on."""
    rng = np.random.default_rng(5)
    a = rng.standard_normal((60, 12)) * np.linspace(3, 1, 12)
    x = whitening.Expansion(lambda v: a.T @ (a @ v), 12)
    for _ in range(5):
        assert x.step()
    assert x.betas[-1] > 0.1
    x.restart()
    while len(x.v) < 12:
        x.step()
    s, vectors, off = x.triples()
    assert np.abs(s - np.linalg.svd(a, compute_uv=False)).max() < 1e-12 * s[0]
    assert np.abs(a.T @ (a @ vectors.T) - vectors.T * s**2).max() < 1e-12 * s[0] ** 2
    assert off.max() < 1e-13 * s[0]


def test_sums_of_large_numbers():
    x = np.array([[2**61, 1], [2**61, 1], [2**61, 1]])
    assert whitening._exact_sum(x) == [3 * 2**61, 3]
    assert whitening.deviations(np.array([[2**40, 0], [-(2**40), 0]]), 2, [0, 0]) == [None, None]
