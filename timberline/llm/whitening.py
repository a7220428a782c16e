"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation (operator 13).

Vectors become whole numbers, so that counts, sums and deviations are exact. The centred rows are a
tall matrix A that is never built: it stays in Spark as rows of longs. Bidiagonalisation alternates
products with A and its transpose, u = Av and v = A'u, and orthogonalises each new vector against all
earlier ones. The singular values of the small bidiagonal matrix are the deviations along the
components (times the root of the number of rows); its right singular vectors lead to the components.

A left vector has a number per row. It is a combination of the rows, so what is kept of it are the
few coefficients of that combination: a task makes its part of u from its rows when it needs it, and
one pass over the rows serves both products. Inner products with earlier left vectors follow from
A'u, so reorthogonalising needs no further pass. The driver holds vectors of one row's length only.

The expansion ends when the wanted components stand still to double precision, or when it has as many
vectors as a row has entries. Where it breaks down (components of equal deviation, few rows), and
once more before its answer is taken, it goes on from a fresh vector orthogonal to all before, so
that components of equal deviation are all found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.batches import show_package
from timberline.sources.scratch import materialize

SCALE, SHIFT = 1024, 100_000
#: Entries from here on are no whole numbers of a long any more and count as not finite.
LARGEST = 2.0**50
#: Partial results that go to the driver at a time at most; more are added up in tasks first.
FAN_IN = 256
#: Share of the largest deviation that counts as nothing.
TINY = 1e-13

Product = Callable[[np.ndarray], np.ndarray]


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``(vec_id, x)``: the vectors as whole numbers.

    Rows whose vector is null, empty, or holds null or non-finite entries are left out, and so are
    vectors of another length than the commonest (the shorter of equally common ones): there is no
    covariance between vectors of different length.
    """
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST)
    rows = rows.select(
        F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec")
    ).where(F.col("vec").isNotNull() & (F.size("vec") > 0) & F.forall("vec", fine))
    rows = rows.select(
        "vec_id", F.transform("vec", lambda c: F.floor(c * SCALE) + F.lit(SHIFT).cast("long")).alias("x")
    )
    rows = materialize(rows, "vectors")
    usual = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return rows.where(F.size("x") == (usual["dim"] if usual else 0))


def _matrices(batches: Iterator[pa.RecordBatch], at: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            flat = batch.column(at).flatten().to_numpy()
            yield batch, flat.reshape(batch.num_rows, -1)


def _exact_sum(x: np.ndarray) -> list[int]:
    """Column sums of longs as they are, whatever their size."""
    largest = max(abs(int(x.max())), abs(int(x.min())))
    kind = np.int64 if largest * len(x) < 2**62 else object
    return [int(v) for v in x.astype(kind, copy=False).sum(axis=0)]


def count_and_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of each entry."""

    def run(batches):
        n, sums = 0, None
        for _, x in _matrices(batches):
            part = _exact_sum(x)
            n, sums = n + len(x), part if sums is None else [a + b for a, b in zip(sums, part)]
        if n:
            yield pa.RecordBatch.from_pydict(
                {"n": pa.array([n]), "at": pa.array([[str(s) for s in sums]])}
            )

    parts = rows.select("x").mapInArrow(run, "n long, at array<string>")
    parts = parts.select("n", F.posexplode("at"))
    # a row for each entry of a vector
    sums = (
        parts.groupBy("pos")
        .agg(F.sum("n").alias("n"), F.sum(F.col("col").cast("decimal(38,0)")).alias("total"))
        .orderBy("pos")
        .collect()
    )
    return (sums[0]["n"], [int(r["total"]) for r in sums]) if sums else (0, [])


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Rows less the mean, rounded once: the whole part of the mean goes first, exactly."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n / n for s in sums])
    return (x - whole).astype(np.float64) - rest


def added_up(rows: DataFrame, partitions: int, make: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all matrices of rows of ``make`` (an array of one size)."""

    def partial(batches):
        total = sum(make(x) for _, x in _matrices(batches))
        if isinstance(total, np.ndarray):
            yield pa.RecordBatch.from_pydict({"part": pa.array([total.ravel()])})

    def merge(batches):
        total = sum(m.sum(axis=0) for _, m in _matrices(batches))
        if isinstance(total, np.ndarray):
            yield pa.RecordBatch.from_pydict({"part": pa.array([total])})

    parts = rows.select("x").mapInArrow(partial, "part array<double>")
    while partitions > FAN_IN:
        partitions = -(-partitions // FAN_IN)
        parts = parts.repartition(partitions).mapInArrow(merge, "part array<double>")
    return np.sum([r["part"] for r in parts.collect()], axis=0)


class Expansion:
    """Golub-Kahan-Lanczos vectors of a matrix A that is known by its product A'A v alone.

    With V the right vectors, U = A C the left ones (``c`` holds C) and B the upper bidiagonal matrix
    of ``alphas`` and ``betas``: A V = U B, and A'U = V B' but for the last column. Where it starts afresh,
    the left vector before leads out of V by what was given up, and B = U'A V has entries for it.
    """

    def __init__(self, product: Product, dim: int, seed: int = 17):
        self.product, self.dim = product, dim
        self.rng = np.random.default_rng(seed)
        self.v = np.zeros((0, dim))
        self.c = np.zeros((0, dim))
        self.back = np.zeros((0, dim))  # A'u of every left vector
        self.alphas: list[float] = []
        self.betas: list[float] = []  # the last one belongs to the next right vector
        self.given_up: dict[int, np.ndarray] = {}  # by left vector, what it led to next
        self.next = self.fresh()

    def _off(self, v: np.ndarray) -> np.ndarray:
        """Less its part in all right vectors; twice, as once leaves rounding behind."""
        for _ in range(2):
            v = v - self.v.T @ (self.v @ v)
        return v

    def fresh(self) -> np.ndarray:
        v = self._off(self.rng.standard_normal(self.dim))
        return v / np.linalg.norm(v)

    def largest(self) -> float:
        return max(self.alphas + self.betas, default=0.0)

    def step(self) -> bool:
        """One more pair of vectors; False where the next right vector had to start afresh."""
        v = self.next
        g = v - self.betas[-1] * self.c[-1] if self.betas else v
        back = self.product(g)
        for _ in range(2):
            share = self.c @ back
            g, back = g - self.c.T @ share, back - self.back.T @ share
        squared = float(g @ back)
        # A'A v has only half the digits of a small alpha
        alpha = squared**0.5 if squared > (1e-8 * self.largest()) ** 2 and squared > 0 else 0.0
        if alpha:
            g, back = g / alpha, back / alpha
        else:
            g, back = np.zeros(self.dim), np.zeros(self.dim)
        self.v, self.c = np.vstack([self.v, v]), np.vstack([self.c, g])
        self.back = np.vstack([self.back, back])
        self.alphas.append(alpha)
        if len(self.v) == self.dim:
            self.betas.append(0.0)
            return True
        rest = self._off(back - alpha * v)
        beta = float(np.linalg.norm(rest))
        if beta > TINY * self.largest():
            self.betas.append(beta)
            self.next = rest / beta
            return True
        self.restart()
        return False

    def restart(self) -> None:
        """Go on from a fresh vector; what the last one led to next is given up."""
        if len(self.betas) == len(self.v):
            self.given_up[len(self.v) - 1] = self.betas.pop() * self.next
        self.betas.append(0.0)
        self.next = self.fresh()

    def triples(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Singular values, right singular vectors as rows, and how far each is from settled."""
        k = len(self.v)
        b = np.diag(self.alphas) + np.diag(self.betas[: k - 1], 1)
        off = np.zeros((len(self.given_up) + 1, k))
        for row, rest in self.given_up.items():
            b[row, row + 1 :] = self.v[row + 1 :] @ rest
        p, s, qt = np.linalg.svd(b)
        for i, (row, rest) in enumerate(self.given_up.items()):
            off[i] = np.linalg.norm(self._off(rest)) * p[row]
        off[-1] = self.betas[k - 1] * p[k - 1]
        return s, qt @ self.v, np.abs(off).sum(axis=0)


def components(product: Product, dim: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest singular values and their right vectors, as rows; those of zero are left out."""
    x = Expansion(product, dim)
    confirming, start = False, 0
    while len(x.v) < dim:
        x.step()
        k = len(x.v)
        if k < min(wanted, dim) or k == dim:
            continue
        s, _, off = x.triples()
        if off[:wanted].max() > 1e-15 * max(s[0], 1e-300):
            continue
        if not confirming:
            confirming, start = True, k
            x.restart()
            continue
        # what a fresh vector leads to, in the space all earlier ones leave
        own = np.diag(x.alphas[start:]) + np.diag(x.betas[start : k - 1], 1)
        p, found, _ = np.linalg.svd(own)
        if k - start >= 4 and found[0] + abs(x.betas[k - 1] * p[-1, 0]) < s[: wanted][-1]:
            break
    s, vectors, _ = x.triples()
    real = s[:wanted] > 1e-8 * max(s[0], 1e-300) if s[0] > 0 else np.zeros(len(s[:wanted]), bool)
    return s[:wanted][real], vectors[:wanted][real]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over the entries of (n x - S) squared, exactly; None where it is more than a long."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = [s % n for s in sums]
    near = x - whole
    largest = int(max(near.max(), -near.min())) * n + n
    if largest * largest * x.shape[1] < 2**63:
        return ((near * n - np.array(rest)) ** 2).sum(axis=1).tolist()
    exact = ((near.astype(object) * n - np.array(rest, object)) ** 2).sum(axis=1)
    return [int(v) if v < 2**63 else None for v in exact]


OUT = (
    "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, "
    "identity_error double"
)


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", wanted: int = 8) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``.

    A row for every usable vector (see :func:`usable`) and component, up to ``wanted``, numbered from
    1 by falling deviation. Repeated rows count and come back as often as they are there, a null id
    is carried, other columns play no part. Components without any deviation (fewer rows than
    entries, equal vectors) cannot be scaled to one and have no rows; nor has an empty table.
    ``deviation`` is null where a long cannot hold it. Of components of equal deviation any
    orthogonal choice is right; this one is the same for the same table.
    """
    spark = rows.sparkSession
    show_package(spark)
    x = materialize(usable(rows, key, vector), "whole")
    n, sums = count_and_sums(x)
    if not n:
        return spark.createDataFrame([], OUT)
    partitions = x.rdd.getNumPartitions()
    dim = len(sums)

    def product(g: np.ndarray) -> np.ndarray:
        def make(m):
            a = centred(m, n, sums)
            return a.T @ (a @ g)

        return added_up(x, partitions, make)

    singular, vectors = components(product, dim, min(wanted, dim))
    if not len(singular):
        return spark.createDataFrame([], OUT)
    scaled = (vectors / (singular / n**0.5)[:, None]).T
    k = len(singular)

    def check(m):
        a = centred(m, n, sums)
        w = a @ scaled
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel(), [(a**2).sum()]])

    total = added_up(x, partitions, check)
    mean, square, trace = total[:k] / n, total[k:-1].reshape(k, k) / n, total[-1] / n
    error = float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max())
    explained = (singular**2 / n / trace).tolist()

    def run(batches):
        for batch, m in _matrices(batches, 1):
            w = centred(m, n, sums) @ scaled
            times = np.repeat(np.arange(len(m)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(times)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(m))),
                    pa.array(np.full(len(times), n)),
                    pa.array(deviations(m, n, sums), pa.int64()).take(pa.array(times)),
                    pa.array(w.ravel()),
                    pa.array(np.tile(explained, len(m))),
                    pa.array(np.full(len(times), error)),
                ],
                names=[f.split()[0] for f in OUT.split(", ")],
            )

    return x.select("vec_id", "x").mapInArrow(run, OUT)
