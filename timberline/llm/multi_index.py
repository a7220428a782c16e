"""Nearest neighbours by cosine through an inverted multi-index (operator 5).

Unit vectors are cut into two halves, each half is quantised by its own codebook, and a vector
lives in the cell of its two centroids. A query visits cells by the sum of its two half distances,
taken from a heap, until they hold enough entries; all entries visited are ranked by their exact
cosine. Those of the codebooks' sample that lie in the cells visited tell what a block of entries
need not pass on, and never are a result by themselves. How many entries are enough is measured: for a sample of queries the true neighbours are
found by a full scan, and the traversal is made as long as those need.

Codebooks (``train`` vectors) and the measurement (``probes`` queries) are fitted on bounded
samples; every vector is indexed and every query searched.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timberline.sources.scratch import materialize

#: Vectors the codebooks are fitted on, and queries the length of the traversal is measured on.
TRAIN = 20_000
PROBES = 200
#: Share of true neighbours that the measured queries have to find.
RECALL = 0.97
#: Entries, and queries, that one task compares at a time.
BLOCK = 4_000
RESULT = "query_id bigint, vec_id bigint, score double"


def centroids(points: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Plain k-means; an empty cluster takes the point farthest from its centre."""
    rng = np.random.default_rng(seed)
    centres = points[rng.permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        far = half_distances(points, centres)
        near = far.argmin(axis=1)
        for c in range(len(centres)):
            own = points[near == c]
            centres[c] = own.mean(axis=0) if len(own) else points[far.min(axis=1).argmax()]
    return centres


def half_distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (
        (points**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1) - 2 * points @ centres.T
    )


def traversal(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, enough: float):
    """Cells by summed distance until they hold ``enough`` entries, with the entries so far.

    The heap holds at most one pair per centroid of the first half: pairs of ranks grow from
    (0, 0), and (a, b) brings (a, b + 1), as well as (a + 1, 0) where b is 0.
    """
    by_first, by_second = first.argsort(kind="stable"), second.argsort(kind="stable")
    heap = [(first[by_first[0]] + second[by_second[0]], 0, 0)]
    held = 0
    while heap and held < enough:
        _, a, b = heapq.heappop(heap)
        cell = int(by_first[a]) * len(second) + int(by_second[b])
        if sizes[cell]:
            held += int(sizes[cell])
            yield cell, held
        if b + 1 < len(second):
            heapq.heappush(heap, (first[by_first[a]] + second[by_second[b + 1]], a, b + 1))
        if b == 0 and a + 1 < len(first):
            heapq.heappush(heap, (first[by_first[a + 1]] + second[by_second[0]], a + 1, 0))


def units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1)[:, None]


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def best_of(
    queries: np.ndarray,
    ids: np.ndarray,
    vectors: np.ndarray,
    own: list[list[int]],
    k: int,
    floors: np.ndarray | None = None,
) -> list[tuple[int, int, float, int]]:
    """The k nearest ids of a block for each query, each with its best cosine and that place.

    As (query, id, cosine, place in the block); ``own`` are the ids at a place.

    With ``floors``, only those that are not below the query's floor.
    """
    scores = (queries @ vectors.T) / np.linalg.norm(queries, axis=1)[:, None]
    scores /= np.linalg.norm(vectors, axis=1)
    out = []
    if floors is None:
        floors = np.full(len(ids), -2.0)
    for q, row, floor in zip(ids, scores, floors):
        if row.max() < floor:
            continue
        keep = k + 1  # one of them may be the query itself
        while True:  # more where several vectors have the same id
            keep = min(keep, len(row))
            least = max(floor, np.partition(row, len(row) - keep)[len(row) - keep])
            best: dict[int, tuple[float, int]] = {}
            for j in np.flatnonzero(row >= least):
                for v in own[j]:
                    if v != q and (v not in best or best[v][0] > -row[j]):
                        best[v] = (-row[j], int(j))
            if len(best) >= k or keep == len(row) or least <= floor:
                break
            keep *= 4
        found = heapq.nsmallest(k, ((s, v, j) for v, (s, j) in best.items()))
        out += [(int(q), v, -s, j) for s, v, j in found]
    return out


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``(vec_id, vec)`` of rows with an id and a finite vector of the commonest length, not zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.select(
        F.col(key).cast("long").alias("vec_id"),
        F.col(vector).cast("array<double>").alias("vec"),
    ).where(
        F.col("vec_id").isNotNull()
        & F.forall("vec", finite)
        & F.exists("vec", lambda x: x != 0)
    )
    usual = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return rows.where(F.size("vec") == (usual["dim"] if usual else 0))


def nearest(
    rows: DataFrame,
    every: int = 50,
    k: int = 5,
    key: str = "vec_id",
    vector: str = "embedding",
    recall: float = RECALL,
    train: int = TRAIN,
    probes: int = PROBES,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row whose id ``every`` divides, its k nearest.

    Rows without an id and vectors that are null, zero, of an unusual length or with null or
    non-finite components take no part. Rows with the same id are one item: never neighbours of
    each other, and listed once. Equal vectors share one entry of the index, with the ``k + 1``
    smallest ids, which is all that a result can show of them.
    """
    spark = rows.sparkSession
    clean = materialize(usable(rows, key, vector), "vectors")
    same = Window.partitionBy("vec").orderBy("vec_id")
    entries = materialize(
        clean.dropDuplicates(["vec_id", "vec"])
        .withColumn("n", F.row_number().over(same))
        .where(F.col("n") <= k + 1)
        .groupBy("vec")
        .agg(F.array_sort(F.collect_list("vec_id")).alias("ids")),
        "entries",
    )
    total = entries.count()
    if not total:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    queries = clean.where(F.col("vec_id") % every == 0)

    # two codebooks, about 50 entries a cell
    sample = entries.orderBy(F.xxhash64("vec")).limit(train).toPandas()
    points = units(matrix(sample["vec"]))
    half = max(1, points.shape[1] // 2)
    size = int(np.clip(round((total / 50) ** 0.5), 1, 64))
    books = [
        centroids(points[:, part], min(size, len(points)))
        for part in ([slice(0, half), slice(half, None)] if points.shape[1] > 1 else [slice(0, 1)] * 2)
    ]
    width = len(books[1])

    def halves(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = units(vectors)
        second = v[:, half:] if v.shape[1] > 1 else v
        return half_distances(v[:, :half], books[0]), half_distances(second, books[1])

    def place(frames):
        for frame in frames:
            first, second = halves(matrix(frame["vec"]))
            yield frame.assign(
                cell=(first.argmin(axis=1) * width + second.argmin(axis=1)).astype(np.int32)
            )

    indexed = materialize(
        entries.mapInPandas(place, "vec array<double>, ids array<bigint>, cell int"), "cells"
    )
    sizes = np.zeros(len(books[0]) * width, np.int64)
    for cell, n in indexed.groupBy("cell").count().collect():  # a row per cell at most
        sizes[cell] = n

    # how far a traversal has to go
    tested = queries.orderBy(F.xxhash64("vec_id", "vec")).limit(probes).toPandas()
    if not len(tested):
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    asked, ask_ids = matrix(tested["vec"]), tested["vec_id"].to_numpy()

    def scan(frames):
        for frame in frames:
            own = [list(map(int, x)) for x in frame["ids"]]
            vectors, cells = matrix(frame["vec"]), frame["cell"].to_numpy()
            best = best_of(asked, np.arange(-1, -len(asked) - 1, -1), vectors, own, k + 1)
            found = pd.DataFrame(best, columns=["query_id", "vec_id", "score", "place"])
            yield found.assign(cell=cells[found.pop("place").to_numpy(int)])

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    truth = (
        indexed.mapInPandas(scan, RESULT + ", cell bigint")
        .groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"), F.max_by("cell", "score").alias("cell"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k + 1)
        .toPandas()
    )
    reach = []
    for i, (first, second) in enumerate(zip(*halves(asked))):
        own = truth[(truth["query_id"] == -1 - i) & (truth["vec_id"] != ask_ids[i])]
        upto = dict(traversal(first, second, sizes, np.inf))
        reach += [upto[c] for c in own.sort_values("rank")["cell"][:k]]
    enough = int(np.quantile(reach, recall, method="higher")) if reach else 1

    # the sample by cell: what a query finds there it also finds in the index
    vectors = matrix(sample["vec"])
    first, second = halves(vectors)
    cells = first.argmin(axis=1) * width + second.argmin(axis=1)
    by_cell = cells.argsort(kind="stable")
    known = spark.sparkContext.broadcast(
        (
            units(vectors)[by_cell],
            [list(map(int, sample["ids"].iloc[i])) for i in by_cell],
            np.searchsorted(cells[by_cell], np.arange(len(sizes) + 1)),
        )
    )

    def floor_of(q: int, vector: np.ndarray, visited: list[int]) -> float:
        """Cosine of the k-th id of the sample in the cells visited, and a margin below it."""
        vectors, own, begin = known.value
        at = np.concatenate([np.arange(begin[c], begin[c + 1]) for c in visited] or [np.arange(0)])
        if not len(at):
            return -2.0
        best = best_of(vector[None], np.array([q]), vectors[at], [own[i] for i in at], k)
        return best[-1][2] - 1e-9 if len(best) == k else -2.0

    # blocks of entries against blocks of queries; a full cell and a frequent query are split
    n_blocks = 1 + (queries.count() - 1) // BLOCK
    pieces = np.maximum(1, -(-sizes // BLOCK)).astype(int).tolist()

    def visit(frames):
        for frame in frames:
            out = []
            vectors = matrix(frame["vec"])
            for q, v, vector, first, second in zip(
                frame["vec_id"], frame["vec"], vectors, *halves(vectors)
            ):
                visited = [c for c, _ in traversal(first, second, sizes, enough)]
                floor = floor_of(int(q), vector, visited)
                out += [(c, piece, int(q), v, floor) for c in visited for piece in range(pieces[c])]
            for i in range(0, len(out), 20_000):
                yield pd.DataFrame(out[i : i + 20_000], columns=["cell", "piece", "query_id", "vec", "least"])

    split = spark.createDataFrame(
        [(c, n) for c, n in enumerate(pieces) if n > 1] or [(-1, 1)], "cell int, pieces int"
    )
    stored = (
        indexed.join(F.broadcast(split), "cell", "left")  # a row per cell at most
        .withColumn("piece", F.pmod(F.xxhash64("vec"), F.coalesce("pieces", F.lit(1))).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
        .select("cell", "piece", "block", "vec", "ids")
    )
    asking = (
        queries.repartition(spark.sparkContext.defaultParallelism, "vec_id")
        .mapInPandas(
            visit, "cell int, piece int, query_id bigint, vec array<double>, least double"
        )
        .withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int"))
    )

    def compare(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "vec_id", "score"]
        if not len(left) or not len(right):
            return pd.DataFrame([], columns=columns)
        own = [list(map(int, x)) for x in left["ids"]]
        best = best_of(
            matrix(right["vec"]), right["query_id"].to_numpy(), matrix(left["vec"]), own, k,
            right["least"].to_numpy(),
        )
        return pd.DataFrame([b[:3] for b in best], columns=columns)

    on = ["cell", "piece", "block"]
    return (
        stored.groupBy(*on)
        .cogroup(asking.groupBy(*on))
        .applyInPandas(compare, RESULT)
        .groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(order).cast("int"))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
