"""Quality of documents from random-indexing word vectors (operator 10).

Words and word shapes share a table of hashed rows. Each row has a fixed sparse random vector; its
*word vector* is the sum of the random vectors of what stands next to it anywhere in the corpus,
own vector included. Partial sums are whole numbers, added up over all documents in Spark, so the
table is the same however the work is split, and its size is a parameter. A document is the mean of
its word vectors; a network of two layers, trained with numpy on a bounded sample of labelled rows,
turns that into a score, whose temperature is set on rows the training did not see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.batches import map_texts, show_package, slices
from timberline.sources.scratch import materialize

#: Rows of the word table and of the shape table, and the size of a vector.
WORDS, SHAPES, DIM = 12_288, 2_048, 32
ROWS = WORDS + SHAPES
#: Places of a random vector that are not zero.
PLACES = 4
#: Labelled rows the network is fitted on, at most; taken by hash, all of them where fewer.
SAMPLE = 20_000
#: Partial tables that one task adds up.
FAN_IN = 32
MEMO = 150_000
FEATURES = 2 * DIM + 6

_SHAPE = bytes(
    97 if chr(b).islower() and b < 128 or b >= 128
    else 65 if b < 128 and chr(b).isupper()
    else 57 if b < 128 and chr(b).isdigit()
    else b
    for b in range(256)
)


def random_vectors() -> np.ndarray:
    """The fixed sparse vectors: ``PLACES`` entries of 1 or -1 in each row."""
    rng = np.random.default_rng(20_240_101)
    out = np.zeros((ROWS, DIM), np.int8)
    for row in out:
        row[rng.choice(DIM, PLACES, replace=False)] = rng.choice([-1, 1], PLACES)
    return out


class WordRows(dict):
    """Word -> its row and its shape's row, as one number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        shape = bytes(
            b for a, b in zip(b"\0" + word.translate(_SHAPE), word.translate(_SHAPE)) if a != b
        )
        value = xxhash.xxh3_64_intdigest(word.lower()) % WORDS << 16 | (
            WORDS + xxhash.xxh3_64_intdigest(shape) % SHAPES
        )
        if len(word) <= 64:
            self[word] = value
        return value

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.encode().split()
        both = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return both >> 16, both & 0xFFFF


def _neighbour_sums(table: np.ndarray, near: list[np.ndarray], to: list[np.ndarray], places, signs):
    """Add the random vectors of ``near`` to the rows ``to``."""
    rows, from_ = np.concatenate(to), np.concatenate(near)
    for p in range(PLACES):
        flat = rows * DIM + places[from_, p]
        table += np.bincount(flat, signs[from_, p], len(table)).astype(np.int64)


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The table of word vectors over all documents; rows have length one, unseen rows are zero."""

    def partial(batches):
        vectors = random_vectors()
        places = np.nonzero(vectors)[1].reshape(ROWS, PLACES)
        signs = np.take_along_axis(vectors, places, axis=1).astype(np.float64)
        rows = WordRows()
        table = np.zeros(ROWS * DIM, np.int64)
        near, to, held = [], [], 0
        for batch in slices(batches):
            for t in batch.column(0).to_pylist():
                for ids in rows.of(t or ""):
                    near += [ids, ids[1:], ids[:-1]]
                    to += [ids, ids[:-1], ids[1:]]
                    held += len(ids)
                if held > 500_000:
                    _neighbour_sums(table, near, to, places, signs)
                    near, to, held = [], [], 0
        if held:
            _neighbour_sums(table, near, to, places, signs)
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([table.tobytes()], pa.binary())],
            names=["part", "sums"],
        )

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.int64) for x in frame["sums"])
        return pd.DataFrame({"part": [int(frame["part"].iloc[0]) // FAN_IN], "sums": [total.tobytes()]})

    sums = docs.select(F.col(text).cast("string")).mapInArrow(partial, "part int, sums binary")
    sums = materialize(sums, "sums")
    left = (sums.agg(F.max("part")).first()[0] or 0) + 1
    while left > 1:  # a tree: no task adds up more than FAN_IN tables
        sums = sums.groupBy(F.floor(F.col("part") / FAN_IN)).applyInPandas(add, "part int, sums binary")
        left = -(-left // FAN_IN)
    row = sums.first()
    table = np.frombuffer(row["sums"], np.int64) if row else np.zeros(ROWS * DIM)
    table = table.reshape(ROWS, DIM).astype(np.float64)
    length = np.linalg.norm(table, axis=1)
    return (table / np.where(length == 0, 1, length)[:, None]).astype(np.float32)


def pooled(text: str, rows: WordRows, table: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """Features of a text: mean word and shape vectors, and how alike its words are.

    The latter are, for words and shapes each, the length of the mean of the fixed random vectors,
    the length of the mean word vector, and how often neighbours are the same.
    """
    words, shapes = rows.of(text)
    out = np.zeros(FEATURES)
    if not len(words):
        return out
    at = 2 * DIM
    for i, ids in enumerate((words, shapes)):
        counts = np.bincount(ids, minlength=ROWS)
        seen = np.flatnonzero(counts)
        share = counts[seen] / len(ids)
        mean = share @ table[seen]
        out[i * DIM : (i + 1) * DIM] = mean
        out[at + i] = np.linalg.norm(share @ fixed[seen])
        out[at + 2 + i] = np.linalg.norm(mean)
        out[at + 4 + i] = np.mean(ids[1:] == ids[:-1]) if len(ids) > 1 else 0
    return out


@dataclass
class Network:
    """Two layers, standardised inputs, and a temperature for its probabilities."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0
    #: Whether the rows it was fitted on were of both labels.
    informed: bool = False

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def _log_loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def fit_network(
    x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, rate: float = 0.004, seed: int = 3
) -> Network:
    """Adam on four fifths of the rows, the temperature on the rest.

    Without rows of both labels the network has no opinion beyond the share of label 1 (a half
    without rows).
    """
    rng = np.random.default_rng(seed)
    mean = x.mean(axis=0) if len(x) else np.zeros(FEATURES)
    scale = x.std(axis=0) + 1e-6 if len(x) else np.ones(FEATURES)
    net = Network(
        mean, scale, rng.normal(0, 0.2, (len(mean), hidden)), np.zeros(hidden), np.zeros(hidden), 0.0
    )
    if len(set(y.tolist())) < 2:
        net.b2 = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        return net
    order = rng.permutation(len(x))
    cut = max(1, len(x) // 5)
    later, first = order[:cut], order[cut:]
    net.informed = len(set(y[first].tolist())) == 2
    z = (x - mean) / scale
    params = [net.w1, net.b1, net.w2, np.array([0.0])]
    m = [np.zeros_like(p) for p in params]
    v = [np.zeros_like(p) for p in params]
    t = 0
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(first), max(1, len(first) // 128)):
            t += 1
            a, target = z[batch], y[batch]
            h = np.tanh(a @ params[0] + params[1])
            out = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3][0], -60, 60)))
            d = (out - target) / len(batch)
            back = np.outer(d, params[2]) * (1 - h**2)
            grads = [
                a.T @ back + 1e-4 * params[0], back.sum(axis=0), h.T @ d + 1e-4 * params[2], np.array([d.sum()])
            ]
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                params[i] = params[i] - rate * (m[i] / (1 - 0.9**t)) / (
                    np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8
                )
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    logits = net.logits(x[later])
    net.temperature = min(np.geomspace(0.25, 16, 61), key=lambda s: _log_loss(logits / s, y[later]))
    return net


def in_test_part(key: Column) -> Column:
    """Whether crc32 of the id as text leaves 0 by 5; a row without id is in no part."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _pooler(sent):
    """Makes the function from texts to rows of features; ``sent`` is the broadcast word table."""

    def make():
        table, rows = sent.value, WordRows()
        fixed = random_vectors().astype(np.float64)
        return lambda texts: np.array(
            [pooled(t, rows, table, fixed) for t in texts], np.float32
        ).reshape(-1, FEATURES)

    return make


def fit(
    docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample: int
) -> tuple[Network, Broadcast, DataFrame]:
    """The network, the word table as sent to the tasks, and ``(key, features)`` of all rows."""
    show_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(word_vectors(docs, text))  # ROWS x DIM floats
    pooler = _pooler(sent)

    def make():
        pool = pooler()
        return lambda texts: [
            pa.ListArray.from_arrays(
                pa.array(np.arange(len(texts) + 1) * FEATURES, pa.int32()), pa.array(pool(texts).ravel())
            )
        ]

    features = materialize(map_texts(docs, key, text, make, "features array<float>"), "features")
    known = labels.select(
        F.col(key).cast("long").alias(key), F.col(label).cast("int").alias("label")
    ).where(F.col("label").isin(0, 1) & ~in_test_part(F.col(key)))
    taken = (
        features.join(known, key)
        .orderBy(F.xxhash64(key), "label", "features")
        .limit(sample)
        .toPandas()
    )
    x = np.array(taken["features"].tolist(), np.float64).reshape(-1, FEATURES)
    return fit_network(x, taken["label"].to_numpy(np.float64)), sent, features


def accepted(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    sample: int = SAMPLE,
    threshold: float = 0.3,
) -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more, as they are.

    Each row is judged by its own text; see :func:`score_documents`. All rows pass where the labels
    to learn from are not of both kinds.
    """
    network, sent, _ = fit(docs, labels, key, text, label, sample)
    if not network.informed:
        return docs
    pooler = _pooler(sent)
    at = docs.columns.index(text)

    def choose(batches):
        pool = pooler()
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            keep = network.score(pool(texts).astype(np.float64)) >= threshold
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(choose, docs.schema)


def score_documents(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    sample: int = SAMPLE,
    threshold: float = 0.3,
) -> DataFrame:
    """``(key, held_out, score, predicted)`` per row.

    Only labels of rows outside the held-out part are learnt from, at most ``sample`` of them,
    taken by hash of the id. Nothing but the text decides a score. Null and empty texts have the
    score of a text without words. Labels that are null or neither 0 nor 1 are not used; repeated
    labels count as often as they come. Rows with a null or repeated key are rows like any other.
    """
    network, _, features = fit(docs, labels, key, text, label, sample)

    def apply(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            score = network.score(values.reshape(-1, FEATURES))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score, pa.float64())], names=[key, "score"]
            )

    return (
        features.mapInArrow(apply, f"{key} bigint, score double")
        .select(
            key,
            in_test_part(F.col(key)).alias("held_out"),
            "score",
            (F.col("score") >= threshold).cast("int").alias("predicted"),
        )
    )
