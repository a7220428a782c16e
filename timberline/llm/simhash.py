"""Near-duplicate texts by SimHash fingerprints and tables of pivot distances (operator 12).

A text's fingerprint takes each of its 64 bits from the majority of the XXH64 hashes of its word
shingles. Two fingerprints are linked when they differ in at most two bits.

Every distinct fingerprint gets its Hamming distances to a fixed set of reference fingerprints, once.
By the triangle inequality two fingerprints whose distances to any reference differ by more than two
are no link, so a pair is verified only if no coordinate differs by more. To find the pairs without
comparing all, the references come in groups: those of a group differ from the base reference inside
one stretch of bits only, so distance to the base less distance to them does not change unless a
bit of that stretch does. Two flipped bits leave at least three of the five groups of such
coordinates as they are, and fingerprints meet under the hash of any three groups.

A hash under which more than ``CROWD`` fingerprints meet is not compared pairwise. Its members take
their own neighbours as further references: two of them are within two bits exactly if some
fingerprint is at distance one or zero from both, by the same inequality read the other way. At most
65 fingerprints are that close to a reference, whatever the data, so nothing grows with the square of
a group and no pair is lost.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.batches import map_texts, show_package
from timberline.llm.graph import components
from timberline.sources.scratch import materialize

BITS = 64
SEED = 42
#: Differing bits of a link; the groups below and the neighbours of a crowd are made for it.
RADIUS = 2
GROUPS = RADIUS + 3
#: References a group besides the base one.
PER_GROUP = 8
#: Fingerprints compared pairwise under one hash at most.
CROWD = 64
#: Shingles hashed at a time, so that a long text needs little memory.
PIECE = 50_000


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """Runs of ``size`` words, repeats included; fewer words are one shingle, none are none."""
    if len(words) < size:
        return [b" ".join(words)] if words else []
    return [b" ".join(s) for s in zip(*(words[i:] for i in range(size)))]


def fingerprint(text: str, size: int = 3) -> int:
    """The fingerprint of a text, unsigned; zero without words."""
    words = text.encode().lower().split()
    total = max(len(words) - size + 1, min(len(words), 1))
    counts = np.zeros(BITS, np.int64)
    for start in range(0, total, PIECE):
        part = shingles(words[start : start + PIECE + size - 1], size)
        hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in part], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """``(key, print)`` for every row; the fingerprint as a signed long."""

    def make():
        return lambda texts: [
            pa.array(np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64))
        ]

    return map_texts(docs, key, text, make, "print bigint")


def references() -> np.ndarray:
    """The base reference and, group by group, those that differ from it in one stretch of bits."""
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 2**63)) * 2 + 1
    edges = np.linspace(0, BITS, GROUPS + 1).astype(int)
    out = [base]
    for low, high in zip(edges, edges[1:]):
        for _ in range(PER_GROUP):
            flips = rng.permutation(np.arange(low, high))[: (high - low + 1) // 2]
            out.append(base ^ sum(1 << int(b) for b in flips))
    return np.array(out, np.uint64)


def distances(prints: np.ndarray) -> np.ndarray:
    """A row for each fingerprint (signed longs): its distances to all references."""
    return np.bitwise_count(prints.view(np.uint64)[:, None] ^ references()).astype(np.uint8)


def coordinates(to: np.ndarray) -> np.ndarray:
    """Distance to the base less that to each other reference, as (fingerprint, group, reference)."""
    moved = to[:, :1].astype(np.int8) - to[:, 1:].astype(np.int8)
    return moved.reshape(len(to), GROUPS, PER_GROUP)


def _binary(rows: np.ndarray) -> pa.Array:
    """The rows of a byte matrix as binary values."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(
        pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))]
    )


def _bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def posted(prints: DataFrame) -> DataFrame:
    """``(meet, print, to)``: each fingerprint and its distances under every three groups.

    ``meet`` is a hash of the coordinates of those groups.
    """
    meetings = list(combinations(range(GROUPS), GROUPS - RADIUS))

    def run(batches):
        for batch in batches:
            own = batch.column(0).to_numpy()
            to = distances(own)
            moved = coordinates(to)
            for n, groups in enumerate(meetings):
                keys = np.ascontiguousarray(moved[:, groups, :]).reshape(len(own), -1)
                meet = [xxhash.xxh64_intdigest(k.tobytes(), n) for k in keys]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(meet, np.uint64).view(np.int64)), batch.column(0), _binary(to)],
                    names=["meet", "print", "to"],
                )

    return prints.select("print").mapInArrow(run, "meet bigint, print bigint, to binary")


def verified(pairs: DataFrame) -> DataFrame:
    """Of ``(a, b, to_a, to_b)`` the pairs that are links: coordinates first, then the bits."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            apart = np.abs(_bytes(batch.column(2)).astype(np.int8) - _bytes(batch.column(3)).astype(np.int8))
            near = apart.max(axis=1) <= RADIUS
            near[near] = np.bitwise_count(a[near] ^ b[near]) <= RADIUS
            yield pa.RecordBatch.from_arrays(
                [c.filter(pa.array(near)) for c in batch.columns[:2]], names=["a", "b"]
            )

    return pairs.mapInArrow(run, "a bigint, b bigint")


def links(prints: DataFrame) -> DataFrame:
    """``(a, b)``: enough pairs of linked fingerprints to connect all that are linked.

    Every pair within ``RADIUS`` bits that meets outside crowds, and for crowds a star around each
    reference. ``prints`` are distinct.
    """
    posts = materialize(posted(prints), "pivots")
    crowded = posts.groupBy("meet").agg(F.count("*").alias("n")).where(F.col("n") > CROWD)
    crowded = materialize(crowded.select("meet"), "crowded")
    sparse = posts.join(crowded, "meet", "left_anti")
    left = sparse.select("meet", F.col("print").alias("a"), F.col("to").alias("to_a"))
    right = sparse.select("meet", F.col("print").alias("b"), F.col("to").alias("to_b"))
    met = left.join(right, "meet").where(F.col("a") < F.col("b"))
    pairs = verified(met.select("a", "b", "to_a", "to_b"))
    members = posts.join(crowded, "meet", "left_semi").select("print").distinct()
    beside = F.explode(F.sequence(F.lit(-1), F.lit(BITS - 1)))
    flipped = F.when(F.col("bit") < 0, F.col("print")).otherwise(
        F.col("print").bitwiseXOR(F.expr("shiftleft(1L, bit)"))
    )
    stars = (
        members.select("print", beside.alias("bit"))
        .select("print", flipped.alias("reference"))
        .groupBy("reference")
        .agg(F.min("print").alias("a"), F.collect_list("print").alias("near"))
        .where(F.size("near") > 1)
        .select("a", F.explode("near").alias("b"))
        .where("a <> b")
    )
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """``(key, print, component_id)``, a row for every row of ``docs``.

    ``component_id`` is the smallest id whose fingerprint is reached by links, the row's own
    fingerprint included. Rows are judged by their own text alone: repeated rows get the same
    result, and different texts under one id are not linked by the id. A null text counts as "";
    texts without words have fingerprint zero and are linked like any other. A null id is carried and
    is never the smallest; a component without any id has none. Other columns play no part, whatever
    their names. Memory of a task is bounded by a batch of texts and ``PIECE`` shingles.
    """
    show_package(docs.sparkSession)
    made = fingerprints(docs, key, text, size).withColumnRenamed(key, "id")
    made = materialize(made, "prints")
    classes = materialize(made.groupBy("print").agg(F.min("id").alias("low")), "classes")
    found = components(links(classes.select("print")))
    found = materialize(found.select(F.col("node").alias("print"), "root"), "roots")
    linked = classes.join(found, "print")
    lows = linked.groupBy("root").agg(F.min("low").alias("least"))
    own = F.when(F.col("root").isNull(), F.col("low")).otherwise(F.col("least"))
    named = (
        classes.join(found, "print", "left")
        .join(lows, "root", "left")
        .select("print", own.alias("component_id"))
    )
    return made.join(materialize(named, "named"), "print").select(
        F.col("id").alias(key), "print", "component_id"
    )
