"""Benchmark passages in documents, by one automaton over normalised words (operator 6).

Every run of ``window`` words of a benchmark item is a pattern of one Aho-Corasick automaton; an
item with fewer words is one pattern. A text is normalised the same way, scanned once, and each
match is mapped back to words and characters of the original. Items travel to the tasks in blocks that
bound the nodes of an automaton. With one block, documents are not moved at all; with more, each
block is a pass that writes the runs and items it finds, and these are joined to the texts at the end.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline.llm.batches import held, quoted, show_package, slices
from timberline.sources.scratch import materialize

WINDOW = 10
#: Bytes of benchmark text that one automaton takes; more items make more passes. A window of ten words
#: begins at every word, so there are about ten nodes a byte, which is half a GB of a worker for 1 MB.
BLOCK_BYTES = 1 << 20

#: Word characters are ASCII letters and digits and everything beyond ASCII.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_TO_PLAIN = bytes(
    b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256)
)
_PART = "items array<string>, runs array<struct<first:int,last:int>>"
_FOUND = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:int,end:int>>"


def normalised(text: str) -> bytes:
    """Lower-cased words with one space before and after each; empty without words."""
    words = text.encode().translate(_TO_PLAIN).split()
    return b" " + b" ".join(words) + b" " if words else b""


class Passages:
    """Automaton over the windows of some items."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        owners: dict[str, set[int]] = {}
        names: list[str | None] = [i for i, _ in items]
        for n, (_, text) in enumerate(items):
            words = normalised(text).decode("latin-1").split(" ")[1:-1]
            for i in range(max(1, len(words) - window + 1) if words else 0):
                owners.setdefault(f" {' '.join(words[i : i + window])} ", set()).add(n)
        self.automaton = ahocorasick.Automaton()
        same: dict[frozenset[int], frozenset[str]] = {}  # windows of the same items share their owners
        while owners:
            pattern, of = owners.popitem()
            key = frozenset(of)
            if key not in same:
                same[key] = frozenset(names[n] for n in of if names[n] is not None)
            self.automaton.add_word(pattern, (len(pattern), same[key]))
        if len(self.automaton):
            self.automaton.make_automaton()

    def hits(self, plain: bytes) -> tuple[list[str], list[tuple[int, int]]]:
        """Items that occur, and the first and last word of each run of hit words."""
        if not len(self.automaton) or not plain:
            return [], []
        found = list(self.automaton.iter(plain.decode("latin-1")))
        if not found:
            return [], []
        gaps = np.flatnonzero(np.frombuffer(plain, np.uint8) == 32)
        ends = np.array([end for end, _ in found])
        first = np.searchsorted(gaps, ends - [size - 1 for _, (size, _) in found])
        last = np.searchsorted(gaps, ends) - 1
        items = frozenset().union(*{of for _, (_, of) in found})
        return sorted(items), runs_of(zip(first, last), len(gaps) - 1)


def runs_of(spans, n_words: int) -> list[tuple[int, int]]:
    """First and last word of the runs that spans of words cover."""
    turn = np.zeros(n_words + 1, np.int64)
    for a, b in spans:
        turn[a] += 1
        turn[b + 1] -= 1
    hit = np.concatenate([[False], np.cumsum(turn) > 0])
    turns = np.flatnonzero(hit[1:] != hit[:-1])
    return [(int(a), int(b) - 1) for a, b in zip(turns[::2], turns[1::2])]


def summary(text: str, runs: list[tuple[int, int]]):
    """Number of hit words, and runs of them as characters."""
    if not runs:
        return 0, []
    places = [m.span() for m in _WORD.finditer(text)]
    spans = [{"start": places[a][0], "end": places[b][1]} for a, b in runs]
    return sum(b - a + 1 for a, b in runs), spans


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``(key, n_words, n_hit, items, spans)`` per row of ``docs``.

    ``items`` holds the ids of items that occur, as sorted text; ``spans`` the runs of hit words
    as character offsets of the original, end exclusive. Null and empty texts have no words and
    hit nothing, as documents and as items. Repeated items count once. An item without an id
    marks words but is not listed. Rows with a null or repeated key are rows like any other.
    """
    rows = docs.select(
        F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")
    )
    return _find(rows, benchmark, window, item_key, item_text, block_bytes).withColumnRenamed("key", key)


def without_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with the runs of hit words cut out of ``text``; rows left without words go.

    Rows that nothing hits stay as they are, also without words.
    """
    whole = F.struct(*map(quoted, docs.columns)).alias("key")
    rows = docs.select(whole, F.col(text).cast("string").alias("text"))
    found = _find(rows, benchmark, window, item_key, item_text, block_bytes)
    hit = F.col("n_hit") > 0
    cut = F.when(hit, cut_spans(F.col("key")[text], F.col("spans"))).otherwise(F.col("key")[text])
    return (
        found.where(~hit | (F.col("n_hit") < F.col("n_words")))
        .select(F.col("key").withField(text, cut).alias("key"))
        .select("key.*")
    )


def _find(
    rows: DataFrame, benchmark: DataFrame, window: int, item_key: str, item_text: str, block_bytes: int
) -> DataFrame:
    """Hits of ``(key, text)`` rows; the key may be of any type."""
    show_package(rows.sparkSession)
    items = benchmark.select(
        F.col(item_key).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")
    ).where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = 1 + int(size) // block_bytes
    spark = rows.sparkSession

    def block_of(n: int) -> list[tuple]:
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == n)
        return spark.sparkContext.broadcast([tuple(r) for r in part.collect()])

    found = T.StructType(
        [T.StructField("key", rows.schema["key"].dataType), *T.StructType.fromDDL(_FOUND).fields]
    )
    if blocks == 1:
        return rows.mapInArrow(_scan(block_of(0), window, found.names), found)
    # a long list: each block leaves what it finds, the texts are written once and not moved by it
    texts = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "texts")
    parts = [
        materialize(
            texts.select("row", "text").mapInArrow(_part(block_of(n), window), f"row bigint, {_PART}"),
            f"passages{n}",
        )
        for n in range(blocks)
    ]
    merged = reduce(DataFrame.union, parts).groupBy("row").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.flatten(F.collect_list("runs")).alias("runs"),
    )
    joined = texts.join(merged, "row", "left").select("key", "text", "items", "runs")
    return joined.mapInArrow(_finish(found.names), found)


def _held_passages(sent, window: int):
    label = uuid.uuid4().hex  # of the automaton, which a worker keeps for its next tasks
    return lambda: held(f"passages {label}", lambda: Passages(sent.value, window))


def _batch(key, texts: list[str], plain: list[bytes], hits, names: list[str]) -> pa.RecordBatch:
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    found = [summary(t, runs) for t, (_, runs) in zip(texts, hits)]
    columns = [
        key,
        pa.array([max(0, p.count(b" ") - 1) for p in plain], pa.int64()),
        pa.array([n for n, _ in found], pa.int64()),
        pa.array([i for i, _ in hits], pa.list_(pa.string())),
        pa.array([s for _, s in found], spans_type),
    ]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _scan(sent, window: int, names: list[str]):
    make = _held_passages(sent, window)

    def run(batches):
        passages = make()
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            plain = [normalised(t) for t in texts]
            yield _batch(batch.column(0), texts, plain, [passages.hits(p) for p in plain], names)

    return run


def _part(sent, window: int):
    """Rows that a block hits, with what it finds."""
    make = _held_passages(sent, window)
    runs_type = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    def run(batches):
        passages = make()
        for batch in slices(batches):
            hits = [passages.hits(normalised(t or "")) for t in batch.column(1).to_pylist()]
            kept = [i for i, (_, runs) in enumerate(hits) if runs]
            columns = [
                batch.column(0).take(pa.array(kept, pa.int64())),
                pa.array([hits[i][0] for i in kept], pa.list_(pa.string())),
                pa.array([[{"first": a, "last": b} for a, b in hits[i][1]] for i in kept], runs_type),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "items", "runs"])

    return run


def _finish(names: list[str]):
    def run(batches):
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            plain = [normalised(t) for t in texts]
            hits = []
            for p, items, runs in zip(plain, batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                spans = [(r["first"], r["last"]) for r in runs or []]
                hits.append((items or [], runs_of(spans, max(0, p.count(b" ") - 1)) if spans else []))
            yield _batch(batch.column(0), texts, plain, hits, names)

    return run


def cut_spans(text, spans):
    """SQL expression: a text without the characters of its sorted, disjoint spans."""
    kept = F.aggregate(
        spans,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda s, x: F.struct(
            F.concat(s["out"], F.substr(text, s["at"] + 1, x["start"] - s["at"])).alias("out"),
            x["end"].alias("at"),
        ),
    )
    return F.concat(kept["out"], F.substr(text, kept["at"] + 1))
