"""Removal of long byte strings that occur more than once (operator 7).

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else. Suffixes are
compared by bucket-pointer refinement: strings of half that length are put into buckets, and a
string of full length is known by the bucket it starts in and the bucket half a length later.

Only strings around *anchors* are compared. Anchors are the positions whose half-length string has
the least hash among the positions of a stretch of half a length plus one; each string of full
length holds such a stretch and so an anchor, at the same offset wherever the string occurs. The
steps:

1. Every anchor has the hash of its bucket string and of its *context*, all bytes that strings of
   full length around it can reach. Neighbouring anchors of a text that have both in common, as in a
   stretch that repeats a few bytes, are one row. Counts combine before their shuffle.
2. Anchors with a bucket of their own are done: nothing around them recurs. Anchors whose whole
   context recurs are done too, every string around them does. What is left, and one anchor of
   each recurring context, gets its bytes from a second scan of the texts.
3. Small buckets are refined in one task. Large ones are refined in Spark by halving the stretch of
   starts: the bytes that all starts of a half have in common are hashed and counted, and halves
   whose common bytes are unique are dropped, until single starts remain.

Rolling hashes are polynomials modulo 2^64 over random byte values, mixed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.batches import slices
from timberline.sources.scratch import materialize

LENGTH = 400
#: Anchors of a bucket that one task refines; larger buckets are refined by counting in Spark.
SMALL = 3_000

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_RANDOM = np.random.default_rng(0x5EED).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, _U)
    out[:1] = 1
    return np.multiply.accumulate(out)


_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))


class Prefixes:
    """Hashes of all strings of a text, from sums over its prefixes."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, _U)
        np.cumsum(_RANDOM[data] * _powers(n), out=self.sums[1:])
        back = np.full(n + 1, _INVERSE, _U)
        back[0] = 1
        self.back = np.multiply.accumulate(back)

    def hashes(self, starts, size) -> np.ndarray:
        """Hash of ``size`` bytes at each start; equal strings have equal hashes anywhere."""
        return _mix((self.sums[starts + size] - self.sums[starts]) * self.back[starts])


def anchors(bucket: np.ndarray, stretch: int) -> np.ndarray:
    """Positions of the last least value in any ``stretch`` neighbours, ascending."""
    found = [np.zeros(0, np.int64)]
    for start in range(0, len(bucket) - stretch + 1, _SLICE):
        part = bucket[start : start + _SLICE + stretch - 1]
        # the place in the low bits makes the later of equal values the least
        place = np.arange(len(part), dtype=np.uint64)
        least = (part & ~_U(0xFFFFFF)) | (_U(0xFFFFFF) - place)
        n, width = len(part) - stretch + 1, 1
        while 2 * width <= stretch:
            least = np.minimum(least[: len(least) - width], least[width:])
            width *= 2
        least = np.minimum(least[:n], least[stretch - width : stretch - width + n])
        picks = np.unique(_U(0xFFFFFF) - (least & _U(0xFFFFFF)))
        found.append(picks.astype(np.int64) + start)
    return np.unique(np.concatenate(found))


#: Positions handled at a time, below the 2^24 that tell ties apart.
_SLICE = 1 << 22


def text_anchors(docs: DataFrame, length: int) -> DataFrame:
    """``(id, size, pos, extent, n, bucket, context)``: the anchors of each text.

    A row stands for ``n`` neighbouring anchors with one bucket and context, from ``pos`` to
    ``pos + extent``. Neighbours are at most a stretch apart, so what they cover has no gap.
    """
    half = length // 2

    def run(batches):
        for batch in slices(batches):
            out: list[list[np.ndarray]] = [[] for _ in _ANCHOR]
            held = 0
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
                if len(data) < length:
                    continue
                prefixes = Prefixes(data)
                buckets = prefixes.hashes(np.arange(len(data) - half + 1), half)
                pos = anchors(buckets, length - half + 1)
                first = np.maximum(pos - (length - half), 0)
                end = np.minimum(pos + length, len(data))
                context = _mix(
                    prefixes.hashes(first, end - first)
                    + (pos - first).astype(np.uint64) * _BASE
                    + _mix((end - first).astype(np.uint64))
                )
                bucket = buckets[pos]
                new = (bucket[1:] != bucket[:-1]) | (context[1:] != context[:-1])
                at = np.flatnonzero(np.concatenate([[True], new]))
                n = np.diff(at, append=len(pos))
                columns = (
                    np.full(len(at), own), np.full(len(at), len(data)), pos[at],
                    pos[at + n - 1] - pos[at], n, bucket[at].view(np.int64), context[at].view(np.int64),
                )
                for o, c in zip(out, columns):
                    o.append(c)
                held += len(at)
                if held > 100_000:
                    yield _batch(out, _ANCHOR)
                    out, held = [[] for _ in _ANCHOR], 0
            if held:
                yield _batch(out, _ANCHOR)

    return docs.select("id", "text").mapInArrow(
        run,
        "id bigint, size bigint, pos bigint, extent bigint, n bigint, bucket bigint, context bigint",
    )


_ANCHOR = ["id", "size", "pos", "extent", "n", "bucket", "context"]


def _batch(columns: list[list[np.ndarray]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(c).astype(np.int64)) for c in columns], names=names
    )


def surroundings(docs: DataFrame, open_: DataFrame, length: int) -> DataFrame:
    """``(bucket, count, id, pos, settled, lead, around)``: open anchors with the bytes around.

    ``lead`` tells how many bytes before the anchor there are in ``around``.
    """
    reach = length - length // 2
    per_text = open_.groupBy("id").agg(
        F.collect_list(F.struct("pos", "bucket", "count", "settled")).alias("places")
    )
    names = ["bucket", "count", "id", "pos", "settled", "lead", "around"]

    def run(batches):
        for batch in slices(batches):
            rows = []
            for own, text, places in zip(*(c.to_pylist() for c in batch.columns)):
                data = text.encode("utf-8", "surrogatepass")
                for p in places:
                    first = max(0, p["pos"] - reach)
                    rows.append(
                        (
                            p["bucket"], p["count"], own, p["pos"], p["settled"],
                            p["pos"] - first, data[first : p["pos"] + length],
                        )
                    )
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([*map(pa.array, zip(*rows))], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([*map(pa.array, zip(*rows))], names=names)

    texts = docs.select("id", "text").join(per_text, "id")
    return texts.mapInArrow(
        run,
        "bucket bigint, count bigint, id bigint, pos bigint, settled boolean, lead bigint, "
        "around binary",
    )


def _matrix(lead: np.ndarray, around: list[bytes], length: int):
    """Sums over prefixes of the aligned surroundings, and which starts are within the text."""
    reach = length - length // 2
    width = reach + length
    data = np.zeros((len(around), width), np.uint8)
    for row, shift, b in zip(data, reach - lead, around):
        row[shift : shift + len(b)] = np.frombuffer(b, np.uint8)
    sums = np.zeros((len(around), width + 1), _U)
    np.cumsum(_RANDOM[data] * _powers(width), axis=1, out=sums[:, 1:])
    starts = np.arange(reach + 1)
    size = np.array([len(b) for b in around])
    inside = (starts >= (reach - lead)[:, None]) & (
        starts + length <= (reach - lead + size)[:, None]
    )
    back = np.full(width + 1, _INVERSE, _U)
    back[0] = 1
    return sums, inside, np.multiply.accumulate(back)


def _stretches(hit: np.ndarray, first: np.ndarray, length: int):
    """Row, first byte and end of each run of hit starts."""
    padded = np.zeros((len(hit), hit.shape[1] + 2), bool)
    padded[:, 1:-1] = hit
    row, edge = np.nonzero(padded[:, 1:] != padded[:, :-1])
    row, begin, end = row[::2], edge[::2], edge[1::2]
    return row, first[row] + begin, first[row] + end - 1 + length


def _refine(length: int):
    """Bytes covered by strings that recur within a bucket; batches are sorted by bucket."""
    half = length // 2
    reach = length - half

    def covered(table: pa.Table) -> pa.RecordBatch:
        bucket, _, own, pos = (table.column(i).to_numpy() for i in range(4))
        settled = table.column("settled").to_numpy(zero_copy_only=False).astype(bool)
        lead = table.column("lead").to_numpy()
        sums, inside, back = _matrix(lead, table.column("around").to_pylist(), length)
        # buckets of half-length strings, then pairs of buckets half a length apart
        grams = _mix((sums[:, half:] - sums[:, :-half]) * back[: sums.shape[1] - half])
        pairs = _mix(grams[:, : reach + 1] * _BASE + grams[:, half : half + reach + 1])
        place = np.arange(reach + 1, dtype=np.uint64) * _U(0xC2B2AE3D27D4EB4F)
        names = _mix(pairs + place + _mix(bucket.view(np.uint64))[:, None])
        at = np.flatnonzero(inside)
        order = at[np.argsort(names.ravel()[at], kind="stable")]
        values = names.ravel()[order]
        same = values[1:] == values[:-1]
        hit = np.zeros(names.size, bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        hit = hit.reshape(names.shape) & ~settled[:, None]
        row, begin, end = _stretches(hit, pos - reach, length)
        return _batch([[own[row]], [begin], [end]], ["id", "begin", "end"])

    def run(batches):
        held = None
        for batch in batches:
            for start in range(0, batch.num_rows, 2_000):
                table = pa.Table.from_batches([batch.slice(start, 2_000)])
                if held is not None:
                    table = pa.concat_tables([held, table]).combine_chunks()
                bucket = table.column("bucket").to_numpy()
                whole = int(np.flatnonzero(bucket != bucket[-1]).max(initial=-1)) + 1
                if whole:
                    yield covered(table.slice(0, whole).combine_chunks())
                held = table.slice(whole)
        if held is not None and len(held):
            yield covered(held.combine_chunks())

    return run


def _common_bytes(length: int, names: list[str]):
    """Adds the hash of the bytes that all starts from ``low`` to ``high`` have in common."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 2_000):
                part = batch.slice(start, 2_000)
                low, high, lead = (
                    part.column(part.schema.get_field_index(c)).to_numpy()
                    for c in ("low", "high", "lead")
                )
                around = part.column(part.schema.get_field_index("around")).to_pylist()
                sums, _, back = _matrix(lead, around, length)
                row = np.arange(len(low))
                value = _mix((sums[row, low + length] - sums[row, high]) * back[high])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(value.view(np.int64))], names=[*names, "core"]
                )

    return run


def _halved(open_: DataFrame, length: int) -> DataFrame:
    """``(id, begin, end)`` for large buckets, by halving the stretch of starts in Spark."""
    reach = length - length // 2
    rows = open_.withColumn("low", F.lit(0)).withColumn("high", F.lit(reach))
    schema = (
        "bucket bigint, id bigint, pos bigint, settled boolean, lead bigint, around binary, "
        "low int, high int"
    )
    names = [part.split()[0] for part in schema.split(", ")]
    covered = None
    while True:
        cores = rows.select(*names).mapInArrow(_common_bytes(length, names), schema + ", core bigint")
        cores = materialize(cores, "cores")
        key = ["bucket", "low", "high", "core"]
        again = materialize(
            cores.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "again"
        )
        kept = cores.join(again, key, "left_semi")
        done = kept.where("low = high and not settled").select(
            "id",
            (F.col("pos") - reach + F.col("low")).alias("begin"),
            (F.col("pos") - reach + F.col("low") + length).alias("end"),
        )
        covered = done if covered is None else covered.union(done)
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        first, last = reach - F.col("lead"), reach - F.col("lead") + F.length("around") - length
        rows = (
            kept.where("low < high")
            .withColumn(
                "part",
                F.explode(
                    F.array(
                        F.struct(F.col("low").alias("low"), middle.alias("high")),
                        F.struct((middle + 1).alias("low"), F.col("high").alias("high")),
                    )
                ),
            )
            .drop("low", "high", "core")
            .select("*", "part.*")
            .where((F.col("low") <= last) & (F.col("high") >= first))
        )
        rows = materialize(rows.select(*names), "halves")
        if rows.isEmpty():
            return covered


def remove_repeats(
    docs: DataFrame,
    length: int = LENGTH,
    key: str = "doc_id",
    text: str = "text",
    small: int = SMALL,
    with_text: bool = False,
) -> DataFrame:
    """``(key, n_bytes, n_removed, n_spans, kept_sha256)`` per row, and the kept bytes on request.

    Texts are taken as UTF-8; null and empty ones have no bytes, and texts shorter than ``length``
    lose none. Rows with equal texts repeat each other, also under the same key or a null one.
    Removed runs may begin and end within a character. Texts are told apart by a 64-bit hash and
    their size. ``small`` changes the way and not the result.
    """
    rows = docs.select(
        F.col(key).cast("long").alias("key"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    ).withColumn("id", F.xxhash64("text", F.octet_length("text")))
    found = materialize(text_anchors(rows, length), "anchors")
    contexts = materialize(
        found.groupBy("bucket", "context").agg(
            F.sum("n").alias("n"), F.min(F.struct("id", "pos")).alias("one")
        ),
        "contexts",
    )
    # strings of other contexts can only recur where a bucket has several
    buckets = contexts.groupBy("bucket").agg(F.count("*").alias("count")).where("count > 1")
    open_ = materialize(
        contexts.join(buckets, "bucket").select(
            "bucket", "count", "one.id", "one.pos", (F.col("n") > 1).alias("settled")
        ),
        "open",
    )
    whole = (
        found.join(contexts.where("n > 1").select("bucket", "context"), ["bucket", "context"])
        .select(
            "id",
            F.greatest(F.col("pos") - (length - length // 2), F.lit(0)).alias("begin"),
            F.least(F.col("pos") + F.col("extent") + length, "size").alias("end"),
        )
    )
    places = materialize(surroundings(rows, open_, length), "surroundings")
    covered = (
        places.where(F.col("count") <= small)
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_refine(length), "id bigint, begin bigint, end bigint")
    )
    covered = covered.union(whole)
    large = places.where(F.col("count") > small)
    if not large.isEmpty():
        covered = covered.union(_halved(large, length))
    per_text = covered.groupBy("id").agg(
        F.collect_set(F.struct("begin", "end")).alias("covered")
    )
    extra = ", kept binary" if with_text else ""
    names = [key, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])]

    def cut(batches):
        for batch in slices(batches):
            out = []
            for own, t, spans in zip(*(c.to_pylist() for c in batch.columns)):
                data = t.encode("utf-8", "surrogatepass")
                parts, at, removed, runs = [], 0, 0, 0
                for begin, end in sorted((s["begin"], s["end"]) for s in spans or []):
                    if begin > at or not runs:
                        parts.append(data[at:begin])
                        runs += 1
                        at = begin
                    if end > at:
                        removed += end - at
                        at = end
                parts.append(data[at:])
                kept = b"".join(parts)
                sha = hashlib.sha256(kept).hexdigest()
                out.append((own, len(data), removed, runs, sha, *([kept] if with_text else [])))
            columns = list(zip(*out)) or [()] * len(names)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()][: len(names) - 4]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=names
            )

    return (
        rows.join(materialize(per_text, "covered"), "id", "left")
        .select("key", "text", "covered")
        .mapInArrow(
            cut,
            f"{key} bigint, n_bytes bigint, n_removed bigint, n_spans bigint, "
            f"kept_sha256 string{extra}",
        )
    )
