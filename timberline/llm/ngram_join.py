"""Near duplicates by Jaccard similarity of word n-grams, through PartEnum signatures (operator 1).

Sets are dealt to bands of about equal size. Within a band, sets that are similar enough differ in
at most k features, k being fixed by the band. The feature domain is cut into more parts than k
differences can touch, subsets of the parts are enumerated, and the features of a subset make one
signature: two similar sets share at least one of them, so no link is lost. Candidates are then
checked exactly.

How pairs within a group are avoided:

* equal sets are one class before anything is compared;
* a signature's classes are first compared with one of them only, the one with most shared
  signatures, and the links found make components;
* then pairs are looked at only where a signature still joins different components, and go on
  only if a sketch of parity bits, a lower bound of their difference, allows a link.

Class ids are 64-bit hashes of sets; a collision of two among 10^9 different sets has a chance of
3 in 100.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.batches import slices
from timberline.llm.graph import components
from timberline.sources.scratch import materialize

#: Ratio of the largest to the smallest size in a band.
BAND = 1.3
#: Up to so many differences, subsets of two parts are enumerated, above it single parts.
PAIRED = 3
#: Parts beyond those that differences can touch; sets with more empty parts are treated apart.
SLACK = 2
#: Times that a task sends a signature on before it starts to spread it over ``SPREAD`` keys.
FREQUENT, SPREAD, COUNTED = 32, 16, 1 << 19
#: Power of two of the bits that a filter of ids has at most (64 MB).
FILTER_BITS = 29
#: Classes of one signature that a task compares with each other, and texts with one of them.
BLOCK, MEMBERS = 1024, 512
MEMO = 200_000

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingler(dict):
    """Sets of hashed word n-grams; as a dict, word -> hash."""

    def __init__(self, n: int):
        self.n = n

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value

    def __call__(self, text: str) -> np.ndarray:
        """Sorted distinct hashes; words are split at ASCII white space, A-Z lower-cased."""
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, _U)
        h = np.fromiter(map(self.__getitem__, words), _U, len(words))
        width = min(self.n, len(h))
        count = len(h) - width + 1
        out = np.full(count, width, _U)
        for i in range(width):  # words are hashed already; a mix of their sum is enough
            out *= _U(0x9E3779B97F4A7C15)
            out += h[i : count + i]
        return np.unique(_mix(out))


def class_of(features: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(features.tobytes()) - (1 << 63)


def sketch(features: np.ndarray) -> bytes:
    """Parity of the features in each slot, as bits; at least two slots for each feature."""
    slots = 1 << max(9, (2 * len(features) - 1).bit_length())
    place = (features & _U(slots - 1)).astype(np.intp)
    odd = (np.bincount(place, minlength=slots) & 1).astype(np.uint8)
    return np.packbits(odd).tobytes()


def folded(bits: bytes, size: int) -> np.ndarray:
    """A sketch in ``size`` bytes, as words: slots that meet in the shorter one are added."""
    words = np.frombuffer(bits, np.uint64).reshape(-1, size // 8)
    return np.bitwise_xor.reduce(words, axis=0)


def most_different(size: int, percent: int) -> int:
    """Largest difference of two linked sets, the larger of which has at most ``size`` features."""
    best = 0
    for total in range(max(2, 2 * size - 2 * 100), 2 * size + 1):
        common = -(-percent * total // (100 + percent))
        best = max(best, total - 2 * common)
    return best


@lru_cache(maxsize=None)
def bands(percent: int) -> tuple[tuple[int, int, int], ...]:
    """(smallest, largest size, differences) of each band that can link different sets."""
    out, low = [], 1
    while low < 1 << 40:
        high = max(low, int(low * BAND))
        k = most_different(high, percent)
        if k:
            out.append((low, high, k))
        low = high + 1
    return tuple(out)


@lru_cache(maxsize=4096)
def _edges(parts: int) -> np.ndarray:
    return np.array([(p << 64) // parts for p in range(1, parts)], _U)


def signatures(features: np.ndarray, percent: int) -> np.ndarray:
    """Signatures of a set, for its own band and the bands of larger sets it may link with."""
    size = len(features)
    out = []
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(_mix(features + _U(1)), dtype=_U)])
    for number, (low, high, k) in enumerate(bands(percent)):
        if high < size:
            continue
        if 100 * size < percent * low:
            break
        parts = k + 2 if k <= PAIRED else k + 1 + SLACK
        cuts = np.concatenate([[0], np.searchsorted(features, _edges(parts)), [size]])
        own = sums[cuts[1:]] - sums[cuts[:-1]]
        tag = np.arange(parts, dtype=_U) + _U(number << 32)
        own = _mix(own + _mix(tag))
        if k <= PAIRED:
            a, b = np.triu_indices(parts, 1)
            own = _mix(own[a] * _U(3) + own[b])
        else:
            full = np.diff(cuts) > 0
            # k differences leave SLACK + 1 parts equal, so one that is not empty, unless
            # both sets have more empty parts than SLACK; those show them as well
            if parts - full.sum() <= SLACK:
                own = own[full]
        out.append(own)
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def document_sets(
    docs: DataFrame, n: int, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(doc, size, class, bits)`` per row; the class and sketch of an empty set are null."""

    def run(batches):
        shingles = Shingler(n)
        for batch in slices(batches):
            sets = [shingles(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([class_of(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([sketch(s) if len(s) else None for s in sets], pa.binary()),
                ],
                names=["doc", "size", "class", "bits"],
            )

    return _picked(docs, key, text).mapInArrow(
        run, "doc bigint, size bigint, class bigint, bits binary"
    )


def _picked(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(
        F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text")
    )


def shared_signatures(
    docs: DataFrame, n: int, percent: int, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(sig, class)``: signatures that more than one class has.

    A task sends each class on once. Signatures it meets often go to several keys, always after
    the first ones have gone to the plain key, where they are seen to be shared. It counts them
    in a table of fixed size, where a newer signature takes the place of an older one.
    """

    def emit(batches):
        shingles, sent = Shingler(n), set()
        last, times = np.zeros(COUNTED, np.int64), np.zeros(COUNTED, np.int32)
        for batch in slices(batches):
            sigs, salts, classes = [], [], []
            for t in batch.column(1).to_pylist():
                features = shingles(t or "")
                own = class_of(features)
                if not len(features) or own in sent:
                    continue
                if len(sent) >= COUNTED:
                    sent.clear()
                sent.add(own)
                found = signatures(features, percent)
                # how often in a row a place of the table has seen this signature
                place = found & (COUNTED - 1)
                seen = np.where(last[place] == found, times[place] + 1, 1)
                last[place], times[place] = found, seen
                salt = np.where(seen > FREQUENT, 1 + own % SPREAD, 0).astype(np.int32)
                sigs.append(found)
                salts.append(salt)
                classes.append(np.full(len(found), own, np.int64))
            if sigs:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in (sigs, salts, classes)],
                    names=["sig", "salt", "class"],
                )

    def shared(batches):
        held = None  # the last row: sig, salt, class, whether the row before has the same key
        for batch in batches:
            if not batch.num_rows:
                continue
            sig, salt, own = (c.to_numpy() for c in batch.columns)
            before = False
            if held is not None:
                sig, salt, own = (
                    np.concatenate([[h], x]).astype(x.dtype) for h, x in zip(held, (sig, salt, own))
                )
                before = held[3]
            new = np.ones(len(sig), bool)  # a class again under the same key goes
            new[1:] = (sig[1:] != sig[:-1]) | (salt[1:] != salt[:-1]) | (own[1:] != own[:-1])
            sig, salt, own = sig[new], salt[new], own[new]
            same = (sig[1:] == sig[:-1]) & (salt[1:] == salt[:-1])
            keep = np.concatenate([[before], same]) | np.concatenate([same, [False]]) | (salt > 0)
            held = (sig[-1], salt[-1], own[-1], bool(same[-1]) if len(same) else before)
            keep[-1] = False
            yield pa.RecordBatch.from_arrays(
                [pa.array(sig[keep]), pa.array(own[keep])], names=["sig", "class"]
            )
        if held is not None and (held[3] or held[1] > 0):
            yield pa.RecordBatch.from_arrays(
                [pa.array([held[0]], pa.int64()), pa.array([held[2]], pa.int64())],
                names=["sig", "class"],
            )

    return (
        _picked(docs, key, text)
        .mapInArrow(emit, "sig bigint, salt int, class bigint")
        .repartition("sig", "salt")
        .sortWithinPartitions("sig", "salt", "class")
        .mapInArrow(shared, "sig bigint, class bigint")
    )


def _may_link(percent: int, a, b, different):
    """Whether sets of sizes a and b can be linked if they differ in so many features at least."""
    near = 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
    return near & ((100 - percent) * (a + b) >= (100 + percent) * different)


def possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` that sizes and sketches do not rule out."""

    def run(batches):
        for batch in batches:
            a, b, size_a, size_b = (batch.column(i).to_numpy() for i in range(4))
            different = np.zeros(len(a), np.int64)
            sketches = (batch.column(i).to_pylist() for i in (4, 5))
            for i, (x, y) in enumerate(zip(*sketches)):
                width = min(len(x), len(y))
                different[i] = np.bitwise_count(folded(x, width) ^ folded(y, width)).sum()
            keep = _may_link(percent, size_a, size_b, different)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"]
            )

    side = lambda x: classes.select(
        F.col("class").alias(x), F.col("size").alias(f"size_{x}"), F.col("bits").alias(f"bits_{x}")
    )
    low, high = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
    return (
        pairs.join(side("a"), "a")
        .join(side("b"), "b")
        .where(100 * low >= percent * high)
        .select("a", "b", "size_a", "size_b", "bits_a", "bits_b")
        .mapInArrow(run, "a bigint, b bigint")
    )


def only_ids(rows: DataFrame, name: str, ids: DataFrame) -> DataFrame:
    """Rows whose id may be among ``ids``, to move fewer of them in a join that follows.

    A bit set with 16 bits for each id, ``FILTER_BITS`` at most, is filled by Spark in pieces of
    2^16 bits and sent to the tasks; where ids are too many for it, it lets more rows through.
    """
    bits = 1 << min(FILTER_BITS, max(16, (16 * ids.count()).bit_length()))
    slot = F.pmod(F.xxhash64(F.col(name), F.lit(17)), F.lit(bits))

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros(1 << 16, np.uint8)
        held[frame["slot"].to_numpy() & 0xFFFF] = 1
        piece = int(frame["slot"].iloc[0]) >> 16
        return pd.DataFrame({"piece": [piece], "held": [np.packbits(held).tobytes()]})

    pieces = (
        ids.select(slot.alias("slot"))
        .distinct()
        .groupBy(F.shiftright("slot", 16))
        .applyInPandas(fill, "piece long, held binary")
        .collect()
    )
    table = np.zeros(bits // 8, np.uint8)
    for r in pieces:
        table[r.piece << 13 : (r.piece + 1) << 13] = np.frombuffer(r.held, np.uint8)
    sent = rows.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def held(slots: pd.Series) -> pd.Series:
        at = slots.to_numpy()
        return pd.Series((sent.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool))

    return rows.where(F.col(name).isNotNull()).where(held(slot))


def verified(
    pairs: DataFrame, classes: DataFrame, docs: DataFrame, n: int, percent: int, key: str, text: str
) -> DataFrame:
    """The pairs ``(a, b)`` that are linked.

    Texts of b travel to the set of a; an a with many b is sent to several tasks, which hold one
    set of a and one text at a time.
    """
    blocks = pairs.groupBy("a").agg((1 + F.floor(F.count("*") / MEMBERS)).cast("int").alias("blocks"))
    roles = pairs.join(blocks, "a").select(
        F.col("b").alias("class"),
        F.struct(
            F.col("a").alias("to"),
            F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"),
            F.lit(1).alias("member"),
        ).alias("role"),
    ).union(
        blocks.select(
            F.col("a").alias("class"),
            F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        ).select(
            "class",
            F.struct(F.col("class").alias("to"), "block", F.lit(0).alias("member")).alias("role"),
        )
    )
    wanted = roles.join(classes.select("class", F.col("rep").alias("doc")), "class")

    def check(batches):
        shingles, at, whole = Shingler(n), None, None
        for batch in slices(batches):
            rows = zip(*(c.to_pylist() for c in batch.columns))
            a, b = [], []
            for to, block, member, own, t in rows:
                features = shingles(t or "")
                if class_of(features) != own:  # another text under the same id
                    continue
                if not member:
                    at, whole = (to, block), features
                elif at == (to, block):
                    common = len(np.intersect1d(whole, features, assume_unique=True))
                    if 100 * common >= percent * (len(whole) + len(features) - common):
                        a.append(to)
                        b.append(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]
            )

    wanted = materialize(wanted, "wanted")
    return (
        only_ids(_picked(docs, key, text), "doc", wanted.select("doc").distinct())
        .join(wanted, "doc")
        .select("role.to", "role.block", "role.member", "class", "text")
        .repartition("to", "block")
        .sortWithinPartitions("to", "block", "member")
        .mapInArrow(check, "a bigint, b bigint")
        .distinct()
    )


def _crossing(percent: int):
    """Pairs of classes of one signature and different components that may be linked."""

    def pairs_of(size, bits, label, hub, part, own, same_part):
        a, b = [], []
        for i in range(len(own)):
            later = slice(i + 1, None)
            other = (label[later] != label[i]) & ~hub[later] if not hub[i] else None
            if other is None or not other.any():
                continue
            if not same_part:
                other &= part[later] != part[i]
            j = i + 1 + np.flatnonzero(other)
            j = j[_may_link(percent, size[j], size[i], 0)]
            if not len(j):
                continue
            different = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64)
            j = j[_may_link(percent, size[j], size[i], different)]
            a += np.minimum(own[j], own[i]).tolist()
            b += np.maximum(own[j], own[i]).tolist()
        return a, b

    def run(batches):
        held = None
        for table in _runs(batches):
            held = table
            cell = [held.column(i).to_numpy() for i in range(6)]
            sketches = held.column("bits").to_pylist()
            width = min(map(len, sketches))
            bits = np.stack([folded(x, width) for x in sketches])
            _, first, second, own, label, size = cell
            hub = held.column("hub").to_numpy(zero_copy_only=False).astype(bool)
            part = held.column("part").to_numpy()
            a, b = pairs_of(size, bits, label, hub, part, own, first[0] == second[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]
            )

    return run


def _runs(batches):
    """Tables of rows that agree in the first three columns, from batches sorted by them."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table]).combine_chunks()
        keys = np.stack([table.column(i).to_numpy() for i in range(3)])
        cuts = [0, *(1 + np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0))).tolist()]
        for start, end in zip(cuts, cuts[1:]):
            if end - start > 1:
                yield table.slice(start, end - start).combine_chunks()
        held = table.slice(cuts[-1])
    if held is not None and len(held) > 1:
        yield held.combine_chunks()


def crossing_pairs(
    members: DataFrame, hubs: DataFrame, labels: DataFrame, classes: DataFrame, percent: int
) -> DataFrame:
    """Pairs that share a signature, lie in different components and may be linked.

    A signature of many classes is dealt to parts of about ``BLOCK`` of them, and each two parts
    meet in one task.
    """
    rows = (
        members.join(labels.select(F.col("node").alias("class"), "root"), "class", "left")
        .withColumn("label", F.coalesce("root", "class"))
        .select("sig", "class", "label")
    )
    mixed = (
        rows.groupBy("sig")
        .agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
        .where("n > 2 and low < high")
        .join(hubs, "sig")
        .select("sig", "hub", (1 + F.floor(F.col("n") / BLOCK)).cast("int").alias("parts"))
    )
    mixed = materialize(mixed, "mixed")
    rows = (
        rows.join(mixed, "sig")
        .join(classes.select("class", "size", "bits"), "class")
        .withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            "sig",
            F.least("part", "other").alias("first"),
            F.greatest("part", "other").alias("second"),
            "class",
            "label",
            "size",
            "part",
            (F.col("class") == F.col("hub")).alias("hub"),
            "bits",
        )
    )
    return (
        rows.repartition("sig", "first", "second")
        .sortWithinPartitions("sig", "first", "second")
        .mapInArrow(_crossing(percent), "a bigint, b bigint")
        .distinct()
    )


def near_duplicates(
    docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(key, n_shingles, component_id, class_id)`` per row of ``docs``.

    Two documents are linked if their sets of word n-grams (a text of fewer words is one) have a
    Jaccard similarity of ``percent`` or more in 100; the component id is the smallest document id
    reachable by links. Null and empty texts have an empty set and are their own component. Rows
    that share an id are one document with several texts, linked where any of them is. A row
    without id has the component of its text, null if no row with an id reaches it.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent between 50 and 100")
    rows = materialize(document_sets(docs, n, key, text), "sets")
    classes = materialize(
        rows.where("class is not null and doc is not null")
        .groupBy("class")
        .agg(F.min("doc").alias("rep"), F.first("size").alias("size"), F.first("bits").alias("bits")),
        "classes",
    )
    members = materialize(
        shared_signatures(docs.where(F.col(key).isNotNull()), n, percent, key, text), "members"
    )
    degree = members.groupBy("class").agg(F.count("*").alias("degree"))
    hubs = materialize(
        members.join(degree, "class")
        .groupBy("sig")
        .agg(F.max(F.struct("degree", "class")).alias("top"))
        .select("sig", F.col("top.class").alias("hub")),
        "hubs",
    )
    first = (
        members.join(hubs, "sig")
        .where("class <> hub")
        .select(F.col("hub").alias("a"), F.col("class").alias("b"))
        .distinct()
    )
    first = materialize(possible(first, classes, percent), "pairs")
    links = materialize(verified(first, classes, docs, n, percent, key, text), "links")
    labels = components(links)
    second = crossing_pairs(members, hubs, labels, classes, percent)
    tested = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    second = materialize(second.join(tested, ["a", "b"], "left_anti"), "pairs")
    more = materialize(verified(second, classes, docs, n, percent, key, text), "links")
    named = rows.where("class is not null and doc is not null")
    same = (  # texts under one id
        named.groupBy("doc")
        .agg(F.min("class").alias("a"), F.max("class").alias("b"))
        .where("a < b")
        .select("doc", "a")
        .join(named.select("doc", F.col("class").alias("b")), "doc")
        .select("a", "b")
    )
    labels = materialize(
        components(
            labels.select(F.col("node").alias("a"), F.col("root").alias("b"))
            .union(more)
            .union(same)
        ),
        "labels",
    )
    joined = classes.select("class", "rep").join(
        labels.withColumnRenamed("node", "class"), "class", "left"
    )
    lowest = joined.where("root is not null").groupBy("root").agg(F.min("rep").alias("lowest"))
    placed = materialize(
        joined.join(lowest, "root", "left").select("class", F.coalesce("lowest", "rep").alias("lowest")),
        "components",
    )
    return rows.join(placed, "class", "left").select(
        F.col("doc").alias(key),
        F.col("size").alias("n_shingles"),
        F.coalesce("lowest", F.when(F.col("class").isNull(), F.col("doc"))).alias("component_id"),
        F.col("class").alias("class_id"),
    )
