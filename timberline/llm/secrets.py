"""Secrets in text, told apart by who owns them (operator 3).

Candidates are found by patterns, their values hashed, and each hash is counted over the corpus by
distinct documents (``repositories``: equal texts are one) and distinct sources (``owners``). A value that
several owners carry is a copied example, and so is one that fewer share, at least two, in many
documents; one that stays with a single owner is taken as live, in however many of its documents it
is. Both counts are returned with every span. Long texts with many spans take little more than
linear time: places are running sums, taken in chunks. Everything is DataFrame expressions; counts combine before their shuffle and joins are plain equi-joins that
adaptive execution may split, so a value in a third of all rows is no burden.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.batches import quoted
from timberline.sources.scratch import materialize

#: A value of so many distinct owners or more is a copied example.
COPIED_OWNERS = 3
#: So is a value of two owners or more in so many distinct documents.
COPIED_DOCUMENTS = 20

# Patterns of the three base kinds and their least lengths.
ASSIGN = (
    r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Further candidates: long runs of key characters with upper case, lower case and digits.
OPAQUE = r"[A-Za-z0-9+/_=-]{20,}"

KINDS = ("assign", "access", "hex", "owned")
_LAST = 2**31 - 1


def _pairs(text: Column, pattern: str, group: int = 0) -> Column:
    """Matches of a pattern, leftmost and not overlapping, each with the text before it and its ``group``.

    The text between the matches is what ``split`` leaves, so lengths of both give the places.
    """
    pairs = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )
    return F.transform(
        F.filter(pairs, lambda p: p["all"].isNotNull()),
        lambda p: F.struct(
            F.length(p["gap"]).alias("gap"), F.length(p["all"]).alias("all"), p["value"].alias("value")
        ),
    )


def with_running(
    rows: DataFrame, name: str, values: Column, zero: int, op: Callable[[Column, Column], Column]
) -> DataFrame:
    """Adds ``name``: for each of an array's integers, ``op`` over those before it.

    Results are appended in chunks of about the root of the length, as an array is copied when it grows.
    """
    size = F.ceil(F.sqrt(F.size("_values"))).cast("int")
    places = F.sequence(F.lit(0), ((F.size("_values") - 1) / size).cast("int"))
    chunks = F.transform(places, lambda i: F.slice("_values", i * size + 1, size))
    none = F.array().cast("array<int>")

    def add(state: Column, value: Column) -> Column:
        return F.struct(op(state["at"], value).alias("at"), F.array_append(state["out"], state["at"]).alias("out"))

    start = F.struct(F.lit(zero).alias("at"), none.alias("out"))
    return (
        rows.withColumn("_values", values)
        .withColumn("_chunks", F.when(F.size("_values") > 0, chunks).otherwise(F.array().cast("array<array<int>>")))
        .withColumn("_chunks", F.transform("_chunks", lambda c: F.aggregate(c, start, add)))
        .withColumn("_bases", F.aggregate(F.transform("_chunks", lambda c: c["at"]), start, add, lambda s: s["out"]))
        .withColumn(
            name,
            F.flatten(F.zip_with("_chunks", "_bases", lambda c, b: F.transform(c["out"], lambda x: op(b, x)))),
        )
        .drop("_values", "_chunks", "_bases")
    )


def with_spans(rows: DataFrame, name: str, pattern: str, rank: int, group: int = 0) -> DataFrame:
    """Adds the spans of a pattern in ``text``: ``start, rank, end, value``."""
    rows = rows.withColumn("_pairs", _pairs(F.col("text"), pattern, group))
    lengths = F.transform("_pairs", lambda p: p["gap"] + p["all"])
    rows = with_running(rows, "_starts", lengths, 0, lambda a, b: a + b)

    def span(pair: Column, at: Column) -> Column:
        begin = at + pair["gap"]
        return F.struct(
            begin.alias("start"), F.lit(rank).alias("rank"), (begin + pair["all"]).alias("end"),
            pair["value"].alias("value"),
        )

    return rows.withColumn(name, F.zip_with("_pairs", "_starts", span)).drop("_pairs", "_starts")


def candidates(rows: DataFrame) -> DataFrame:
    """Adds ``spans`` of ``text``: those of the base kinds, and opaque ones that touch none of them."""
    rows = with_spans(rows, "_assign", ASSIGN, 0, 2)
    rows = with_spans(rows, "_access", ACCESS, 1)
    rows = with_spans(rows, "_hex", HEX, 2)
    rows = with_spans(rows, "_opaque", OPAQUE, 3)
    value = "value"
    spans = F.concat(
        F.filter("_assign", lambda s: F.length(s[value]) >= ASSIGN_LEAST),
        "_access",
        "_hex",
        F.filter(
            "_opaque",
            lambda s: s[value].rlike("[a-z]") & s[value].rlike("[A-Z]") & s[value].rlike("[0-9]"),
        ),
    )
    rows = rows.withColumn("_all", F.array_sort(spans)).drop("_assign", "_access", "_hex", "_opaque")
    # by start, base kinds first: the furthest end of those before and the nearest start of those after
    ends = F.transform("_all", lambda s: F.when(s["rank"] < 3, s["end"]).otherwise(0))
    starts = F.transform("_all", lambda s: F.when(s["rank"] < 3, s["start"]).otherwise(_LAST))
    rows = with_running(rows, "_before", ends, 0, F.greatest)
    rows = with_running(rows, "_after", F.reverse(starts), _LAST, F.least)
    around = F.arrays_zip(F.col("_all").alias("span"), F.col("_before").alias("before"), F.reverse("_after").alias("after"))
    free = F.filter(
        around,
        lambda x: (x["span"]["rank"] < 3)
        | ((x["before"] <= x["span"]["start"]) & (x["after"] >= x["span"]["end"])),
    )
    return rows.withColumn("spans", F.transform(free, lambda x: x["span"])).drop("_all", "_before", "_after")


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end``, by start and then kind, comma-joined."""
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            F.array_sort(spans),
            lambda s: F.concat_ws(
                ":", F.element_at(kind, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def scan(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    owner: str = "source",
    copied_owners: int = COPIED_OWNERS,
    copied_documents: int = COPIED_DOCUMENTS,
) -> DataFrame:
    """``(key, base, spans, n_live, n_copied)`` per row.

    ``base`` holds the spans of the three base kinds; ``spans`` these and the further candidates
    whose value is live: it belongs to fewer than ``copied_owners`` owners, and to one of them only where
    ``copied_documents`` distinct texts have it. Each tells so in ``live``, and in ``documents`` and
    ``owners`` how many distinct texts and owners have its value. Offsets are code points, end exclusive. Null and empty texts have no spans. Rows with a
    null or repeated key are rows like any other; a null source is one owner.
    """
    rows = docs.select(
        F.col(key).cast("long").alias("key"), F.col(owner).alias("owner"), F.col(text).alias("text")
    )
    spans = F.col("spans")
    return _judged(rows, copied_owners, copied_documents).select(
        F.col("key").alias(key),
        F.filter(spans, lambda s: s["rank"] < 3).alias("base"),
        "spans",
        F.size(F.filter(spans, lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter(spans, lambda s: ~s["live"])).cast("long").alias("n_copied"),
    )


def redacted(
    docs: DataFrame,
    placeholder: str,
    text: str = "text",
    owner: str = "source",
    copied_owners: int = COPIED_OWNERS,
    copied_documents: int = COPIED_DOCUMENTS,
) -> DataFrame:
    """``docs`` with every live span of ``text`` replaced; copied examples stay."""
    rows = docs.select(
        F.struct(*map(quoted, docs.columns)).alias("key"), F.col(owner).alias("owner"), F.col(text).alias("text")
    )
    own = F.col("key")[text]
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(state: Column, span: Column) -> Column:
        before = F.substr(own, state["at"] + 1, F.greatest(span["start"] - state["at"], F.lit(0)))
        new = F.when(span["start"] >= state["at"], F.concat(before, F.lit(placeholder))).otherwise("")
        return F.struct(
            F.concat(state["out"], new).alias("out"),
            F.greatest(state["at"], span["end"]).alias("at"),
        )

    live = F.filter("spans", lambda s: s["live"])
    cut = F.aggregate(live, start, step)
    replaced = F.when(F.size(live) > 0, F.concat(cut["out"], F.substr(own, cut["at"] + 1)))
    return (
        _judged(rows, copied_owners, copied_documents)
        .select(F.col("key").withField(text, F.coalesce(replaced, own)).alias("key"))
        .select("key.*")
    )


def _judged(rows: DataFrame, copied_owners: int, copied_documents: int) -> DataFrame:
    """``(key, spans)`` of ``(key, owner, text)``; the key may be of any type."""
    rows = rows.select(
        "key",
        F.coalesce(F.col("owner").cast("string"), F.lit("")).alias("owner"),
        F.col("text").cast("string").alias("text"),
    )
    has = F.col("text").rlike("|".join(f"(?:{p})" for p in (ASSIGN, ACCESS, HEX, OPAQUE)))
    # only texts with a candidate go on; what follows reads them from here
    flagged = materialize(
        rows.select(
            "key",
            "owner",
            F.when(has, F.col("text")).alias("text"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "candidates",
    )
    texts = flagged.where("text is not null").select("row", "owner", "text", F.xxhash64("text").alias("document"))
    found = (
        # outer: of a plain explode the optimiser takes a filter on the array and computes it once more
        candidates(texts)
        .select("row", "owner", "document", F.explode_outer("spans").alias("span"))
        .where("span is not null")
        .select("row", "owner", "document", "span.*")
        .withColumn("hash", F.sha2("value", 256))
        .drop("value")
    )
    found = materialize(found, "spans")
    # equal texts are one document; either count combines before its shuffle, and a hot value is spread
    # by its documents and owners first
    seen = found.select("hash", "owner", "document").distinct()
    documents = seen.select("hash", "document").distinct().groupBy("hash").agg(F.count("*").alias("documents"))
    owners = seen.select("hash", "owner").distinct().groupBy("hash").agg(F.count("*").alias("owners"))
    counts = materialize(documents.join(owners, "hash"), "counts")
    judged = (
        found.join(counts, "hash")
        .withColumn(
            "live",
            (F.col("owners") < copied_owners)
            & ((F.col("owners") < 2) | (F.col("documents") < copied_documents)),
        )
        .where((F.col("rank") < 3) | F.col("live"))
        .groupBy("row")
        .agg(
            F.collect_list(F.struct("start", "rank", "end", "live", "documents", "owners")).alias("spans")
        )
    )
    none = F.array().cast(
        "array<struct<start:int,rank:int,end:int,live:boolean,documents:bigint,owners:bigint>>"
    )
    return (
        flagged.select("row", "key")
        .join(judged, "row", "left")
        .select("key", F.array_sort(F.coalesce("spans", none)).alias("spans"))
    )
