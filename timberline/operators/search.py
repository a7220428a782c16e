"""A term index as ordinary tables, and search through it.

``postings`` hold one row per (term, record) with the positions of the term, ``terms`` the dictionary:
every distinct term under itself, reversed, and under its trigrams. A search looks the terms of its
query up first where a token may be open at an end or is a pattern, then reads only the row groups of
postings that hold those terms, settles the match on positions, and joins the ids back to the records.

Both tables are dealt by range: of terms, and within a term of records, so a term in every record fills
as many files as it has postings and rare terms share one. Spark takes the bounds from a sample of the
rows to be written, which weighs a term by its postings. Day-partitioned tables have their index by
day, published under the batch names of the table, so that it is appended to, replaced and dropped with it.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Collection, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline.functions.text import DEFAULT_MODE, query_tokens, term_positions
from timberline.operators.rollup import write_counts
from timberline.schema import DAY
from timberline.sources.files import Files, batch_names, done_names, mark_done, publish
from timberline.sources.logs import read_logs
from timberline.sources.scratch import materialize

LOG_KEYS = (DAY, "timestamp", "log_id")
#: Terms that are asked for one by one; more are joined, with the same result.
MAX_TERMS = 200
GRAM = 3
_BODY = "_body"
#: Kinds of dictionary rows: what ``key`` is of ``term``.
SELF, REVERSED, PART = "term", "reversed", "gram"
TERMS_DDL = "kind string, key string, term string, records bigint"


class TermIndex(NamedTuple):
    postings: DataFrame
    terms: DataFrame


def build_term_index(logs: DataFrame, keys: Sequence[str] = LOG_KEYS, body: str = "body") -> DataFrame:
    """``keys..., term, positions`` for every distinct term of every record.

    All terms of a record are in its row, so no postings are shuffled. Records are, first, because cutting
    bodies is most of the work and a file with one row group would leave it to one task.
    """
    dealt = logs.select(*keys, F.col(body).alias(_BODY)).hint("rebalance")
    entry = F.explode(term_positions(F.col(_BODY))).alias("entry")
    return dealt.select(*keys, entry).select(*keys, "entry.term", "entry.positions")


def dictionary(postings: DataFrame) -> DataFrame:
    """``kind, key, term, records`` (and the day): the distinct terms under all they are looked up by."""
    by = [DAY] if DAY in postings.columns else []
    terms = postings.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("records"))

    def under(kind: str, key: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"))

    term = F.col("term")
    places = F.sequence(F.lit(1), F.greatest(F.length(term) - (GRAM - 1), F.lit(1)))
    grams = F.array_distinct(F.transform(places, lambda i: F.substr(term, i, F.lit(GRAM))))
    grams = F.filter(grams, lambda g: F.length(g) == GRAM)
    rows = F.concat(
        F.array(under(SELF, term), under(REVERSED, F.reverse(term))),
        F.transform(grams, lambda g: under(PART, g)),
    )
    return terms.select("term", "records", F.explode(rows).alias("row"), *by).select(
        "row.kind", "row.key", "term", "records", *by
    )


def _write(rows: DataFrame, path: str, order: Sequence[str], spread: Sequence[Column], blooms: Sequence[str]):
    by = [DAY] if DAY in rows.columns else []
    dealt = rows.repartitionByRange(*by, *order, *spread).sortWithinPartitions(*by, *order)
    writer = dealt.write.mode("overwrite").option("parquet.bloom.filter.adaptive.enabled", "true")
    for name in blooms:
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_term_index(index: DataFrame, path: str, name: str | None = None) -> None:
    """Append postings to the index, partitioned by day where they have one, and their dictionary.

    Under the same ``name`` a batch replaces itself. Files are ranges of terms, sorted, so their
    statistics, and a bloom filter on the term, let a search skip all but the row groups of its terms.
    """
    spark = index.sparkSession
    name = name or f"b{uuid.uuid4().hex[:12]}"
    staging = f"{path}/_staging/{name}"
    keys = [c for c in index.columns if c not in (DAY, "term", "positions")]
    # ranges are sampled from a written copy, so that each body is cut into terms once
    index.write.mode("overwrite").option("compression", "lz4_raw").parquet(f"{staging}/taken")
    taken = spark.read.schema(index.schema).parquet(f"{staging}/taken")
    _write(taken, f"{staging}/postings", ["term"], [F.xxhash64(*keys)], ["term"])
    staged = spark.read.schema(index.schema).parquet(f"{staging}/postings")
    _write(dictionary(staged), f"{staging}/terms", ["kind", "key"], [F.xxhash64("term")], [])
    for part in ("terms", "postings"):
        publish(spark, f"{staging}/{part}", f"{path}/{part}", name)
    Files(spark, path).delete(staging)


def read_term_index(spark: SparkSession, path: str, schema: T.StructType) -> TermIndex:
    """A written index; ``schema`` is that of the built one."""
    day = [f for f in schema.fields if f.name == DAY]
    terms = T.StructType([*T.StructType.fromDDL(TERMS_DDL).fields, *day])
    return TermIndex(
        spark.read.schema(schema).parquet(f"{path}/postings"),
        spark.read.schema(terms).parquet(f"{path}/terms"),
    )


# --- an index that follows a table ------------------------------------------------------


def publish_postings(rows: DataFrame, path: str, name: str, folders: Collection[str]) -> None:
    """Postings and counts of a batch of a day-partitioned table under its name; marks its days as done."""
    write_term_index(build_term_index(rows), path, name)
    write_counts(rows, path, name)
    mark_done(rows.sparkSession, f"{path}/postings", folders, name)


def days_behind(spark: SparkSession, table: str, path: str) -> list[str]:
    """Days of a table with batches that its index does not have; from file names alone."""
    done = done_names(spark, f"{path}/postings")
    names = batch_names(spark, table)
    return sorted(f.removeprefix(f"{DAY}=") for f, n in names.items() if n - done.get(f, set()))


def catch_up(spark: SparkSession, table: str, path: str) -> list[str]:
    """Index the days that are behind anew, each as one batch; returns them."""
    days = days_behind(spark, table, path)
    names, files = batch_names(spark, table), Files(spark, path)
    for day in days:
        folder = f"{DAY}={day}"
        logs = read_logs(spark, table)
        own = logs[DAY].isNull() if day == "__HIVE_DEFAULT_PARTITION__" else logs[DAY] == F.lit(day).cast("date")
        for old in files.found(f"{path}/*/{folder}"):
            files.delete(old)
        name = f"day{uuid.uuid4().hex[:8]}"
        write_term_index(build_term_index(logs.where(own)), path, name)
        write_counts(logs.where(own), path, name)
        for done in names[folder]:
            mark_done(spark, f"{path}/postings", [folder], done)
    return days


# --- search -----------------------------------------------------------------------------


def required_literals(pattern: str) -> list[tuple[bool, str]]:
    """Strings that any term matching the pattern holds, each with whether the term begins with it.

    Of plain patterns only: with alternatives, groups, escapes or counts there are none.
    """
    plain = re.sub(r"\[\^?[^\]\[\\^]+\]", "\0", pattern)
    if re.search(r"[|\\(){}\[\]]", plain):
        return []
    found = []
    for run in re.finditer(r"[A-Za-z0-9_]+", plain):
        text = run[0][:-1] if plain[run.end() : run.end() + 1] in ("*", "?") else run[0]
        if text:
            found.append((run.start() == 1 and plain[0] == "^", text))
    return found


class _Lookup:
    """Terms of an index by what they begin or end with, hold or match."""

    def __init__(self, index: TermIndex | DataFrame):
        self.rows = None if isinstance(index, DataFrame) else index.terms
        self.all = (
            index.select("term")
            if self.rows is None
            else self.rows.where(F.col("kind") == SELF).select("term")
        )

    def _keyed(self, kind: str, test: Column) -> DataFrame:
        return self.rows.where((F.col("kind") == kind) & test).select("term")

    def beginning(self, text: str) -> DataFrame:
        if self.rows is None:
            return self.all.where(F.startswith("term", F.lit(text)))
        return self._keyed(SELF, F.startswith("key", F.lit(text)))

    def ending(self, text: str) -> DataFrame:
        if self.rows is None:
            return self.all.where(F.endswith("term", F.lit(text)))
        return self._keyed(REVERSED, F.startswith("key", F.lit(text[::-1])))

    def holding(self, text: str) -> DataFrame:
        holds = F.contains("term", F.lit(text))
        if self.rows is None or len(text) < GRAM:
            return self.all.where(holds)
        # the rows of one trigram, read by key; the rest of the text is tested on the term
        return self._keyed(PART, (F.col("key") == text[:GRAM]) & holds)

    def matching(self, pattern: str) -> DataFrame:
        fits = F.rlike("term", F.lit(pattern))
        literals = required_literals(pattern)
        first = [t for at_start, t in literals if at_start]
        longest = max((t for _, t in literals), key=len, default="")
        if first:
            return self.beginning(first[0]).where(fits)
        return (self.holding(longest) if len(longest) >= GRAM else self.all).where(fits)


def _one_of(column: str, values: Sequence[str]) -> Column:
    """As a tree of equalities, which the reader tests one by one; of a longer list it takes the bounds."""
    tests = [F.col(column) == v for v in values] or [F.lit(False)]
    while len(tests) > 1:
        tests = [reduce(lambda a, b: a | b, tests[i : i + 2]) for i in range(0, len(tests), 2)]
    return tests[0]


def _of_terms(postings: DataFrame, exact: Sequence[str], open_terms: DataFrame | None) -> DataFrame:
    """Postings of the given terms and of those looked up, which are few or are joined."""
    if open_terms is None:
        return postings.where(_one_of("term", exact))
    found = materialize(open_terms.distinct(), "terms")
    few = [r[0] for r in found.limit(MAX_TERMS + 1).collect()]
    if len(few) <= MAX_TERMS:
        return postings.where(_one_of("term", sorted({*exact, *few})))
    if exact:
        spark = postings.sparkSession
        found = found.union(spark.createDataFrame([(t,) for t in exact], "term string")).distinct()
    return postings.join(found, "term", "left_semi")


def matching_keys(
    index: TermIndex | DataFrame,
    query: str,
    mode: str = DEFAULT_MODE,
    keys: Sequence[str] = LOG_KEYS,
) -> DataFrame:
    """Keys of the records that match, from the index alone (or from postings without dictionary).

    Modes with open tokens and patterns look their terms up at the call.
    """
    postings = index if isinstance(index, DataFrame) else index.postings
    lookup = _Lookup(index)
    if mode == "MATCH_REGEXP":
        return _of_terms(postings, [], lookup.matching(query)).select(*keys).distinct()
    q = query_tokens(query)
    if not q:
        return postings.where(F.lit(False)).select(*keys)
    wanted = list(dict.fromkeys(q))
    if mode in ("MATCH_ALL", "MATCH_PHRASE"):
        hits = _of_terms(postings, wanted, None)
    elif mode == "MATCH_PHRASE_PREFIX":
        hits = _of_terms(postings, q[:-1], lookup.beginning(q[-1]))
    elif mode == "MATCH_PHRASE_EDGE" and len(q) == 1:
        return _of_terms(postings, [], lookup.holding(q[0])).select(*keys).distinct()
    elif mode == "MATCH_PHRASE_EDGE":
        ends = lookup.ending(q[0]).union(lookup.beginning(q[-1]))
        hits = _of_terms(postings, q[1:-1], ends)
    else:
        return _of_terms(postings, wanted, None).select(*keys).distinct()

    if mode == "MATCH_ALL":
        per_record = hits.groupBy(*keys).agg(F.count_distinct("term").alias("n"))
        return per_record.where(F.col("n") == len(wanted)).select(*keys)

    def fits(i: int) -> Column:
        term = F.col("term")
        if mode == "MATCH_PHRASE_EDGE" and i == 0:
            return F.endswith(term, F.lit(q[0]))
        if mode != "MATCH_PHRASE" and i == len(q) - 1:
            return F.startswith(term, F.lit(q[-1]))
        return term == q[i]

    # Where the i-th query token sits, moved back by i, is where the phrase would start.
    def moved_back(i: int) -> Column:
        return F.transform("positions", lambda p: p - i)

    starts = [F.when(fits(i), moved_back(i)).alias(f"s{i}") for i in range(len(q))]
    gathered = (
        hits.select(*keys, *starts)
        .groupBy(*keys)
        .agg(*[F.flatten(F.collect_list(f"s{i}")).alias(f"s{i}") for i in range(len(q))])
    )
    common = reduce(F.array_intersect, [F.col(f"s{i}") for i in range(len(q))])
    return gathered.where(F.size(common) > 0).select(*keys)


def search_index(
    index: TermIndex | DataFrame,
    logs: DataFrame,
    query: str,
    mode: str = DEFAULT_MODE,
    keys: Sequence[str] = LOG_KEYS,
) -> DataFrame:
    """Records found through the index; no text means no predicate.

    The keys found are written out first. Their size is then known when the join is
    planned: a small set is broadcast and the logs are not shuffled at all, with only the
    days concerned opened; a large one is joined by shuffle.
    """
    if not query:
        return logs
    found = materialize(matching_keys(index, query, mode, keys), "found")
    if DAY in keys:
        # As many values as the table has days.
        days = [r[0] for r in found.select(DAY).distinct().collect()]
        dated = [d for d in days if d is not None]
        opened = F.col(DAY).isin(*dated) if dated else F.lit(False)
        logs = logs.where(opened | F.col(DAY).isNull() if len(dated) < len(days) else opened)
    hit = [f"_found_{k}" for k in keys]
    # records without time are found by their other keys
    same = [logs[k].eqNullSafe(F.col(h)) for k, h in zip(keys, hit)]
    return logs.join(found.select(*[F.col(k).alias(h) for k, h in zip(keys, hit)]), same, "left_semi")
