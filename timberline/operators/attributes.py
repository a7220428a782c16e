"""Attribute keys that most records carry, as columns of their own.

A census counts the keys of both bags in one pass. The chosen ones are *promoted*: recorded beside the
table, written as plain columns from then on (by ``append_batch`` and ``compact_day``) into files whose
names tell so. A filter on a promoted key reads the column, with its statistics, where a file has it, and
opens the bag only in the other files; which files are which is settled from their names when the scan
is planned. Readers that know nothing of promotions see the table as before.
"""

from __future__ import annotations

import hashlib
import json
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline.operators.filters import Moment, by_attribute, time_range
from timberline.schema import STORED_SCHEMA
from timberline.sources.files import TAG, Files
from timberline.sources.scratch import materialize

BAGS = ("log_attributes", "resource_attributes")
_FILE = "_promoted.json"
#: A key is worth a column from this share of the records on; at most so many are.
LEAST_SHARE, MOST = 0.5, 16


class Promoted(NamedTuple):
    bag: str
    key: str
    column: str


def attribute_census(logs: DataFrame) -> DataFrame:
    """``bag, key, records, share``: how many records carry each key; one pass, combined map-side.

    ``share`` is of all records, which the same pass counts.
    """

    def held(bag: str) -> Column:
        keys = F.coalesce(F.map_keys(F.col(bag)), F.array().cast("array<string>"))
        return F.transform(keys, lambda k: F.struct(F.lit(bag).alias("bag"), k.alias("key")))

    everyone = F.array(F.struct(F.lit("").alias("bag"), F.lit("").alias("key")))
    counts = (
        logs.select(F.explode(F.concat(everyone, *map(held, BAGS))).alias("k"))
        .groupBy(F.col("k.bag").alias("bag"), F.col("k.key").alias("key"))
        .agg(F.count(F.lit(1)).alias("records"))
    )
    counts = materialize(counts, "census")
    everyone = counts.where(F.col("bag") == "").first()
    total = everyone["records"] if everyone else 0
    return counts.where(F.col("bag") != "").withColumn("share", F.col("records") / F.lit(float(total)))


def hot_attributes(
    census: DataFrame, least_share: float = LEAST_SHARE, most: int = MOST
) -> list[tuple[str, str]]:
    """The ``(bag, key)`` most records carry, the commonest first; ``most`` of them at most."""
    rows = census.where(F.col("share") >= least_share).orderBy(F.desc("records"), "bag", "key")
    return [(r["bag"], r["key"]) for r in rows.limit(most).collect()]


def _column(bag: str, key: str) -> str:
    """A name without dots, that no other key has."""
    plain = re.sub(r"\W", "_", key, flags=re.ASCII)[:40]
    return f"{bag}__{plain}_{hashlib.md5(key.encode()).hexdigest()[:6]}"


def promote(spark: SparkSession, path: str, keys: list[tuple[str, str]]) -> str:
    """Have these keys written as columns from now on; returns the name of the set."""
    if any(bag not in BAGS for bag, _ in keys):
        raise ValueError(f"bags are {', '.join(BAGS)}")
    chosen = [Promoted(b, k, _column(b, k)) for b, k in dict.fromkeys(keys)]
    name = hashlib.md5(json.dumps(sorted(chosen)).encode()).hexdigest()[:8]
    sets = {n: s for n, s in promotions(spark, path).items() if n != name}
    Files(spark, path).write(f"{path}/{_FILE}", json.dumps({**sets, name: chosen}))
    return name


def promotions(spark: SparkSession, path: str) -> dict[str, list[Promoted]]:
    """All sets of promoted keys a table has had, the current one last."""
    files = Files(spark, path)
    if not files.exists(f"{path}/{_FILE}"):
        return {}
    sets = json.loads(files.read(f"{path}/{_FILE}"))
    return {name: [Promoted(*p) for p in chosen] for name, chosen in sets.items()}


def with_promoted(logs: DataFrame, path: str) -> tuple[DataFrame, str]:
    """Rows with the columns the table now wants, and the tag of the files they go to."""
    sets = promotions(logs.sparkSession, path)
    if not sets:
        return logs, ""
    name, chosen = list(sets.items())[-1]
    columns = {p.column: F.try_element_at(F.col(p.bag), F.lit(p.key)) for p in chosen}
    return logs.withColumns(columns) if chosen else logs, f"{TAG}{name}-"


def logs_by_attribute(
    spark: SparkSession,
    path: str,
    bag: str,
    key: str,
    value: str,
    start: Moment = None,
    end: Moment = None,
) -> DataFrame:
    """Records of a table whose bag holds the value under the key; as ``filters.by_attribute``."""
    sets = promotions(spark, path)
    having = [n for n, chosen in sets.items() if any((p.bag, p.key) == (bag, key) for p in chosen)]
    column = T.StructField(_column(bag, key), T.StringType())
    rows = spark.read.schema(T.StructType([*STORED_SCHEMA.fields, column])).parquet(path)
    rows = time_range(rows, start, end)
    if not having:
        return by_attribute(rows.drop(column.name), bag, key, value)
    name = F.col("_metadata.file_name")
    tests: list[Column] = [F.contains(name, F.lit(f"{TAG}{n}-")) for n in having]
    has = tests[0]
    for test in tests[1:]:
        has = has | test
    by_column = rows.where(has).where(F.col(column.name) == value).drop(column.name)
    return by_column.unionByName(by_attribute(rows.where(~has).drop(column.name), bag, key, value))
