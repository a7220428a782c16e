"""The day-partitioned log table: read, append, retention and preview."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.functions.scalars import parse_ts, utc_day
from timberline.operators.filters import Moment, time_range
from timberline.operators.paging import newest_first
from timberline.schema import DAY, STORED_SCHEMA
from timberline.sources.files import Files

KEEP_PAST_DAYS = 30
ACCEPT_FUTURE_DAYS = 7


def read_logs(
    spark: SparkSession, path: str, start: Moment = None, end: Moment = None
) -> DataFrame:
    """The table, or a time range of it that opens only the days concerned."""
    return time_range(spark.read.schema(STORED_SCHEMA).parquet(path), start, end)


def with_day(logs: DataFrame) -> DataFrame:
    return logs.withColumn(DAY, utc_day(F.col("timestamp")))


def write_logs(
    logs: DataFrame,
    path: str,
    compression: str = "lz4_raw",
    rebalance: bool = True,
    mode: str = "append",
) -> None:
    """Write every row, by default to what is there, sorted by time and service inside each file.

    Rebalancing by day gives few, even files: it splits a busy day over many tasks and
    merges quiet ones. Turn it off for small loads that span a day or two. Trace, span and
    instance ids get bloom filters of a size that suits each file.
    """
    rows = with_day(logs)
    if rebalance:
        rows = rows.hint("rebalance", F.col(DAY))
    (
        rows.sortWithinPartitions(DAY, "timestamp", "service_name")
        .write.mode(mode)
        .partitionBy(DAY)
        .option("compression", compression)
        .option("parquet.bloom.filter.enabled#trace_id", "true")
        .option("parquet.bloom.filter.enabled#span_id", "true")
        .option("parquet.bloom.filter.enabled#service_instance_id", "true")
        .option("parquet.bloom.filter.adaptive.enabled", "true")
        .parquet(path)
    )


class Retained(NamedTuple):
    kept: DataFrame
    rejected: DataFrame


def retention_test(
    as_of: str | date | datetime | Column,
    past: int = KEEP_PAST_DAYS,
    future: int = ACCEPT_FUTURE_DAYS,
) -> Column:
    """Whether a record's day (in UTC) has a place in the table; false where it has no time."""
    if isinstance(as_of, date) and not isinstance(as_of, datetime):
        today = F.lit(as_of)
    else:
        today = utc_day(parse_ts(as_of))
    day = utc_day(F.col("timestamp"))
    inside = day.between(F.date_sub(today, past), F.date_add(today, future))
    return F.coalesce(inside, F.lit(False))


def apply_retention(
    logs: DataFrame,
    as_of: str | date | datetime | Column,
    past: int = KEEP_PAST_DAYS,
    future: int = ACCEPT_FUTURE_DAYS,
) -> Retained:
    """Rows with a place in the table, and the rest for quarantine."""
    inside = retention_test(as_of, past, future)
    return Retained(logs.where(inside), logs.where(~inside))


def expired_days(
    spark: SparkSession, path: str, as_of: date, past: int = KEEP_PAST_DAYS
) -> list[str]:
    """Partition folders older than the retention, from names alone."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    oldest = as_of - timedelta(days=past)
    found = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if not (status.isDirectory() and name.startswith(f"{DAY}=")):
            continue
        try:
            day = date.fromisoformat(name.removeprefix(f"{DAY}="))
        except ValueError:
            continue
        if day < oldest:
            found.append(status.getPath().toString())
    return sorted(found)


def drop_expired(
    spark: SparkSession,
    path: str,
    as_of: date,
    past: int = KEEP_PAST_DAYS,
    index: str | None = None,
) -> list[str]:
    """Remove the partitions that are past retention; returns what was removed.

    With the folder of its term index, the same days go there first, so nothing is found that is gone.
    """
    doomed = expired_days(spark, path, as_of, past)
    if index is not None:
        files = Files(spark, index)
        for folder in [d.split("/")[-1] for d in doomed]:
            for part in files.found(f"{index}/*/{folder}"):
                files.delete(part)
    jvm = spark.sparkContext._jvm
    for folder in doomed:
        target = jvm.org.apache.hadoop.fs.Path(folder)
        fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(target, True)
    return doomed


def sample_preview(logs: DataFrame, first: int = 3, every: int = 50) -> DataFrame:
    """The newest ``first`` records and about one in ``every`` of the others.

    The choice depends on the record id alone, so it is the same on every run.
    """
    if not 0 <= first <= 1000:
        raise ValueError("first must be between 0 and 1000")
    newest = logs.orderBy(*newest_first()).limit(first)
    digits = F.conv(F.substring(F.md5(F.col("log_id").cast("string")), 1, 8), 16, 10)
    sampled = logs.where(digits.cast("bigint") % every == 0)
    shown = F.broadcast(newest.select("timestamp", "log_id"))
    return newest.unionByName(sampled.join(shown, ["timestamp", "log_id"], "left_anti"))
