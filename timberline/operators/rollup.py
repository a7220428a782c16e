"""Counts per minute, severity and service, kept beside the table and answered from.

Every batch publishes its counts under its own name next to its postings, so they are replaced, brought
up to date and dropped with its rows, and a sum over them is right after any of that. A range is answered
from the counts of its whole minutes and from the records of the minutes it cuts, at most two.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.functions.scalars import bucket_window, hour_label, parse_ts, unit_number, unit_start, utc_day
from timberline.operators.filters import Moment, _given, time_range
from timberline.operators.stats import facets_of
from timberline.schema import DAY
from timberline.sources.files import publish

COUNTS_DDL = f"minute timestamp, severity_text string, service_name string, n bigint, {DAY} date"
MINUTE = "INTERVAL 1 MINUTE"


def minute_counts(logs: DataFrame) -> DataFrame:
    """``minute, severity_text, service_name, n``; records without time are a minute of their own."""
    return logs.groupBy(
        F.date_trunc("minute", "timestamp").alias("minute"), "severity_text", "service_name"
    ).agg(F.count(F.lit(1)).alias("n"))


def write_counts(logs: DataFrame, path: str, name: str) -> None:
    """Append the counts of a batch, by day; under the same name they replace themselves."""
    staging = f"{path}/_staging/{name}-counts"
    rows = minute_counts(logs).withColumn(DAY, utc_day(F.col("minute")))
    dealt = rows.hint("rebalance", F.col(DAY)).sortWithinPartitions(DAY, "minute")
    dealt.write.mode("overwrite").partitionBy(DAY).parquet(staging)
    publish(logs.sparkSession, staging, f"{path}/counts", name)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COUNTS_DDL).parquet(f"{path}/counts")


def counted(logs: DataFrame, counts: DataFrame, start: Moment = None, end: Moment = None) -> DataFrame:
    """``minute, severity_text, service_name, n`` of a range: minutes may come in several rows.

    Both ends are included, as in ``time_range``; records without time only count without a range.
    """
    names = ["minute", "severity_text", "service_name", "n"]
    first: Column | None = None
    edges: list[DataFrame] = []
    inside = counts
    if _given(start):
        at = parse_ts(start)
        floor = F.date_trunc("minute", at)
        first = F.when(floor == at, floor).otherwise(floor + F.expr(MINUTE))
        inside = inside.where((F.col("minute") >= first) & (F.col(DAY) >= utc_day(first)))
        edges.append(time_range(logs, start, end).where(F.col("timestamp") < first))
        edges[-1] = edges[-1].where(F.col(DAY) <= utc_day(first))
    if _given(end):
        last = F.date_trunc("minute", parse_ts(end))
        inside = inside.where((F.col("minute") < last) & (F.col(DAY) <= utc_day(last)))
        edge = time_range(logs, start, end).where((F.col("timestamp") >= last) & (F.col(DAY) >= utc_day(last)))
        edges.append(edge if first is None else edge.where(F.col("timestamp") >= first))
    out = inside.select(*names)
    for edge in edges:
        out = out.unionByName(minute_counts(edge).select(*names))
    return out


def overview(logs: DataFrame, counts: DataFrame, start: Moment = None, end: Moment = None) -> DataFrame:
    """As ``stats.overview``, from the counts."""
    pairs = counted(logs, counts, start, end).groupBy("severity_text", "service_name")
    return facets_of(pairs.agg(F.sum("n").alias("n")))


def bucket_counts(
    logs: DataFrame,
    counts: DataFrame,
    width: str = "1h",
    keys: Sequence[str] = (),
    start: Moment = None,
    end: Moment = None,
) -> DataFrame:
    """As ``stats.bucket_counts`` over a range, from the counts; keys are severity and service."""
    rows = counted(logs, counts, start, end)
    sums = rows.groupBy(*keys, bucket_window("minute", width).alias("w")).agg(F.sum("n").alias("count"))
    return sums.select(*keys, F.col("w.start").alias("bucket_start"), "count")


def hourly_volume(logs: DataFrame, counts: DataFrame, as_of: Moment = None, hours: int = 24) -> DataFrame:
    """As ``stats.hourly_volume``, from the counts."""
    now = parse_ts(as_of) if as_of is not None else F.current_timestamp()
    rows = counted(logs, counts, now - F.make_dt_interval(hours=F.lit(hours)))
    per_hour = rows.groupBy(unit_number(F.col("minute"), 3600).alias("hour")).agg(F.sum("n").alias("count"))
    return per_hour.select(hour_label(unit_start(F.col("hour"), 3600)).alias("ts"), "count").orderBy("ts")
