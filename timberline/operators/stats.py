"""Counts by severity, service and time bucket."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.scalars import (
    WIDTH_SECONDS,
    WIDTHS,
    bucket_window,
    hour_label,
    iso_label,
    parse_ts,
    unit_number,
    unit_start,
    width_name,
)
from timberline.operators.filters import Moment, time_range

def _rows(name: str = "count") -> Column:
    return F.count(F.lit(1)).alias(name)


def total(logs: DataFrame) -> DataFrame:
    return logs.agg(_rows("total"))


def by_severity_counts(logs: DataFrame) -> DataFrame:
    """Records per severity; a missing severity is a group of its own."""
    return logs.groupBy("severity_text").agg(_rows())


def by_service_counts(logs: DataFrame) -> DataFrame:
    """Records per service, largest first; missing and empty names are kept."""
    counts = logs.groupBy("service_name").agg(_rows())
    return counts.orderBy(F.col("count").desc(), F.col("service_name").asc_nulls_first())


def top_services(logs: DataFrame, n: int = 8) -> DataFrame:
    return by_service_counts(logs).limit(n)


def services(logs: DataFrame) -> DataFrame:
    """Distinct non-empty service names in order."""
    named = logs.where(F.col("service_name").isNotNull() & (F.col("service_name") != ""))
    return named.select("service_name").distinct().orderBy("service_name")


def hourly_volume(logs: DataFrame, as_of: Moment = None, hours: int = 24) -> DataFrame:
    """Records per hour over the last hours, whatever range the caller looks at."""
    end = parse_ts(as_of) if as_of is not None else F.current_timestamp()
    recent = time_range(logs, end - F.make_dt_interval(hours=F.lit(hours)))
    per_hour = recent.groupBy(unit_number(F.col("timestamp"), 3600).alias("hour")).agg(_rows())
    start = unit_start(F.col("hour"), 3600)
    return per_hour.select(hour_label(start).alias("ts"), "count").orderBy("ts")


def severity_cards(logs: DataFrame) -> DataFrame:
    """One row: total, errors, warnings and infos. WARNING counts where WARN has none."""

    def level(name: str) -> Column:
        return F.count_if(F.col("severity_text") == name)

    warn = level("WARN")
    return logs.agg(
        _rows("total"),
        level("ERROR").alias("error"),
        F.when(warn > 0, warn).otherwise(level("WARNING")).alias("warn"),
        level("INFO").alias("info"),
    )


def overview(logs: DataFrame, start: Moment = None, end: Moment = None) -> DataFrame:
    """Total, per-severity and per-service counts from one scan: ``facet, value, count``.

    The scan is reduced to (severity, service) pairs first, so the grouping sets expand
    a handful of rows and not the table.
    """
    pairs = (
        time_range(logs, start, end)
        .groupBy("severity_text", "service_name")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return facets_of(pairs)


def facets_of(pairs: DataFrame) -> DataFrame:
    """``facet, value, count`` of ``severity_text, service_name, n``."""
    sets = pairs.groupingSets(
        [[], ["severity_text"], ["service_name"]], "severity_text", "service_name"
    ).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("count"),
        F.grouping("severity_text").alias("no_severity"),
        F.grouping("service_name").alias("no_service"),
    )
    facet = (
        F.when((F.col("no_severity") == 1) & (F.col("no_service") == 1), "total")
        .when(F.col("no_severity") == 0, "severity")
        .otherwise("service")
    )
    return sets.select(
        facet.alias("facet"),
        F.coalesce("severity_text", "service_name").alias("value"),
        "count",
    )


def cards_of(facets: DataFrame) -> DataFrame:
    """The severity cards from an overview instead of the logs."""

    def level(name: str) -> Column:
        hit = (F.col("facet") == "severity") & (F.col("value") == name)
        return F.coalesce(F.sum(F.when(hit, F.col("count"))), F.lit(0))

    warn = level("WARN")
    total = F.sum(F.when(F.col("facet") == "total", F.col("count")))
    return facets.agg(
        F.coalesce(total, F.lit(0)).alias("total"),
        level("ERROR").alias("error"),
        F.when(warn > 0, warn).otherwise(level("WARNING")).alias("warn"),
        level("INFO").alias("info"),
    )


def bucket_counts(logs: DataFrame, width: str = "1h", keys: Sequence[str] = ()) -> DataFrame:
    """Records per time bucket (and key). Empty buckets are absent."""
    counts = logs.groupBy(*keys, bucket_window("timestamp", width).alias("w")).agg(_rows())
    return counts.select(*keys, F.col("w.start").alias("bucket_start"), "count")


def fill_buckets(
    series: DataFrame,
    start: Moment,
    end: Moment,
    width: str = "1h",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Series with a row for every bucket from ``start`` to ``end``, zero where empty."""
    step = F.expr(f"INTERVAL {WIDTHS[width_name(width)]}")
    every = F.explode(F.sequence(_floor(parse_ts(start), width), _floor(parse_ts(end), width), step))
    named = series.select(*keys).distinct() if keys else series.sparkSession.range(1)
    grid = named.select(*keys, every.alias("bucket_start"))
    joined = grid.alias("g").join(
        series.alias("s"),
        on=[F.col(f"g.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (*keys, "bucket_start")],
        how="left",
    )
    return joined.select(
        *[F.col(f"g.{c}").alias(c) for c in (*keys, "bucket_start")],
        F.coalesce(F.col("s.count"), F.lit(0)).alias("count"),
    )


def _floor(ts: Column, width: str) -> Column:
    seconds = WIDTH_SECONDS[width_name(width)]
    return F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / seconds) * seconds)


def labelled(series: DataFrame) -> DataFrame:
    """Series with its bucket start as ISO text, in time order."""
    rest = [c for c in series.columns if c not in ("bucket_start", "count")]
    return series.select(*rest, iso_label(F.col("bucket_start")).alias("ts"), "count").orderBy(
        *rest, "ts"
    )


def share_of_max(counts: DataFrame, column: str = "count") -> DataFrame:
    """Adds each count as a percentage of the largest.

    The maximum is a scalar subquery, so the counts never pass through one task.
    """
    top = counts.agg(F.max(column)).scalar()
    return counts.withColumn("share", F.round(100.0 * F.col(column) / top, 2))
