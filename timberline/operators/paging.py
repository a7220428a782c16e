"""Newest-first pages, caps and heads."""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.scalars import parse_ts, unit_number, unit_start, utc_day
from timberline.operators.filters import Moment, filter_logs, page_columns
from timberline.operators.rollup import counted
from timberline.schema import DAY
from timberline.sources.scratch import materialize

DEFAULT_LIMIT = 200
MAX_LIMIT = 2000
DEFAULT_CAP = 50_000
MAX_CAP = 200_000
DEEP_OFFSET = 10_000


class LogPage(NamedTuple):
    rows: DataFrame
    total: DataFrame


def newest_first() -> list[Column]:
    """Total order: the record id breaks ties of the timestamp."""
    return [F.col("timestamp").desc(), F.col("log_id").desc()]


def _check(limit: int, offset: int = 0) -> None:
    if not 0 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be between 0 and {MAX_LIMIT}")
    if offset < 0:
        raise ValueError("offset must not be negative")


def log_page(
    logs: DataFrame,
    limit: int = DEFAULT_LIMIT,
    offset: int = 0,
    with_id: bool = False,
    deep_offset: int = DEEP_OFFSET,
    counts: DataFrame | None = None,
    **filters,
) -> LogPage:
    """One page under the given filters, and the total under the same filters.

    Spark skips an offset by holding ``offset + limit`` rows in one place. Beyond
    ``deep_offset`` rows the page is therefore looked for first, by counts per day, hour,
    minute and second; only the second it starts in is left to skip in. Cheaper still is
    to hand the last row of a page to :func:`log_page_after`.

    With the table's kept ``counts`` (see ``rollup``) the total and the place are found from them, and
    only the minute it starts in is counted in the records. A text search has no counts.
    """
    _check(limit, offset)
    found = filter_logs(logs, **filters)
    sizes = None
    if counts is not None and not filters.get("q"):
        sizes = materialize(_minute_sizes(logs, counts, **filters), "sizes")
    rest, skip = (found, offset) if offset <= deep_offset else _seek(found, offset, sizes)
    page = rest.orderBy(*newest_first())
    if skip:
        page = page.offset(skip)
    total = F.count(F.lit(1)) if sizes is None else F.coalesce(F.sum("n"), F.lit(0))
    return LogPage(
        page_columns(page.limit(limit), with_id),
        (found if sizes is None else sizes).agg(total.alias("total")),
    )


def _minute_sizes(
    logs: DataFrame,
    counts: DataFrame,
    severity: str = "",
    service: str = "",
    start: Moment = None,
    end: Moment = None,
    **_,
) -> DataFrame:
    """``timestamp, n`` by minute of the records under filters other than text, from kept counts."""
    rows = filter_logs(counted(logs, counts, start, end), severity=severity, service=service)
    return rows.groupBy(F.col("minute").alias("timestamp")).agg(F.sum("n").alias("n"))


def _seek(found: DataFrame, offset: int, sizes: DataFrame | None = None) -> tuple[DataFrame, int]:
    """Rows from the second on that holds row number ``offset``, and how many to skip."""
    ts = F.col("timestamp")
    ones = found.withColumn("n", F.lit(1))
    scope, end, skip = ones if sizes is None else sizes, None, offset
    for seconds in (86400, 3600, 60, 1):
        counts = scope.groupBy(unit_number(ts, seconds).alias("start")).agg(F.sum("n").alias("count"))
        # One row per calendar unit of the unit above: few, whatever the table holds.
        for row in counts.orderBy(F.col("start").desc_nulls_last()).collect():
            if skip < row["count"]:
                break
            skip -= row["count"]
        else:
            return found.where(F.lit(False)), 0
        if row["start"] is None:
            return found.where(ts.isNull()), skip
        first = unit_start(F.lit(row["start"]), seconds)
        end = unit_start(F.lit(row["start"] + 1), seconds)
        # minutes are not cut by any unit but the second
        source = ones if sizes is None or seconds == 60 else sizes
        scope = source.where((ts >= first) & (ts < end))
        if DAY in source.columns:
            scope = scope.where(F.col(DAY).between(utc_day(first), utc_day(end)))
    rest = found.where((ts < end) | ts.isNull())
    if DAY in found.columns:
        rest = rest.where((F.col(DAY) <= utc_day(end)) | F.col(DAY).isNull())
    return rest, skip


def log_page_after(
    logs: DataFrame,
    timestamp: str | datetime | None,
    log_id: int,
    limit: int = DEFAULT_LIMIT,
    shown: int = 1,
    **filters,
) -> DataFrame:
    """The page that follows the record ``(timestamp, log_id)``.

    Records may be stored more than once: ``shown`` tells how many with this time and id the
    pages so far have held. Records without time come last, in offset pages and here.
    """
    _check(limit, shown)
    found, ts, own = filter_logs(logs, **filters), F.col("timestamp"), F.col("log_id")
    if timestamp is None:
        older, equal = ts.isNull() & (own < log_id), ts.isNull() & (own == log_id)
    else:
        at = parse_ts(timestamp)
        older = ts.isNull() | (ts < at) | ((ts == at) & (own < log_id))
        equal = (ts == at) & (own == log_id)
        if DAY in found.columns:
            found = found.where((F.col(DAY) <= utc_day(at)) | F.col(DAY).isNull())
    rest = found.where(older).unionByName(found.where(equal).offset(shown))
    return page_columns(rest.orderBy(*newest_first()).limit(limit), with_id=True)


def cap_rows(logs: DataFrame, n: int = DEFAULT_CAP, newest: bool = True) -> DataFrame:
    """The newest (or oldest) ``n`` records; an opt-in guard, nothing here needs it."""
    if not 0 <= n <= MAX_CAP:
        raise ValueError(f"n must be between 0 and {MAX_CAP}")
    order = newest_first() if newest else [F.col("timestamp").asc(), F.col("log_id").asc()]
    return logs.orderBy(*order).limit(n)


def tail_logs(logs: DataFrame, n: int = 20, width: int = 80) -> DataFrame:
    """The newest ``n`` records on one short line each."""
    _check(n)
    return (
        logs.orderBy(*newest_first())
        .limit(n)
        .select(
            F.col("timestamp").cast("string").alias("timestamp"),
            "severity_text",
            "service_name",
            F.substring("body", 1, width).alias("body"),
        )
    )
