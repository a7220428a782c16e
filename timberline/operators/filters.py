"""Row filters and projections over the log table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.scalars import (
    DEFAULT_SPAN,
    SPANS,
    ZERO_SPAN,
    ZERO_TRACE,
    parse_ts,
    utc_day,
)
from timberline.functions.text import DEFAULT_MODE, match
from timberline.schema import DAY, PAGE_COLUMNS

Moment = str | datetime | Column | None


def _given(value: Moment) -> bool:
    return value is not None and not (isinstance(value, str) and value == "")


def time_range(logs: DataFrame, start: Moment = None, end: Moment = None) -> DataFrame:
    """Records from ``start`` to ``end``, both included; either may be left out.

    A day-partitioned table gets the matching day bounds too, because a filter on the
    timestamp alone does not prune partitions.
    """
    by_day = DAY in logs.columns
    if _given(start):
        at = parse_ts(start)
        logs = logs.where(F.col("timestamp") >= at)
        if by_day:
            logs = logs.where(F.col(DAY) >= utc_day(at))
    if _given(end):
        at = parse_ts(end)
        logs = logs.where(F.col("timestamp") <= at)
        if by_day:
            logs = logs.where(F.col(DAY) <= utc_day(at))
    return logs


def last(logs: DataFrame, span: str = DEFAULT_SPAN, as_of: Moment = None) -> DataFrame:
    """Records of the named span ending at ``as_of`` (now, when not given)."""
    if span not in SPANS:
        raise ValueError(f"span must be one of {', '.join(SPANS)}")
    end = parse_ts(as_of) if _given(as_of) else F.current_timestamp()
    return time_range(logs, end - F.make_dt_interval(mins=F.lit(SPANS[span])), end)


def by_severity(logs: DataFrame, severity: str) -> DataFrame:
    """Severity equality; the argument is upper-cased, the column is taken as it is."""
    return logs.where(F.col("severity_text") == severity.upper())


def by_service(logs: DataFrame, service: str) -> DataFrame:
    return logs.where(F.col("service_name") == service)


def filter_logs(
    logs: DataFrame,
    q: str = "",
    mode: str = DEFAULT_MODE,
    severity: str = "",
    service: str = "",
    start: Moment = None,
    end: Moment = None,
) -> DataFrame:
    """All given predicates together; an empty argument is no predicate.

    The cheap, pushable predicates are stated before the text search.
    """
    logs = time_range(logs, start, end)
    if severity:
        logs = by_severity(logs, severity)
    if service:
        logs = by_service(logs, service)
    if q:
        logs = logs.where(match(F.col("body"), q, mode))
    return logs


def by_attribute(logs: DataFrame, bag: str, key: str, value: str) -> DataFrame:
    """Records whose attribute bag holds the value under the key (dots are literal)."""
    return logs.where(F.try_element_at(F.col(bag), F.lit(key)) == value)


def by_trace(logs: DataFrame, trace_id: str) -> DataFrame:
    return logs.where(F.col("trace_id") == trace_id)


def by_span(logs: DataFrame, span_id: str) -> DataFrame:
    return logs.where(F.col("span_id") == span_id)


def by_instance(logs: DataFrame, instance_id: str) -> DataFrame:
    return logs.where(F.col("service_instance_id") == instance_id)


def by_scope(logs: DataFrame, name: str, version: str = "") -> DataFrame:
    logs = logs.where(F.col("scope_name") == name)
    return logs.where(F.col("scope_version") == version) if version else logs


def nullify_zero_ids(logs: DataFrame) -> DataFrame:
    """All-zero trace and span ids mean there is none."""
    return logs.withColumns(
        {
            "trace_id": F.nullif(F.col("trace_id"), F.lit(ZERO_TRACE)),
            "span_id": F.nullif(F.col("span_id"), F.lit(ZERO_SPAN)),
        }
    )


def non_empty_body(logs: DataFrame) -> DataFrame:
    return logs.where(F.col("body").isNotNull() & (F.col("body") != ""))


def page_columns(logs: DataFrame, with_id: bool = False) -> DataFrame:
    """The columns of a search page, the timestamp as text."""
    picked = [
        F.col(c).cast("string").alias(c) if c == "timestamp" else F.col(c) for c in PAGE_COLUMNS
    ]
    return logs.select(*([F.col("log_id")] if with_id else []), *picked)
