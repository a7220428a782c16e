"""Search page, service list and overview."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.functions.text import DEFAULT_MODE
from timberline.operators.filters import Moment
from timberline.operators.paging import DEFAULT_LIMIT, LogPage, log_page
from timberline.operators.search import TermIndex, search_index
from timberline.operators.stats import cards_of, hourly_volume, overview, services
from timberline.sources.scratch import materialize


class Overview(NamedTuple):
    total: DataFrame
    by_severity: DataFrame
    by_service: DataFrame
    cards: DataFrame
    hourly: DataFrame


def search_logs(
    logs: DataFrame,
    q: str = "",
    severity: str = "",
    service: str = "",
    start: Moment = "",
    end: Moment = "",
    limit: int = DEFAULT_LIMIT,
    offset: int = 0,
    q_mode: str = DEFAULT_MODE,
    index: TermIndex | DataFrame | None = None,
) -> LogPage:
    """One page of matching records, newest first, and how many match in all.

    With a term index of the table (see ``operators.search``) the text is looked up there, with
    the same result, and only records found are read.
    """
    if index is not None and q:
        logs, q = search_index(index, logs, q, q_mode), ""
    return log_page(
        logs, limit, offset, q=q, mode=q_mode, severity=severity, service=service,
        start=start, end=end,
    )


def service_names(logs: DataFrame) -> DataFrame:
    return services(logs)


def overview_report(
    logs: DataFrame, start: Moment = "", end: Moment = "", as_of: Moment = None
) -> Overview:
    """Totals, severities and services of a range, and the volume of the last 24 hours.

    The range is scanned once, at the call; everything but the volume is read from the
    handful of counts that gives.
    """
    facets = materialize(overview(logs, start, end), "facets")

    def facet(kind: str, name: str) -> DataFrame:
        return facets.where(F.col("facet") == kind).select(F.col("value").alias(name), "count")

    by_service = facet("service", "service").orderBy(
        F.col("count").desc(), F.col("service").asc_nulls_first()
    )
    return Overview(
        facet("total", "value").select(F.col("count").alias("total")),
        facet("severity", "severity"),
        by_service,
        cards_of(facets),
        hourly_volume(logs, as_of),
    )
