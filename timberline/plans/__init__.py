"""Whole questions a user asks, put together from the operators."""

from timberline.plans.explorer import overview_report, search_logs, service_names
from timberline.plans.mining import (
    pattern_report,
    pattern_sample_report,
    pattern_timeseries,
)

__all__ = [
    "overview_report",
    "pattern_report",
    "pattern_sample_report",
    "pattern_timeseries",
    "search_logs",
    "service_names",
]
