"""Small scalar expressions shared by the operators."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from timberline.schema import VALUE_KINDS

#: Bucket widths a caller may name. Fixed values; any other name means one hour.
WIDTHS = {
    "5m": "5 minutes",
    "15m": "15 minutes",
    "1h": "1 hour",
    "6h": "6 hours",
    "1d": "1 day",
}
WIDTH_SECONDS = {"5m": 300, "15m": 900, "1h": 3600, "6h": 21600, "1d": 86400}
DEFAULT_WIDTH = "1h"

#: Relative windows a caller may name, in minutes. Fixed values.
SPANS = {"15m": 15, "1h": 60, "6h": 360, "24h": 1440, "48h": 2880}
DEFAULT_SPAN = "24h"

#: Level name -> (severity number, severity text). Fixed values.
LEVELS = {
    "trace": (1, "TRACE"),
    "debug": (5, "DEBUG"),
    "info": (9, "INFO"),
    "notice": (10, "INFO"),
    "warn": (13, "WARN"),
    "warning": (13, "WARN"),
    "error": (17, "ERROR"),
    "crit": (21, "ERROR"),
    "fatal": (21, "ERROR"),
}
DEFAULT_LEVEL = "info"

ZERO_TRACE = "0" * 32
ZERO_SPAN = "0" * 16


def parse_ts(value: str | datetime | Column) -> Column:
    """ISO-8601 text (``T``, ``Z`` and offsets understood) or datetime to timestamp.

    Text without an offset is UTC, whatever the zone of the session; a datetime without one is
    local time, as Spark returns it. Text of other forms and columns are cast as Spark does it.
    """
    if isinstance(value, Column):
        return value.cast("timestamp")
    if not isinstance(value, datetime):
        try:
            at = datetime.fromisoformat(value.strip())
        except ValueError:
            return F.lit(value.strip()).cast("timestamp")
        at = at if at.tzinfo else at.replace(tzinfo=UTC)
    else:
        at = value.astimezone(UTC)
    since = at - datetime(1970, 1, 1, tzinfo=UTC)
    micros = (since.days * 86400 + since.seconds) * 1_000_000 + since.microseconds
    return F.timestamp_micros(F.lit(micros).cast("bigint"))


def unit_number(ts: Column, seconds: int) -> Column:
    """Number of the unit of so many seconds, counted from the epoch, that a time is in."""
    micros, unit = F.unix_micros(ts), F.lit(seconds * 1_000_000).cast("bigint")
    return F.call_function("div", micros - F.pmod(micros, unit), unit)


def unit_start(number: Column, seconds: int) -> Column:
    return F.timestamp_micros(number * F.lit(seconds * 1_000_000).cast("bigint"))


def utc_day(ts: Column) -> Column:
    """Date of a time in UTC, whatever the zone of the session."""
    return F.date_from_unix_date(unit_number(ts, 86400).cast("int"))


def _utc_text(ts: Column, pattern: str, between: str) -> Column:
    second = F.pmod(unit_number(ts, 1), F.lit(86400))
    hour, minute = F.floor(second / 3600), F.floor(second / 60) % 60
    clock = F.format_string(pattern, hour, minute, second % 60)
    return F.when(ts.isNotNull(), F.concat(utc_day(ts).cast("string"), F.lit(between), clock))


def width_name(width: str) -> str:
    """The width that is really used for a requested name."""
    return width if width in WIDTHS else DEFAULT_WIDTH


def bucket_window(ts: str | Column, width: str) -> Column:
    """Tumbling window aligned to the epoch."""
    return F.window(ts, WIDTHS[width_name(width)])


def iso_label(ts: Column) -> Column:
    return _utc_text(ts, "%02d:%02d:%02dZ", "T")


def hour_label(ts: Column) -> Column:
    return _utc_text(ts, "%02d:00:00Z", "T")


def nanos_to_ts(text: Column) -> Column:
    """Nanoseconds since the epoch, as text, to a microsecond timestamp."""
    nanos = text.try_cast("bigint")
    return F.timestamp_micros(F.call_function("div", nanos, F.lit(1000)))


def value_text(value: Column) -> Column:
    """Text of a document value of any kind; lists and maps as the JSON they came in."""
    return F.coalesce(*[value[kind] for kind in VALUE_KINDS])


def bag_of(pairs: Column) -> Column:
    """Key and value pairs to a map of texts; the last of equal keys wins."""
    known = F.filter(F.coalesce(pairs, F.array()), lambda p: p["key"].isNotNull())
    keys = F.array_distinct(F.transform(known, lambda p: p["key"]))
    last = F.transform(
        keys,
        lambda k: value_text(F.element_at(F.filter(known, lambda p: p["key"] == k), -1)["value"]),
    )
    return F.map_from_arrays(keys, last)


def bag_to_json(bag: Column) -> Column:
    return F.to_json(bag)


def json_to_bag(text: Column) -> Column:
    return F.from_json(text, "map<string,string>")


def short_trace(trace_id: Column) -> Column:
    """First 16 characters and an ellipsis; a dash where there is no trace."""
    return F.coalesce(
        F.concat(F.substring(F.nullif(trace_id, F.lit(ZERO_TRACE)), 1, 16), F.lit("…")),
        F.lit("—"),
    )


def short_time(ts: Column) -> Column:
    """Timestamp to the second in UTC, as shown in a result row."""
    return _utc_text(ts, "%02d:%02d:%02d", " ")


def level_severity(level: Column) -> Column:
    """Level name to ``struct<number, text>``; unknown and missing mean INFO."""

    def pair(name: str) -> Column:
        number, text = LEVELS[name]
        return F.struct(F.lit(number).alias("number"), F.lit(text).alias("text"))

    table = F.create_map(*[c for name in LEVELS for c in (F.lit(name), pair(name))])
    return F.coalesce(F.try_element_at(table, F.lower(level)), pair(DEFAULT_LEVEL))


def status_severity(status: Column) -> Column:
    """HTTP status to ``struct<number, text>``: 4xx WARN, 5xx ERROR, all else INFO."""
    family = F.floor(status / 100)
    name = F.when(family == 5, "error").when(family == 4, "warn").otherwise("info")
    return level_severity(name)
