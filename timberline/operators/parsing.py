"""Structured fields from the three raw line formats, and a quarantine for the rest.

A format is one anchored pattern. A line is rewritten once to its groups with a
separator between them and split, so every line is matched once however many fields the
format has. Lines that hold the separator themselves are matched group by group. The first
characters tell which pattern to try first; an access line may begin with any of them. One
line break at the end of a line is no part of it.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.scalars import level_severity, status_severity

SEP = "\u0001"

# ---------------------------------------------------------------------------
# The line formats, in field order.
# ---------------------------------------------------------------------------

# ip ident user [time] "method target protocol" status size "referer" "agent"
ACCESS = (
    r'(?s)^(\S+) \S+ (\S+) \[([^\]]+)\] "(\S+) (\S+) ([^"]*)" ([0-9]{3}) ([0-9]+|-) '
    r'"([^"]*)" "([^"]*)"\r?\n?\z'
)
ACCESS_FIELDS = (
    "ip", "user", "time", "method", "target", "protocol", "status", "size", "referer", "agent",
)

MONTH_NAMES = "JanFebMarAprMayJunJulAugSepOctNovDec"

# [weekday month day time year? zone?] [level] [pid n] message
BRACKETED = (
    r"(?s)^\[(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun) (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
    r" +([0-9]{1,2}) ([0-9:]{8}(?:\.[0-9]{1,6})?)(?: ([0-9]{4}))?(?: UTC)?\]"
    r" \[(\w+)\] \[pid ([0-9]+)\] (.*?)\r?\n?\z"
)
BRACKETED_FIELDS = ("month", "dom", "clock", "year", "level", "pid", "message")

# y/m/d h:m:s [level] pid#tid: *cid message
SLASHED = (
    r"(?s)^([0-9]{4}/[0-9]{2}/[0-9]{2} [0-9:]{8}) \[(\w+)\] ([0-9]+)#([0-9]+): "
    r"\*([0-9]+) (.*?)\r?\n?\z"
)
SLASHED_FIELDS = ("time", "level", "pid", "tid", "cid", "message")


Pick = Callable[[str], Column]


def _groups(body: Column, pattern: str, names: tuple[str, ...]) -> Column:
    """The groups of a matching line as an array; null for any other line.

    The lambda gives the groups a name, so that the pattern is matched once.
    """
    joined = SEP.join(f"${i + 1}" for i in range(len(names)))
    parts = F.split(F.regexp_replace(body, pattern, joined), SEP)
    whole = F.filter(F.array(parts), lambda g: F.size(g) == len(names))
    each = F.array(*[F.regexp_extract(body, pattern, i + 1) for i in range(len(names))])
    return F.when(
        F.contains(body, F.lit(SEP)), F.when(F.rlike(body, F.lit(pattern)), each)
    ).otherwise(F.get(whole, F.lit(0)))


def _pick(parts: Column, names: tuple[str, ...]) -> Pick:
    return lambda name: F.get(parts, F.lit(names.index(name)))


def _access(f: Pick) -> dict[str, Column]:
    return {
        "ip": f("ip"),
        "user": f("user"),
        "event_time": F.try_to_timestamp(f("time"), F.lit("dd/MMM/yyyy:HH:mm:ss Z")),
        "method": f("method"),
        "target": f("target"),
        "protocol": f("protocol"),
        "status": f("status").try_cast("int"),
        "size": f("size").try_cast("bigint"),
        "referer": f("referer"),
        "agent": f("agent"),
    }


def _bracketed(f: Pick, seen: Column) -> dict[str, Column]:
    """A line without a year gets the one that puts it closest to ``seen``."""

    def at(year: Column) -> Column:
        month = F.ceil(F.instr(F.lit(MONTH_NAMES), f("month")) / 3)
        parts = [year, F.lit("-"), month, F.lit("-"), f("dom"), F.lit(" "), f("clock")]
        return F.concat(*[p.cast("string") for p in parts]).try_cast("timestamp")

    own = F.year(seen)
    gap = F.datediff(at(own), seen)
    guessed = F.when(gap > 183, at(own - 1)).when(gap < -183, at(own + 1)).otherwise(at(own))
    return {
        "event_time": F.when(f("year") != "", at(f("year"))).otherwise(guessed),
        "level": f("level"),
        "pid": f("pid").try_cast("int"),
        "message": f("message"),
    }


def _slashed(f: Pick) -> dict[str, Column]:
    return {
        "event_time": F.try_to_timestamp(f("time"), F.lit("yyyy/MM/dd HH:mm:ss")),
        "level": f("level"),
        "pid": f("pid").try_cast("int"),
        "tid": f("tid").try_cast("int"),
        "cid": f("cid").try_cast("bigint"),
        "message": f("message"),
    }


def _with(logs: DataFrame, pattern: str, names: tuple[str, ...], build) -> DataFrame:
    body = F.col("body")
    rows = logs.select("*", _groups(body, pattern, names).alias("_parts"))
    columns = build(_pick(F.col("_parts"), names))
    return rows.select(*logs.columns, *[c.alias(n) for n, c in columns.items()])


def parse_access(logs: DataFrame) -> DataFrame:
    """Adds the fields of an access line; all null where the body is none."""
    return _with(logs, ACCESS, ACCESS_FIELDS, _access)


def parse_apache_error(logs: DataFrame) -> DataFrame:
    """Adds the fields of a bracketed error line."""
    return _with(logs, BRACKETED, BRACKETED_FIELDS, lambda f: _bracketed(f, F.col("timestamp")))


def parse_nginx_error(logs: DataFrame) -> DataFrame:
    """Adds the fields of a slash-date error line."""
    return _with(logs, SLASHED, SLASHED_FIELDS, _slashed)


class ParsedLogs(NamedTuple):
    parsed: DataFrame
    rejects: DataFrame


ID_COLUMNS = ("log_id", "timestamp", "service_name", "body")

PARSED_FIELDS = (
    "event_time", "ip", "user", "method", "target", "protocol", "status", "size", "referer",
    "agent", "level", "pid", "tid", "cid", "message",
)


def line_kind(body: Column) -> Column:
    """The format to try first, judged by the first characters of a line."""
    return (
        F.when(F.startswith(body, F.lit("[")), "apache_error")
        .when(F.rlike(body, F.lit("^[0-9]{4}/")), "nginx_error")
        .otherwise("access")
    )


def line_parts(body: Column) -> Column:
    """``struct<kind, parts>``: the format a line has and its groups; null where it has none."""
    kind = line_kind(body)

    def found(name: str, pattern: str, fields: tuple[str, ...]) -> Column:
        parts = _groups(body, pattern, fields)
        return F.get(
            F.transform(
                F.filter(F.array(parts), lambda g: g.isNotNull()),
                lambda g: F.struct(F.lit(name).alias("kind"), g.alias("parts")),
            ),
            F.lit(0),
        )

    return F.coalesce(
        F.when(kind == "apache_error", found("apache_error", BRACKETED, BRACKETED_FIELDS)),
        F.when(kind == "nginx_error", found("nginx_error", SLASHED, SLASHED_FIELDS)),
        found("access", ACCESS, ACCESS_FIELDS),
    )


def parse_logs(logs: DataFrame) -> ParsedLogs:
    """All formats in one table, with derived severity; lines that fit none apart.

    Parsed rows carry ``log_type`` and ``error_type`` as the producers state them. Each
    of the two results is one pass over ``logs``, without a shuffle.
    """
    body = F.col("body")
    # Exploding a one-element array keeps the tests below above the matching: a plain
    # column would be matched for the test and again for the result.
    rows = logs.select(*ID_COLUMNS, F.explode(F.array(line_parts(body))).alias("_line")).select(
        *ID_COLUMNS, F.col("_line.kind").alias("_kind"), F.col("_line.parts").alias("_parts")
    )
    fits = F.col("_parts").isNotNull()
    parts = F.col("_parts")
    by_kind = {
        "access": _access(_pick(parts, ACCESS_FIELDS)),
        "apache_error": _bracketed(_pick(parts, BRACKETED_FIELDS), F.col("timestamp")),
        "nginx_error": _slashed(_pick(parts, SLASHED_FIELDS)),
    }

    def field(name: str) -> Column:
        column = None
        for k, columns in by_kind.items():
            if name in columns:
                test = F.col("_kind") == k
                column = (
                    F.when(test, columns[name]) if column is None
                    else column.when(test, columns[name])
                )
        return column.alias(name)

    is_access = F.col("_kind") == "access"
    shaped = rows.where(fits).select(
        *ID_COLUMNS,
        F.when(is_access, "access").otherwise("error").alias("log_type"),
        F.when(~is_access, F.col("_kind")).alias("error_type"),
        *[field(name) for name in PARSED_FIELDS],
    )
    severity = F.when(
        F.col("log_type") == "access", status_severity(F.col("status"))
    ).otherwise(level_severity(F.col("level")))
    parsed = shaped.select(
        "*", severity["number"].alias("severity_number"), severity["text"].alias("severity_text")
    )
    rejects = rows.where(~fits).select(
        *ID_COLUMNS,
        F.when(F.coalesce(body, F.lit("")) == "", "empty")
        .otherwise("no known format")
        .alias("reason"),
    )
    return ParsedLogs(parsed, rejects)
