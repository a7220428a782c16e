"""Registration and shared pieces of check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.fixtures import LOGS_SQL

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: "Now" of every registered query; the newest event is on the same day.
AS_OF = "2024-01-30T12:00:00Z"
START = "2024-01-05T06:00:00Z"
END = "2024-01-20T18:30:00Z"
SQL_AS_OF = "TIMESTAMP '2024-01-30 12:00:00'"
SQL_START = "TIMESTAMP '2024-01-05 06:00:00'"
SQL_END = "TIMESTAMP '2024-01-20 18:30:00'"
IN_RANGE = f"timestamp >= {SQL_START} AND timestamp <= {SQL_END}"

LOGS_CTE = f"WITH logs AS ({LOGS_SQL})"


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return add


def on_logs(select: str, *ctes: str) -> str:
    """Check SQL over the fixture logs, with further CTEs."""
    return ", ".join([LOGS_CTE, *ctes]) + "\n" + select


def text(column: str = "timestamp") -> Column:
    """Timestamp as text under its own name."""
    return F.col(column).cast("string").alias(column)


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"
