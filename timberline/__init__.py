"""Log analytics on Spark DataFrames: search, statistics, masking and pattern mining."""

from timberline.schema import DAY, LOG_COLUMNS, LOG_SCHEMA, OTLP_SCHEMA
from timberline.session import build_session
from timberline.settings import MiningConfig

__all__ = [
    "DAY",
    "LOG_COLUMNS",
    "LOG_SCHEMA",
    "OTLP_SCHEMA",
    "MiningConfig",
    "build_session",
]
