"""Registered queries: each runs an operator over whole tables, most with check SQL."""

from timberline.registry import ingest, masks, patterns, search, stats  # noqa: F401
from timberline.registry.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
