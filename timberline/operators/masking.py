"""Masking over tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.functions.masks import CATEGORIES, RULES, apply_masks, select_masks
from timberline.functions.templates import masked_line
from timberline.operators.filters import non_empty_body


def mask_bodies(logs: DataFrame, ids: Iterable[str] | None = None) -> DataFrame:
    """Logs with a ``masked`` column."""
    return logs.withColumn("masked", apply_masks(F.col("body"), ids))


def masked_counts(logs: DataFrame, ids: Iterable[str] | None = None) -> DataFrame:
    """How often each masked line occurs, with its first and last time."""
    # masking is most of the work, and a file with one row group would leave it to one task
    dealt = non_empty_body(logs).select("body", "timestamp").hint("rebalance")
    lines = dealt.select(masked_line(F.col("body"), ids).alias("masked"), "timestamp")
    return lines.groupBy("masked").agg(
        F.count(F.lit(1)).alias("count"),
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
    )


def mask_report(
    logs: DataFrame, ids: Iterable[str] | None = None, body: str = "body"
) -> DataFrame:
    """Rows and matches of every rule over a table, in one scan.

    Each rule counts on the unmasked body, so rules that compete for the same text can
    be seen side by side.
    """
    active = select_masks(ids)
    hits = logs.select(F.col(body)).hint("rebalance").select(
        *[F.regexp_count(F.col(body), F.lit(r.pattern)).alias(r.id) for r in RULES]
    )
    sums = hits.agg(
        *[F.count_if(F.col(r.id) > 0).alias(f"{r.id}_rows") for r in RULES],
        *[F.coalesce(F.sum(r.id), F.lit(0)).alias(f"{r.id}_matches") for r in RULES],
    )
    lines = F.array(
        *[
            F.struct(
                F.lit(CATEGORIES.index(r.category)).alias("category_order"),
                F.lit(r.category).alias("category"),
                F.lit(r.id).alias("rule"),
                F.lit(r.label).alias("label"),
                F.lit(r.token).alias("token"),
                F.lit(r.id in active).alias("active"),
                F.col(f"{r.id}_rows").alias("rows"),
                F.col(f"{r.id}_matches").alias("matches"),
            )
            for r in RULES
        ]
    )
    return sums.select(F.inline(lines))


def mask_catalogue(spark, ids: Iterable[str] | None = None) -> DataFrame:
    """The rules themselves, with their state under a selection."""
    active = select_masks(ids)
    rows = [
        (r.id, r.label, r.description, r.pattern, r.token, list(r.examples), r.category,
         r.default, r.id in active)
        for r in RULES
    ]
    return spark.createDataFrame(
        rows,
        "id string, label string, description string, pattern string, token string, "
        "examples array<string>, category string, default boolean, active boolean",
    )
