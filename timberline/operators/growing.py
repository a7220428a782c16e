"""Mining that goes on: counts of masked lines are kept by batch and day, and models are made of them.

A model of many days needs no log record again: counts of lines are sums, so those of all batches
together are the counts of the whole table, and the model is the one that mining it at once would give.
Days leave the counts as they leave the table. Ids are hashes of templates, so a pattern whose template
did not change keeps its id; :func:`succession` tells where the lines of the others went.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timberline.functions.masks import select_masks
from timberline.functions.scalars import utc_day
from timberline.functions.templates import masked_line, skeleton
from timberline.operators.filters import non_empty_body
from timberline.operators.patterns import PatternModel, _with_entry, mine_counts
from timberline.schema import DAY
from timberline.settings import MiningConfig
from timberline.sources.files import Files, publish

LINES_DDL = f"masked string, count bigint, first_ts timestamp, last_ts timestamp, {DAY} date"


def lines_folder(path: str, masks: Iterable[str] | None = None) -> str:
    """Where the counts under a choice of masks are; another choice gives other lines."""
    chosen = ",".join(select_masks(masks))
    return f"{path}/lines-{hashlib.md5(chosen.encode()).hexdigest()[:12]}"


def add_lines(logs: DataFrame, path: str, name: str, masks: Iterable[str] | None = None) -> None:
    """Add the counts of a batch, by day; under the same name they replace themselves."""
    folder = lines_folder(path, masks)
    staging = f"{folder}/_staging/{name}"
    counts = (
        non_empty_body(logs)
        .select("body", "timestamp")
        .hint("rebalance")  # as in ``masked_counts``
        .select(
            utc_day(F.col("timestamp")).alias(DAY),
            masked_line(F.col("body"), select_masks(masks)).alias("masked"),
            "timestamp",
        )
        .groupBy(DAY, "masked")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.min("timestamp").alias("first_ts"),
            F.max("timestamp").alias("last_ts"),
        )
    )
    dealt = counts.hint("rebalance", F.col(DAY))
    dealt.write.mode("overwrite").partitionBy(DAY).parquet(staging)
    publish(logs.sparkSession, staging, folder, name)


def read_lines(spark: SparkSession, path: str, masks: Iterable[str] | None = None) -> DataFrame:
    """``masked, count, first_ts, last_ts, day``; a line comes once per day and batch."""
    folder = lines_folder(path, masks)
    if not Files(spark, folder).found(f"{folder}/{DAY}=*"):
        return spark.createDataFrame([], LINES_DDL)
    return spark.read.schema(LINES_DDL).parquet(folder)


def mine_lines(
    spark: SparkSession,
    path: str,
    masks: Iterable[str] | None = None,
    config: MiningConfig = MiningConfig(),
) -> PatternModel:
    """The model of everything the kept counts hold."""
    return mine_counts(read_lines(spark, path, masks).drop(DAY), masks, config)


def _assigned_lines(lines: DataFrame, model: PatternModel) -> DataFrame:
    placed = _with_entry(lines.withColumn("skeleton", skeleton(F.col("masked"))), model.profiles)
    return placed.join(model.entries.select("entry", "pattern_id"), "entry", "left").drop("entry")


def succession(old: PatternModel, new: PatternModel, lines: DataFrame) -> DataFrame:
    """``old_id, pattern_id, count, main``: how the lines of each old pattern are dealt to new ones.

    ``lines`` are counted lines both models know, such as those the old one was mined from. ``main`` marks
    the successor, the new pattern with most lines (ties by id); there is one for each old id. Lines that
    one of the models does not know have null there, and null is never the successor of lines it has.
    """
    if old.masks != new.masks:
        raise ValueError("the models see lines under different masks")
    numbered = lines.select("masked", "count").withColumn("line", F.col("masked"))
    first = _assigned_lines(numbered, old).withColumnRenamed("pattern_id", "old_id")
    both = _assigned_lines(first.withColumnRenamed("line", "masked"), new)
    moved = both.groupBy("old_id", "pattern_id").agg(F.sum("count").alias("count"))
    most = W.partitionBy("old_id").orderBy(
        F.col("pattern_id").isNull(), F.col("count").desc(), "pattern_id"
    )
    ranked = moved.withColumn("rank", F.row_number().over(most))
    return ranked.select(
        "old_id",
        "pattern_id",
        "count",
        ((F.col("rank") == 1) & F.col("old_id").isNotNull() & F.col("pattern_id").isNotNull()).alias("main"),
    )
