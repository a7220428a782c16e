"""Live volume and live pattern matching."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from timberline.functions.scalars import bucket_window, parse_ts, utc_day
from timberline.operators.filters import Moment
from timberline.operators.matching import TreeIndex, match_many
from timberline.operators.patterns import (
    PatternModel,
    assign_patterns,
    index_patterns,
    match_patterns,
)
from timberline.schema import DAY
from timberline.sources.files import Files, finish_replacements, publish, replace
from timberline.streaming.ingest import batch_name


def ahead_of_time(stream: DataFrame, ahead: str = "1 hour") -> DataFrame:
    """Records dated further ahead of their arrival than ``ahead``; see :func:`stream_volume`."""
    return stream.where(F.col("timestamp") > F.current_timestamp() + F.expr(f"INTERVAL {ahead}"))


def stream_volume(
    stream: DataFrame,
    width: str = "1h",
    lateness: str = "10 minutes",
    keys: Sequence[str] = (),
    ahead: str = "1 hour",
) -> DataFrame:
    """Records per time bucket (and key) of a stream.

    In append mode a bucket comes out once, when the watermark passes its end. Records dated
    further ahead than ``ahead`` would close all buckets at once; they are not counted here but
    are what :func:`ahead_of_time` gives. Records later than ``lateness`` are counted by the
    query's progress as dropped by the watermark. :func:`stream_counts` counts both.
    """
    counts = (
        stream.where(F.col("timestamp") <= F.current_timestamp() + F.expr(f"INTERVAL {ahead}"))
        .withWatermark("timestamp", lateness)
        .groupBy(*keys, bucket_window("timestamp", width).alias("w"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return counts.select(*keys, F.col("w.start").alias("bucket_start"), "count")


def stream_counts(
    stream: DataFrame,
    target: str,
    checkpoint: str,
    width: str = "1h",
    keys: Sequence[str] = (),
    available_now: bool = False,
    trigger: str = "5 seconds",
) -> StreamingQuery:
    """Records per time bucket (and key), with nothing withheld and nothing left out.

    Each micro-batch publishes what it adds to its buckets under its own name, however late or early its
    records are, so a late one is a correction of a bucket that is out already. :func:`read_volume` sums
    them up; :func:`merge_volume` makes one file of a day's. No state, no watermark. Only records
    without time have no bucket and are not counted.
    """

    def load(batch: DataFrame, batch_id: int) -> None:
        name = batch_name(checkpoint, batch_id)
        counts = batch.groupBy(*keys, bucket_window("timestamp", width).alias("w")).agg(
            F.count(F.lit(1)).alias("count")
        )
        _write_volume(counts.select(*keys, F.col("w.start").alias("bucket_start"), "count"), target, name)
        publish(batch.sparkSession, f"{target}/_staging/{name}", target, name)

    writer = stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=trigger).start()


def _write_volume(counts: DataFrame, target: str, name: str) -> None:
    dealt = counts.withColumn(DAY, utc_day(F.col("bucket_start"))).hint("rebalance", F.col(DAY))
    dealt.write.mode("overwrite").partitionBy(DAY).parquet(f"{target}/_staging/{name}")


def _volume_parts(spark: SparkSession, target: str, keys: Sequence[str]) -> DataFrame:
    texts = [f"`{k}` string" for k in keys]
    schema = ", ".join([*texts, "bucket_start timestamp", "count bigint", f"{DAY} date"])
    if not Files(spark, target).found(f"{target}/{DAY}=*"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(target)


def read_volume(
    spark: SparkSession, target: str, keys: Sequence[str] = (), start: Moment = None, end: Moment = None
) -> DataFrame:
    """``keys..., bucket_start, count`` as of now, of buckets that begin in a range (ends included).

    ``keys`` are those of the stream or some of them, text columns.
    """
    parts, at = _volume_parts(spark, target, keys), F.col("bucket_start")
    if start not in (None, ""):
        parts = parts.where((at >= parse_ts(start)) & (F.col(DAY) >= utc_day(parse_ts(start))))
    if end not in (None, ""):
        parts = parts.where((at <= parse_ts(end)) & (F.col(DAY) <= utc_day(parse_ts(end))))
    return parts.groupBy(*keys, "bucket_start").agg(F.sum("count").alias("count"))


def merge_volume(spark: SparkSession, target: str, day: str, keys: Sequence[str] = ()) -> int:
    """One set of counts in place of those of a day's batches; returns how many files there were.

    ``keys`` are all those of the stream. It may stop anywhere, as ``compact_day`` may; for days that no
    stream writes to meanwhile.
    """
    finish_replacements(spark, target)
    folder = f"{target}/{DAY}={day}"
    files = Files(spark, target).found(f"{folder}/*.parquet")
    if len(files) > 1:
        name = f"compact-{day}"
        parts = _volume_parts(spark, target, keys).where(F.col(DAY) == F.lit(day).cast("date"))
        sums = parts.groupBy(*keys, "bucket_start").agg(F.sum("count").alias("count"))
        _write_volume(sums, target, name)
        replace(spark, f"{target}/_staging/{name}", folder, files, f"merged{uuid.uuid4().hex[:8]}")
    return len(files)


def stream_assign(stream: DataFrame, model: PatternModel) -> DataFrame:
    """Stream rows with the pattern their entry had when the model was mined.

    Two stream-static joins, no state. Rows that lead to no known entry carry no pattern.
    """
    return assign_patterns(stream, model)


def stream_match(
    stream: DataFrame,
    patterns: DataFrame | TreeIndex,
    target: str,
    checkpoint: str,
    masks: Iterable[str] | None = None,
    available_now: bool = False,
    trigger: str = "5 seconds",
) -> StreamingQuery:
    """Match each micro-batch against saved patterns and append the result.

    Matching keeps no state and writes nothing but the result. A batch that is run again
    replaces its own folder, which is named by checkpoint and batch: several streams can share a target.
    Very many patterns are given as an index of trees; what is found is the same.
    """
    chosen = None if masks is None else tuple(masks)
    trees = isinstance(patterns, TreeIndex)
    index = patterns if trees else index_patterns(patterns)
    match = match_many if trees else match_patterns

    def load(batch: DataFrame, batch_id: int) -> None:
        matched = match(batch, index, chosen)
        matched.write.mode("overwrite").parquet(f"{target}/batch={batch_name(checkpoint, batch_id)}")

    writer = stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    writer = (
        writer.trigger(availableNow=True)
        if available_now
        else writer.trigger(processingTime=trigger)
    )
    return writer.start()
