"""Replays of any age: a membership filter per day beside the table, and an exact look at what it doubts.

The filter is a bitmap over the hash of ``(timestamp, log_id)``, cut into buckets of 32,768 bits that Spark
builds and joins by itself. Every batch publishes the bits of its rows under its own name before its rows;
the bitmaps of all batches together are the day's filter. A record whose bit is not set has never come;
one whose bit is set is looked for in the table, in its own day only. So the load keeps no state, whatever
the age of a replay, and the width of a filter decides how often the table is read and not what is kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.functions.scalars import utc_day
from timberline.schema import DAY
from timberline.sources.files import (
    Files,
    batch_names,
    done_names,
    finish_replacements,
    mark_done,
    publish,
    replace,
)
from timberline.sources.logs import read_logs
from timberline.sources.scratch import materialize

KEYS = ("timestamp", "log_id")
#: Buckets of a day's filter. Ten bits a record leave one new record in ten in doubt: 256 are enough for
#: 800,000 records a day and take 1 MB; take 300,000 (1.2 GB) for 10**9. Filters of other widths stay in use.
BUCKETS = 256
BITS = 32_768
FILTER_DDL = f"buckets int, bucket bigint, bits binary, {DAY} date"


def _place(buckets: int | Column) -> Column:
    """Number of a record's bit, from 1."""
    width = (F.lit(buckets) if isinstance(buckets, int) else buckets).cast("bigint") * BITS
    return F.pmod(F.xxhash64(*KEYS), width) + 1


def _is_set(bits: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (position % 8).cast("int")).bitwiseAND(F.lit(1)) == 1


def _of_days(rows: DataFrame, days: Sequence) -> DataFrame:
    """Rows of the given days, null among them; as many values as days."""
    dated = [d for d in days if d is not None]
    inside = F.col(DAY).isin(*dated) if dated else F.lit(False)
    return rows.where(inside | F.col(DAY).isNull() if len(dated) < len(days) else inside)


def _days(rows: DataFrame) -> list:
    return [r[0] for r in rows.select(DAY).distinct().collect()]


def _write(filters: DataFrame, staging: str) -> None:
    dealt = filters.hint("rebalance", F.col(DAY)).sortWithinPartitions(DAY, "buckets", "bucket")
    dealt.write.mode("overwrite").partitionBy(DAY).parquet(staging)


def day_filters(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``day, buckets, bucket, bits`` of records; one row per bucket with a bit."""
    place = _place(buckets)
    marked = rows.select(
        utc_day(F.col("timestamp")).alias(DAY),
        F.bitmap_bucket_number(place).alias("bucket"),
        F.bitmap_bit_position(place).alias("bit"),
    )
    return marked.groupBy(DAY, "bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).select(
        DAY, F.lit(buckets).alias("buckets"), "bucket", "bits"
    )


def publish_seen(
    rows: DataFrame, seen: str, name: str, folders: Collection[str], buckets: int = BUCKETS
) -> None:
    """Add the bits of a batch under its name and mark its days; again, it replaces itself."""
    staging = f"{seen}/_staging/{name}"
    _write(day_filters(rows, buckets), staging)
    publish(rows.sparkSession, staging, seen, name)
    mark_done(rows.sparkSession, seen, folders, name)


def read_seen(spark: SparkSession, seen: str) -> DataFrame:
    """Merged filters: ``day, buckets, bucket, bits``."""
    if not Files(spark, seen).found(f"{seen}/{DAY}=*"):
        return spark.createDataFrame([], FILTER_DDL).select(DAY, "buckets", "bucket", "bits")
    return _merged(spark.read.schema(FILTER_DDL).parquet(seen))


def _merged(filters: DataFrame) -> DataFrame:
    return filters.groupBy(DAY, "buckets", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def doubtful(rows: DataFrame, filters: DataFrame) -> DataFrame:
    """Rows (with their day) whose bit is set in a filter of their day."""
    day = F.coalesce(F.col(DAY).cast("string"), F.lit(""))
    known = filters.withColumn("_of", day).drop(DAY)
    # one row per width in use on a day
    widths = known.select("_of", F.col("buckets").alias("_width")).distinct()
    probes = rows.withColumn("_of", day).join(widths, "_of").withColumn("_at", _place(F.col("_width")))
    probes = probes.withColumn("bucket", F.bitmap_bucket_number("_at"))
    met = probes.join(known.withColumnRenamed("buckets", "_width"), ["_of", "_width", "bucket"])
    return met.where(_is_set(F.col("bits"), F.bitmap_bit_position("_at"))).select(*rows.columns)


def without_replays(batch: DataFrame, target: str, seen: str, name: str) -> DataFrame:
    """A batch without records the table has from other batches, each of the rest once.

    The files of the batch itself do not count: when it runs again, it replaces them. Records without
    time or id are compared by null like any value.
    """
    spark = batch.sparkSession
    rows = materialize(
        batch.dropDuplicates(list(KEYS)).withColumn(DAY, utc_day(F.col("timestamp"))), "arrived"
    )
    filters = _of_days(read_seen(spark, seen), _days(rows))
    open_ = materialize(doubtful(rows.select(*KEYS, DAY), filters).distinct(), "doubtful")
    days = _days(open_)
    if not days or not Files(spark, target).found(f"{target}/{DAY}=*"):
        return rows.drop(DAY)
    own = F.col("_metadata.file_name").startswith(f"{name}-")
    stored = _of_days(read_logs(spark, target).where(~own), days).select(*[F.col(k).alias(f"_{k}") for k in KEYS])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEYS]
    replays = materialize(open_.join(stored, same, "left_semi"), "replays")
    marked = replays.select(*[F.col(k).alias(f"_{k}") for k in KEYS])
    return rows.join(marked, same, "left_anti").drop(DAY)


def catch_up(spark: SparkSession, target: str, seen: str, buckets: int = BUCKETS) -> list[str]:
    """Filters anew for the days with batches that the filters do not have (plain appends, compactions)."""
    done, files, caught = done_names(spark, seen), Files(spark, seen), []
    for folder, names in sorted(batch_names(spark, target).items()):
        if names <= done.get(folder, set()):
            continue
        day = folder.removeprefix(f"{DAY}=")
        own = F.col(DAY).isNull() if day.startswith("__") else F.col(DAY) == F.lit(day).cast("date")
        name, old = f"day{uuid.uuid4().hex[:8]}", files.found(f"{seen}/{folder}/*.parquet")
        publish_seen(read_logs(spark, target).where(own), seen, name, [], buckets)
        for file in old:  # what they mark is in the new one
            files.delete(file)
        for batch in names:
            mark_done(spark, seen, [folder], batch)
        caught.append(day)
    return caught


def merge_seen(spark: SparkSession, seen: str, day: str) -> int:
    """One filter in place of those of a day's batches; returns how many files there were.

    It may stop anywhere, as ``compact_day`` may. For days that no stream writes to meanwhile.
    """
    finish_replacements(spark, seen)
    folder = f"{seen}/{DAY}={day}"
    files = Files(spark, seen).found(f"{folder}/*.parquet")
    if len(files) > 1:
        staging = f"{seen}/_staging/compact-{day}"
        _write(read_seen(spark, seen).where(F.col(DAY) == F.lit(day).cast("date")), staging)
        replace(spark, staging, folder, files, f"merged{uuid.uuid4().hex[:8]}")
    return len(files)
