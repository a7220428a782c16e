"""Continuous load of export documents into the log table."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from timberline.operators.attributes import with_promoted
from timberline.operators.search import publish_postings
from timberline.schema import DAY
from timberline.sources.files import (
    Files,
    batch_names,
    done_names,
    finish_replacements,
    mark_done,
    publish,
    replace,
    same_path,
)
from timberline.sources.logs import (
    ACCEPT_FUTURE_DAYS,
    KEEP_PAST_DAYS,
    apply_retention,
    read_logs,
    retention_test,
    write_logs,
)
from timberline.sources.otlp import READ_SCHEMA, broken_documents, flatten_otlp
from timberline.streaming.replays import publish_seen, without_replays

#: Flush interval of the load. Fixed value.
FLUSH_INTERVAL = "5 seconds"
#: Files one micro-batch takes at most, so that the first one after a stop is not the backlog.
MAX_FILES = 1000
_ADAPTIVE = "spark.sql.adaptive.enabled"


def read_documents(
    spark: SparkSession, source: str, max_files: int | None = MAX_FILES
) -> DataFrame:
    """Export documents from a folder they are dropped into; broken ones keep their text."""
    reader = spark.readStream.schema(READ_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(source)


def read_stream(
    spark: SparkSession, source: str, max_files: int | None = MAX_FILES
) -> DataFrame:
    """Log rows from a folder that export documents are dropped into."""
    return flatten_otlp(read_documents(spark, source, max_files))


def within_retention(
    stream: DataFrame,
    as_of: str | Column | None = None,
    past: int = KEEP_PAST_DAYS,
    future: int = ACCEPT_FUTURE_DAYS,
) -> DataFrame:
    """Rows whose day the table accepts, judged at the time of each batch. Stateless, so
    any late row of an accepted day is still taken."""
    return stream.where(
        retention_test(F.current_timestamp() if as_of is None else as_of, past, future)
    )


def dedupe_stream(stream: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Drops records that arrive again within ``lateness`` of their first arrival.

    The watermark follows the time of arrival, not the records' own time, so late and
    future-dated records are all kept and none can push others out. State is one key per
    record and kept for that long, spread by the hash of the key; on disk where the session has
    the RocksDB state store.
    """
    arrived = "arrived_at"
    while arrived in stream.columns:
        arrived += "_"
    return (
        stream.withColumn(arrived, F.current_timestamp())
        .withWatermark(arrived, lateness)
        .dropDuplicatesWithinWatermark(["timestamp", "log_id"])
        .drop(arrived)
    )


def append_batch(
    batch: DataFrame,
    target: str,
    name: str,
    compression: str = "lz4_raw",
    index: str | None = None,
    seen: str | None = None,
) -> None:
    """Append one batch to the table as ``write_logs`` does; under the same name it replaces itself.

    Files are staged beside the table and then moved into their days, so readers and batch
    appends see one plain table without a commit log. With an ``index`` folder the batch's postings are
    published there under the same name, from the staged rows and before them: a record that can be
    read can be found, and a batch that stops half-way replaces both when it runs again. Attributes that
    are promoted for the table are written as columns, too. With a ``seen`` folder records the table already
    has are left out, however old they are; see :mod:`timberline.streaming.replays`.
    """
    spark = batch.sparkSession
    if seen is not None:
        batch = without_replays(batch, target, seen, name)
    staging = f"{target}/_staging/{name}"
    batch, tag = with_promoted(batch, target)
    write_logs(batch, staging, compression, mode="overwrite")
    if index is not None or seen is not None:
        rows = read_logs(spark, staging)
        folders = {f.split("/")[-2] for f in Files(spark, staging).found(f"{staging}/{DAY}=*/*.parquet")}
        if seen is not None:
            publish_seen(rows, seen, name, folders)
        if index is not None:
            publish_postings(rows, index, name, folders)
    publish(spark, staging, target, name, tag)


def _start(
    stream: DataFrame, load, checkpoint: str, trigger: str, available_now: bool
) -> StreamingQuery:
    adaptive = stream.sparkSession.conf.get(_ADAPTIVE)

    def run(batch: DataFrame, batch_id: int) -> None:
        # off in the session of a stream with state, whose plan is fixed by now; without it a batch is written
        # by as many tasks as there are partitions of state, each with a file for every day
        conf = batch.sparkSession.conf
        before = conf.get(_ADAPTIVE)
        conf.set(_ADAPTIVE, adaptive)
        try:
            load(batch, batch_id)
        finally:
            conf.set(_ADAPTIVE, before)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=trigger).start()


def batch_name(checkpoint: str, batch_id: int) -> str:
    """Name of a batch: the same when it runs again, another for every other stream."""
    return f"s{hashlib.md5(same_path(checkpoint).encode()).hexdigest()[:12]}-{batch_id}"


def write_stream(
    stream: DataFrame,
    target: str,
    checkpoint: str,
    trigger: str = FLUSH_INTERVAL,
    available_now: bool = False,
    compression: str = "lz4_raw",
    index: str | None = None,
    seen: str | None = None,
) -> StreamingQuery:
    """Append a stream of log rows to the day-partitioned table, exactly once.

    Batches have the layout of ``write_logs`` and mix with its appends; expired days can be
    dropped meanwhile. With an ``index`` folder the term index follows, with a ``seen`` folder replays are
    left out; see :func:`append_batch`.
    """

    def load(batch: DataFrame, batch_id: int) -> None:
        append_batch(batch, target, batch_name(checkpoint, batch_id), compression, index, seen)

    return _start(stream, load, checkpoint, trigger, available_now)


def stream_logs(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    trigger: str = FLUSH_INTERVAL,
    max_files: int | None = MAX_FILES,
    available_now: bool = False,
    quarantine: str | None = None,
    as_of: str | Column | None = None,
    past: int = KEEP_PAST_DAYS,
    future: int = ACCEPT_FUTURE_DAYS,
    index: str | None = None,
    seen: str | None = None,
) -> StreamingQuery:
    """Documents in, table rows out, in micro-batches.

    With a ``quarantine`` folder the table's retention is applied as of each batch (or of
    ``as_of``): rows without a place in the table go to ``quarantine/rows`` and text that is no
    document to ``quarantine/documents``, each with its batch. Without one every record is kept.
    """

    def load(batch: DataFrame, batch_id: int) -> None:
        name = batch_name(checkpoint, batch_id)
        documents = batch.persist()
        try:
            rows = flatten_otlp(documents)
            if quarantine is not None:
                parts = apply_retention(
                    rows, F.current_timestamp() if as_of is None else as_of, past, future
                )
                rows = parts.kept
                for kind, bad in (("rows", parts.rejected), ("documents", broken_documents(documents))):
                    bad.write.mode("overwrite").parquet(f"{quarantine}/{kind}/batch={name}")
            append_batch(rows, target, name, index=index, seen=seen)
        finally:
            documents.unpersist()

    return _start(read_documents(spark, source, max_files), load, checkpoint, trigger, available_now)


def compact_day(spark: SparkSession, path: str, day: str, index: str | None = None) -> int:
    """Rewrite a day of the table into few sorted files; returns how many files it had.

    For days that streams no longer write to, the table being read by nobody meanwhile. It may stop
    anywhere: the list of files that come and go is written before the first one moves, and the
    next call for any day finishes or discards what was left. With its ``index`` folder, the index
    counts as complete for the new files if it was so for the old ones.
    """
    finish_replacements(spark, path)
    folder = f"{DAY}={day}"
    files = Files(spark, path).found(f"{path}/{folder}/*.parquet")
    if len(files) < 2:
        return len(files)
    names = batch_names(spark, path)[folder]
    rows = read_logs(spark, path).where(F.col(DAY) == F.lit(day).cast("date")).drop(DAY)
    name = f"compact{uuid.uuid4().hex[:8]}"
    staging = f"{path}/_staging/compact-{day}"
    rows, tag = with_promoted(rows, path)
    write_logs(rows, staging, mode="overwrite")
    if index is not None and names <= done_names(spark, f"{index}/postings").get(folder, set()):
        mark_done(spark, f"{index}/postings", [folder], name)
    replace(spark, staging, f"{path}/{folder}", files, name, tag)
    return len(files)
