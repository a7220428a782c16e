from __future__ import annotations

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from timberline.schema import LOG_COLUMNS
from timberline.sources import logs as table
from timberline.sources.otlp import (
    broken_documents,
    flatten_otlp,
    parse_otlp,
    read_otlp,
    to_otlp,
)
from timberline.sources.scratch import drop_scratch, materialize, shared_folder
from timberline.streaming.ingest import dedupe_stream, stream_logs, within_retention, write_stream
from timberline.streaming.live import stream_assign, stream_match


def pair(key, value):
    return {"key": key, "value": {"stringValue": value}}


DOCUMENTS = [
    {
        "resourceLogs": [
            {
                "resource": {"attributes": [pair("service.name", "a"), pair("service.instance.id", "a-1")]},
                "scopeLogs": [
                    {
                        "scope": {"name": "s", "version": "2"},
                        "logRecords": [
                            {
                                "timeUnixNano": "1700000000123456789",
                                "severityNumber": 9,
                                "severityText": "INFO",
                                "body": {"stringValue": "hello"},
                                "attributes": [pair("k", "1"), pair("k", "2"), pair("x.y", "z")],
                            },
                            {"timeUnixNano": "0", "observedTimeUnixNano": "1700000001000000000", "body": {}},
                        ],
                    },
                    {"scope": {}, "logRecords": []},
                ],
            },
            {"resource": {}, "scopeLogs": [{"logRecords": [{"body": {"stringValue": "bare"}}]}]},
            {"scopeLogs": []},
        ]
    },
    {"resourceLogs": []},
]


def test_flatten_corner_cases(spark, tmp_path):
    lines = [json.dumps(d) for d in DOCUMENTS] + ["{not json"]
    (tmp_path / "in.json").write_text("\n".join(lines))
    documents = read_otlp(spark, str(tmp_path / "in.json"))
    rows = {r["body"]: r for r in flatten_otlp(documents).collect()}
    assert set(rows) == {"hello", None, "bare"}
    hello = rows["hello"]
    assert hello["service_name"] == "a" and hello["service_instance_id"] == "a-1"
    assert hello["log_attributes"] == {"k": "2", "x.y": "z"}
    assert (hello["scope_name"], hello["scope_version"]) == ("s", "2")
    assert str(hello["timestamp"]).endswith(".123456")
    assert rows[None]["timestamp"] is not None and rows[None]["log_attributes"] == {}
    assert rows["bare"]["service_name"] is None and rows["bare"]["timestamp"] is None
    assert [r[0] for r in broken_documents(documents.cache()).collect()] == ["{not json"]

    text = spark.createDataFrame([(x,) for x in lines], "value string")
    assert flatten_otlp(parse_otlp(text)).count() == 3
    assert broken_documents(parse_otlp(text)).count() == 1


def test_round_trip(spark, logs, tmp_path):
    to_otlp(logs, batch=50).write.json(str(tmp_path / "docs"))
    back = flatten_otlp(read_otlp(spark, str(tmp_path / "docs")))
    assert back.columns == LOG_COLUMNS
    same = ["timestamp", "service_name", "trace_id", "severity_number", "body", "scope_name"]
    assert back.select(same).exceptAll(logs.select(same)).count() == 0
    assert back.count() == logs.count()


def test_no_document_holds_a_busy_service(spark, logs):
    busy = logs.withColumn("service_name", F.lit("busy")).withColumn("service_instance_id", F.lit("1"))
    sizes = to_otlp(busy, batch=20).select(
        F.expr("size(resourceLogs[0].scopeLogs[0].logRecords)").alias("n")
    )
    assert sizes.agg(F.max("n")).first()[0] <= 60


def test_table_prunes_days_and_columns(spark, logs, tmp_path):
    path = str(tmp_path / "logs")
    table.write_logs(logs, path)
    table.write_logs(logs, path, rebalance=False)
    assert table.read_logs(spark, path).count() == 2 * logs.count()
    some = table.read_logs(spark, path, "2024-01-03T05:00:00Z", "2024-01-04T05:00:00Z")
    text = some.groupBy("service_name").count()._jdf.queryExecution().executedPlan().toString()
    days = text.split("PartitionFilters: [")[1].split("]")[0]
    assert ">= 2024-01-03" in days and "<= 2024-01-04" in days
    assert "GreaterThanOrEqual(timestamp" in text and "body" not in text.split("ReadSchema:")[1]
    errors = table.read_logs(spark, path).where("severity_text = 'ERROR'")
    assert "EqualTo(severity_text,ERROR)" in errors._jdf.queryExecution().executedPlan().toString()
    whole = logs.where("timestamp >= '2024-01-03 05:00:00' and timestamp <= '2024-01-04 05:00:00'")
    assert some.count() == 2 * whole.count()


def test_retention(spark, logs, tmp_path):
    undated = logs.withColumn("timestamp", F.when(F.col("log_id") > 2, F.col("timestamp")))
    parts = table.apply_retention(undated, "2024-01-20T08:00:00Z", past=5, future=3)
    assert parts.kept.count() + parts.rejected.count() == logs.count()
    assert parts.rejected.where("timestamp is null").count() == 3
    days = parts.kept.select(F.to_date("timestamp").alias("d")).agg(F.min("d"), F.max("d")).first()
    assert tuple(days) == (date(2024, 1, 15), date(2024, 1, 23))

    path = str(tmp_path / "logs")
    table.write_logs(logs, path)
    (tmp_path / "logs" / "day=notes").mkdir()
    before = table.expired_days(spark, path, date(2024, 1, 20), past=5)
    assert len(before) == 14
    assert table.drop_expired(spark, path, date(2024, 1, 20), past=5) == before
    assert table.expired_days(spark, path, date(2024, 1, 20), past=5) == []
    assert (tmp_path / "logs" / "day=notes").exists()


def test_preview_has_no_record_twice(logs):
    shown = table.sample_preview(logs, first=100, every=2)
    assert shown.count() == shown.select("log_id").distinct().count()
    assert shown.count() > 100


def test_scratch_lives_in_the_shared_folder(spark):
    kept = materialize(spark.range(3).toDF("n"), "probe")
    assert kept.count() == 3
    assert shared_folder(spark) in kept.inputFiles()[0]
    assert spark.conf.get("spark.checkpoint.dir") == shared_folder(spark)


def test_stream_equals_batch(spark, logs, tmp_path):
    source, target, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    to_otlp(logs, batch=100).repartition(6).write.json(source)
    stream_logs(spark, source, target, check, max_files=2, available_now=True).awaitTermination()
    batch = flatten_otlp(read_otlp(spark, source))
    same = [c for c in LOG_COLUMNS if not c.endswith("attributes")]
    loaded = table.read_logs(spark, target)
    assert loaded.select(same).exceptAll(batch.select(same)).count() == 0
    assert loaded.count() == batch.count() == logs.count()

    to_otlp(logs.limit(10), batch=100).write.mode("append").json(source)
    stream_logs(spark, source, target, check, available_now=True).awaitTermination()
    assert table.read_logs(spark, target).count() == logs.count() + 10


def test_replayed_records_are_dropped_and_old_days_refused(spark, logs, tmp_path):
    source, target, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for _ in range(2):
        logs.write.mode("append").parquet(source)
    stream = spark.readStream.schema(logs.schema).parquet(source)
    once = dedupe_stream(within_retention(stream, "2024-01-20T00:00:00Z", 5, 3), "40 days")
    write_stream(once, target, check, available_now=True).awaitTermination()
    want = table.apply_retention(logs, "2024-01-20T00:00:00Z", 5, 3).kept.count()
    assert table.read_logs(spark, target).count() == want


def test_live_patterns(spark, logs, tmp_path):
    from timberline.operators.patterns import assign_patterns, match_patterns, mine_patterns

    model = mine_patterns(logs)
    source = str(tmp_path / "in")
    logs.write.parquet(source)
    pick = ["log_id", "pattern_id"]

    stream = spark.readStream.schema(logs.schema).parquet(source)
    target, check = str(tmp_path / "out"), str(tmp_path / "check")
    stream_match(stream, model.patterns, target, check, available_now=True).awaitTermination()
    want = sorted(match_patterns(logs, model.patterns).select(pick).collect())
    assert sorted(spark.read.parquet(target).select(pick).collect()) == want

    target, check = str(tmp_path / "out2"), str(tmp_path / "check2")
    query = (
        stream_assign(stream, model).select(pick).writeStream.format("parquet")
        .option("path", target).option("checkpointLocation", check)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    want = sorted(assign_patterns(logs, model).select(pick).collect())
    assert sorted(spark.read.parquet(target).select(pick).collect()) == want


def test_scratch_can_be_dropped(spark):
    kept = materialize(spark.range(3).toDF("n"), "gone")
    drop_scratch(spark)
    with pytest.raises(Exception):
        spark.read.parquet(kept.inputFiles()[0]).count()


def test_future_and_late_records_survive_the_replay_filter(spark, logs, tmp_path):
    source, target, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    future = logs.limit(1).withColumn("timestamp", F.current_timestamp() + F.expr("INTERVAL 7 DAYS"))
    batches = [future.unionByName(logs.where("log_id < 50")), logs.where("log_id < 80")]
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(logs.schema).parquet(source)
        write_stream(dedupe_stream(stream), target, check, available_now=True).awaitTermination()
    assert table.read_logs(spark, target).count() == 1 + logs.where("log_id < 80").count()


def test_repeated_batch_replaces_itself_and_days_compact(spark, logs, tmp_path):
    from timberline.streaming.ingest import append_batch, compact_day

    path = str(tmp_path / "table")
    for _ in range(2):
        append_batch(logs, path, "s1-0")
    append_batch(logs, path, "s1-1")
    table.write_logs(logs, path)
    assert table.read_logs(spark, path).count() == 3 * logs.count()
    assert compact_day(spark, path, "2024-01-10") > 1 and compact_day(spark, path, "2024-01-10") >= 1
    assert table.read_logs(spark, path).count() == 3 * logs.count()
    assert not list((tmp_path / "table" / "_staging").glob("*"))
