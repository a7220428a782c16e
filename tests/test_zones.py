"""Results that must not depend on the zone of the session, cursors and odd lines."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from timberline.functions.scalars import hour_label, iso_label, short_time
from timberline import plans
from timberline.operators import filters, paging, parsing, search, stats
from timberline.sources import logs as table
from timberline.sources.otlp import flatten_otlp, parse_otlp


@pytest.fixture
def new_york(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    yield spark
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_table_written_in_utc_read_elsewhere(spark, logs, tmp_path):
    path = str(tmp_path / "table")
    table.write_logs(logs, path)
    moment = "2024-01-10T03:00:00Z"
    want = filters.time_range(logs, end=moment).count()
    volume = sorted(map(tuple, stats.hourly_volume(logs, "2024-01-30T12:00:00Z").collect()))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert table.read_logs(spark, path, end=moment).count() == want
        stored = table.read_logs(spark, path)
        assert sorted(map(tuple, stats.hourly_volume(stored, "2024-01-30T12:00:00Z").collect())) == volume
        again = str(tmp_path / "again")
        table.write_logs(stored.drop("day"), again)
        days = spark.read.parquet(again).select("day").distinct().count()
        assert days == spark.read.parquet(path).select("day").distinct().count()
        kept = table.apply_retention(stored, "2024-01-30T01:00:00Z", past=10).kept.count()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert kept == table.apply_retention(logs, "2024-01-30T01:00:00Z", past=10).kept.count()


def test_labels_are_utc(new_york):
    row = new_york.sql("SELECT timestamp_micros(1704110399999999) AS t, CAST(NULL AS timestamp) AS n")
    got = row.select(iso_label(F.col("t")), hour_label(F.col("t")), short_time(F.col("t")), iso_label(F.col("n")))
    assert tuple(got.first()) == ("2024-01-01T11:59:59Z", "2024-01-01T11:00:00Z", "2024-01-01 11:59:59", None)


def test_deep_pages_in_the_repeated_hour(new_york):
    start = 1_730_606_400_000_000  # 2024-11-03 04:00 UTC; an hour repeats at 06:00
    rows = new_york.range(120).select(
        F.timestamp_micros(F.lit(start) + F.col("id") * 120_000_000).alias("timestamp"), F.col("id").alias("log_id")
    )
    for offset in (0, 15, 40, 70, 119):
        pages = [
            [r["log_id"] for r in _bare(rows, offset, deep).collect()] for deep in (0, 10_000)
        ]
        assert pages[0] == pages[1] == [119 - offset - i for i in range(min(5, 120 - offset))]


def _bare(rows, offset, deep):
    full = rows.selectExpr(
        "*", "'a' AS service_name", "'INFO' AS severity_text", "1 AS severity_number", "'b' AS body",
        "'t' AS trace_id", "'s' AS span_id", "'i' AS service_instance_id",
        "map('a', 'b') AS log_attributes", "'n' AS scope_name", "'v' AS scope_version",
    )
    return paging.log_page(full, 5, offset, with_id=True, deep_offset=deep).rows


def test_cursor_over_equal_and_undated_records(logs):
    few = logs.limit(20)
    undated = few.withColumn("timestamp", F.lit(None).cast("timestamp"))
    rows = few.unionByName(few).unionByName(few).unionByName(undated)
    seen, cursor, shown = [], None, 0
    while True:
        page = (
            paging.log_page(rows, 7, 0, with_id=True).rows
            if cursor is None
            else paging.log_page_after(rows, *cursor, 7, shown=shown)
        ).collect()
        if not page:
            break
        seen += [(r["timestamp"], r["log_id"]) for r in page]
        cursor, shown = seen[-1], seen.count(seen[-1])
    assert len(seen) == 80 and len(set(seen)) == 40
    assert [t for t, _ in seen[-20:]] == [None] * 20


def test_lines_of_any_beginning(spark):
    access = '%s - bob [10/Oct/2024:13:55:36 +0000] "GET /a HTTP/1.1" 200 12 "-" "curl%s"%s'
    bodies = [
        access % ("[::1]", "", ""), access % ("2024/x", "", "\r\n"), access % ("1.2.3.4", "\x01x", ""),
        "[Sat Oct 12 10:00:00 2024] [error] [pid 7] bro\x01ken\n", "[::1] nothing",
        "2024/10/12 10:00:00 [warn] 1#2: *3 slow\n", "", None,
    ]
    rows = spark.createDataFrame(list(enumerate(bodies)), "log_id long, body string").selectExpr(
        "log_id", "timestamp '2024-10-12 00:00:00' AS timestamp", "'s' AS service_name", "body"
    )
    result = parsing.parse_logs(rows)
    got = {r["log_id"]: r for r in result.parsed.collect()}
    assert sorted(got) == [0, 1, 2, 3, 5]
    assert [got[i]["agent"] for i in range(3)] == ["curl", "curl", "curl\x01x"]
    assert got[0]["ip"] == "[::1]" and got[0]["log_type"] == "access" and got[0]["status"] == 200
    assert (got[3]["message"], got[5]["message"], got[5]["cid"]) == ("bro\x01ken", "slow", 3)
    assert sorted(r["log_id"] for r in result.rejects.collect()) == [4, 6, 7]
    alone = {r["log_id"]: r["agent"] for r in parsing.parse_access(rows).where("ip is not null").collect()}
    assert alone == {i: got[i]["agent"] for i in range(3)}


def test_values_of_every_kind(spark):
    value = '{"resourceLogs":[{"scopeLogs":[{"logRecords":[{"body":%s,"attributes":[{"key":"k","value":%s}]}]}]}]}'
    kinds = {
        '{"stringValue":"a"}': "a", '{"intValue":"503"}': "503", '{"intValue":503}': "503",
        '{"doubleValue":1.5}': "1.5", '{"boolValue":false}': "false", '{"bytesValue":"AQ=="}': "AQ==",
        '{"arrayValue":{"values":[{"intValue":"1"}]}}': '{"values":[{"intValue":"1"}]}', "{}": None,
    }
    lines = spark.createDataFrame([(value % (k, k),) for k in kinds], "value string")
    rows = flatten_otlp(parse_otlp(lines)).collect()
    assert sorted(str(r["body"]) for r in rows) == sorted(map(str, kinds.values()))
    assert all(r["log_attributes"]["k"] == r["body"] for r in rows)


def test_page_by_index_equals_page_by_scan(spark, logs, tmp_path):
    path = str(tmp_path / "table")
    undated = logs.withColumn("timestamp", F.when(F.col("log_id") % 5 > 0, F.col("timestamp")))
    table.write_logs(undated, path)
    stored = table.read_logs(spark, path)
    index = search.build_term_index(stored)
    for q, mode in (("timed out", "MATCH_PHRASE"), ("error get", "MATCH_ANY"), ("re", "MATCH_PHRASE_PREFIX")):
        want = plans.search_logs(stored, q, q_mode=mode, limit=50)
        got = plans.search_logs(stored, q, q_mode=mode, limit=50, index=index)
        assert got.total.first() == want.total.first()
        assert [r["body"] for r in got.rows.collect()] == [r["body"] for r in want.rows.collect()]
