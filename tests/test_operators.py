from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from timberline import plans
from timberline.functions.scalars import level_severity, parse_ts, status_severity
from timberline.operators import filters, paging, parsing, stats
from timberline.operators import patterns as P


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_parse_ts(spark):
    texts = ["2024-01-02T03:04:05Z", "2024-01-02 03:04:05", "2024-01-02T05:04:05+02:00"]
    row = spark.range(1).select(*[parse_ts(t) for t in texts], parse_ts(datetime(2024, 1, 2, 3, 4, 5))).first()
    assert len(set(row)) == 1


def test_time_range_is_inclusive_and_open_ended(logs):
    edge = logs.agg(F.min("timestamp").cast("string"), F.max("timestamp").cast("string")).first()
    assert filters.time_range(logs, edge[0], edge[1]).count() == logs.count()
    assert filters.time_range(logs, edge[1]).count() == 1
    assert filters.time_range(logs, end=edge[0]).count() == 1
    assert filters.filter_logs(logs).count() == logs.count()


def test_pages_do_not_overlap_and_cursor_equals_offset(logs):
    first = paging.log_page(logs, 30, 0, with_id=True).rows.collect()
    second = paging.log_page(logs, 30, 30, with_id=True).rows.collect()
    after = paging.log_page_after(logs, first[-1]["timestamp"], first[-1]["log_id"], 30).collect()
    assert second == after
    assert not {r["log_id"] for r in first} & {r["log_id"] for r in second}
    for bad in (dict(limit=2001), dict(limit=-1), dict(offset=-1)):
        with pytest.raises(ValueError):
            paging.log_page(logs, **bad)


def test_deep_offset_equals_plain_offset(spark, logs):
    undated = logs.withColumn("timestamp", F.when(F.col("log_id") % 10 > 0, F.col("timestamp")))
    dense = undated.withColumn("timestamp", F.date_trunc("minute", "timestamp"))
    for rows in (undated, dense, dense.withColumn("day", F.to_date("timestamp"))):
        whole = rows.orderBy(*paging.newest_first()).select("log_id").collect()
        for offset in (1, 333, 850, 899, 940, 999, 1000, 5000):
            page = paging.log_page(rows, 7, offset, with_id=True, deep_offset=0).rows
            got = [r["log_id"] for r in page.collect()]
            assert sorted(got) == sorted(r["log_id"] for r in whole[offset : offset + 7]), offset


def test_ties_are_broken_by_id(logs):
    tied = logs.withColumn("timestamp", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    ids = [r["log_id"] for r in paging.log_page(tied, 5, 5, with_id=True).rows.collect()]
    assert ids == [994, 993, 992, 991, 990]


def test_newest_page_is_a_top_k(logs):
    assert "TakeOrderedAndProject" in plan_of(paging.log_page(logs, 10).rows)


def test_samples_are_limited_before_the_shuffle(logs):
    named = logs.withColumn("pattern_id", F.col("severity_text"))
    text = plan_of(P.pattern_samples(named, 5))
    assert text.count("WindowGroupLimit") == 2


def test_assigning_does_not_shuffle(spark, logs):
    model = P.mine_patterns(logs)
    text = plan_of(P.assign_patterns(logs, model))
    assert text.count("BroadcastHashJoin") == 2
    assert "hashpartitioning" not in text and "SortMergeJoin" not in text


def test_assigning_works_without_broadcast(spark, logs):
    model = P.mine_patterns(logs)
    want = sorted(P.assign_patterns(logs, model).select("log_id", "pattern_id").collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        frame = P.assign_patterns(logs, model).select("log_id", "pattern_id")
        assert "SortMergeJoin" in plan_of(frame)
        assert sorted(frame.collect()) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_index_search_opens_only_the_days_of_its_hits(spark, logs, tmp_path):
    from timberline.operators import search
    from timberline.sources import logs as table

    table.write_logs(logs, str(tmp_path / "logs"))
    stored = table.read_logs(spark, str(tmp_path / "logs"))
    index = search.build_term_index(stored)
    search.write_term_index(index, str(tmp_path / "index"))
    index = search.read_term_index(spark, str(tmp_path / "index"), index.schema)
    one = stored.where("log_id = 777").select("body", "day").first()
    found = search.search_index(index, stored, one["body"], "MATCH_PHRASE")
    assert [r["body"] for r in found.select("body").collect()] == [one["body"]]
    days = plan_of(found).split("PartitionFilters: [")[1].split("]")[0]
    assert str(one["day"]) in days
    assert search.search_index(index, stored, "nosuchterm", "MATCH_ALL").count() == 0


def test_overview_scans_once(logs):
    text = plan_of(stats.overview(logs))
    assert text.count("FileScan") == 1


def test_warning_counts_where_warn_has_none(spark):
    rows = spark.createDataFrame([("WARNING",), ("ERROR",), (None,)], "severity_text string")
    assert tuple(stats.severity_cards(rows).first()) == (3, 1, 1, 0)
    rows = rows.union(spark.createDataFrame([("WARN",)], "severity_text string"))
    assert tuple(stats.severity_cards(rows).first()) == (4, 1, 1, 0)


def test_unknown_width_means_an_hour(logs):
    assert stats.bucket_counts(logs, "7m").exceptAll(stats.bucket_counts(logs, "1h")).count() == 0


def test_filled_series_without_keys(logs):
    series = stats.bucket_counts(logs, "1h")
    full = stats.fill_buckets(series, "2024-01-02T00:10:00Z", "2024-01-03T23:59:59Z", "1h")
    assert full.count() == 48
    inside = logs.where("timestamp >= '2024-01-02' and timestamp < '2024-01-04'").count()
    assert full.agg(F.sum("count")).first()[0] == inside


def test_severities(spark):
    rows = spark.createDataFrame([("CRIT", 404), ("nothing", 302), (None, None), ("debug", 599)], "l string, s int")
    got = [
        (r[0]["number"], r[0]["text"], r[1]["number"])
        for r in rows.select(level_severity(F.col("l")), status_severity(F.col("s"))).collect()
    ]
    assert got == [(21, "ERROR", 13), (9, "INFO", 9), (9, "INFO", 9), (5, "DEBUG", 17)]


LINES = [
    ('203.0.113.9 - bob [04/Jun/2026:12:00:00 +0200] "GET /a?b HTTP/1.1" 404 - "-" "x y"', "2026-06-04 12:00:00"),
    ("[Thu Jun 04 12:00:02.123 UTC] [crit] [pid 4521] denied: a [b]", "2026-06-04 12:00:00"),
    ("[Wed Dec 31 23:59:59.5 UTC] [error] [pid 1] late", "2026-01-01 00:10:00"),
    ("[Thu Jan 01 00:00:01.000 UTC] [error] [pid 1] early", "2025-12-31 23:50:00"),
    ("2026/06/04 12:00:03 [warn] 12#5: *98 timed out (110: x)", "2026-06-04 12:00:00"),
    ("plain text", "2026-06-04 12:00:00"),
    ("with \u0001 separator", "2026-06-04 12:00:00"),
    ("[2026-06-04 12:00:00] [error] [pid 1] no weekday", "2026-06-04 12:00:00"),
    ("", "2026-06-04 12:00:00"),
    (None, "2026-06-04 12:00:00"),
]


def test_parsing_and_quarantine(spark):
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(LINES)], "log_id int, body string, t string")
    rows = rows.select(
        F.col("log_id").cast("long"), F.col("t").cast("timestamp").alias("timestamp"),
        F.lit("s").alias("service_name"), "body",
    )
    parts = parsing.parse_logs(rows)
    parsed = {r["log_id"]: r for r in parts.parsed.withColumn("event_time", F.col("event_time").cast("string")).collect()}
    assert sorted(parsed) == [0, 1, 2, 3, 4]
    assert parsed[0]["event_time"] == "2026-06-04 10:00:00"
    assert (parsed[0]["user"], parsed[0]["status"], parsed[0]["size"], parsed[0]["severity_number"]) == ("bob", 404, None, 13)
    assert parsed[1]["severity_number"] == 21 and parsed[1]["message"] == "denied: a [b]"
    assert parsed[2]["event_time"] == "2025-12-31 23:59:59.5"
    assert parsed[3]["event_time"] == "2026-01-01 00:00:01"
    assert (parsed[4]["tid"], parsed[4]["cid"], parsed[4]["error_type"]) == (5, 98, "nginx_error")
    reasons = {r["log_id"]: r["reason"] for r in parts.rejects.collect()}
    assert reasons == {5: "no known format", 6: "no known format", 7: "no known format", 8: "empty", 9: "empty"}
    assert "Exchange" not in plan_of(parts.parsed)


def test_whole_questions(spark, logs):
    page = plans.search_logs(logs, q="timed out", q_mode="MATCH_PHRASE", severity="error", limit=5)
    assert page.rows.count() == 5 and page.total.first()[0] >= 5
    assert "resource_attributes" not in page.rows.columns
    report = plans.overview_report(logs, as_of="2024-01-30T12:00:00Z")
    assert report.total.first()[0] == logs.count()
    assert report.by_service.agg(F.sum("count")).first()[0] == logs.count()
    assert report.hourly.count() <= 49
    assert plans.service_names(logs).count() == 4

    mined = plans.pattern_report(logs, severity="error", min_count=3, limit=5)
    assert mined.patterns.count() <= 5 and len(mined.active_masks) == 7
    seen = mined.analysed.first()
    assert seen["logs_analysed"] > seen["bodies_analysed"] > 0
    top = mined.patterns.first()
    series = plans.pattern_timeseries(mined, "no such", top["pattern_id"])
    assert series.agg(F.sum("count")).first()[0] == top["count"]
    assert series.first()["bucket"] == "1h"
    samples = plans.pattern_sample_report(mined, 3, top["pattern_id"]).collect()
    assert len(samples) == 3 and samples[0]["total_matched"] == top["count"]
