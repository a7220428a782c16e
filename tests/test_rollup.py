"""Kept counts against counts of the records."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from timberline.operators import rollup, search, stats
from timberline.operators.filters import time_range
from timberline.sources import logs as table
from timberline.streaming import ingest


@pytest.fixture(scope="module")
def kept(spark, logs, tmp_path_factory):
    path, beside = (str(tmp_path_factory.mktemp(n)) for n in ("logs", "beside"))
    timeless = logs.limit(3).withColumn("timestamp", F.lit(None).cast("timestamp"))
    ingest.append_batch(logs.where("log_id % 2 = 0").unionByName(timeless), path, "a", index=beside)
    table.write_logs(logs.where("log_id % 2 = 1"), path)
    search.catch_up(spark, path, beside)
    table.drop_expired(spark, path, date(2024, 1, 8), past=5, index=beside)
    return table.read_logs(spark, path), rollup.read_counts(spark, beside)


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


RANGES = [
    (None, None),
    ("2024-01-05T06:00:00Z", None),
    (None, "2024-01-20T18:30:17.25Z"),
    ("2024-01-05T06:13:21.5Z", "2024-01-20T18:30:00Z"),
    ("2024-01-05T23:59:30Z", "2024-01-06T00:00:30Z"),
    ("2024-01-05T06:00:10Z", "2024-01-05T06:00:40Z"),
    ("2024-01-09T00:00:00Z", "2024-01-08T00:00:00Z"),
]


@pytest.mark.parametrize("start, end", RANGES)
def test_same_counts(kept, start, end):
    logs, counts = kept
    part = time_range(logs, start, end)
    assert rows(rollup.overview(logs, counts, start, end)) == rows(stats.overview(part))
    for width, keys in (("15m", ["severity_text"]), ("1h", ["service_name", "severity_text"])):
        got = rollup.bucket_counts(logs, counts, width, keys, start, end)
        assert rows(got.where("bucket_start IS NOT NULL")) == rows(
            stats.bucket_counts(part, width, keys).where("bucket_start IS NOT NULL")
        )


def test_hourly(kept):
    logs, counts = kept
    for as_of in ("2024-01-30T12:00:00Z", "2024-01-10T07:31:12Z"):
        assert rows(rollup.hourly_volume(logs, counts, as_of)) == rows(stats.hourly_volume(logs, as_of))


def test_records_are_read_for_cut_minutes_only(spark, kept):
    """A whole-minute range leaves nothing of the logs to read, any other a day at each end."""
    logs, counts = kept
    frame = rollup.overview(logs, counts, "2024-01-05T06:13:21Z", "2024-01-20T18:30:11Z")
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    scans = [s for s in plan.split("FileScan")[1:] if "service_name" in s and "minute" not in s.split("PartitionFilters")[0]]
    assert len(scans) >= 2
    for scan in scans:
        filters = scan.split("PartitionFilters: [")[1].split("]")[0]
        assert filters.count("2024-01-05") >= 2 or filters.count("2024-01-20") >= 2
