"""Promoted attributes: what is counted, written, and read."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from timberline.operators import attributes
from timberline.operators.filters import by_attribute
from timberline.sources import logs as table
from timberline.sources.files import batch_names
from timberline.streaming import ingest

BAG, KEY = "log_attributes", "http.status_code"


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def ids(frame):
    return sorted(r[0] for r in frame.select("log_id").collect())


def test_census_and_choice(spark, logs):
    some = logs.withColumn(BAG, F.when(F.col("log_id") % 4 > 0, F.col(BAG)))
    found = {(r.bag, r.key): (r.records, r.share) for r in attributes.attribute_census(some).collect()}
    n = logs.count()
    assert set(found) == {(BAG, "log.type"), (BAG, KEY), *(("resource_attributes", k) for k in ("service.version", "deployment.environment"))}
    assert found["resource_attributes", "service.version"] == (n, 1.0)
    assert found[BAG, KEY][0] == logs.where("log_id % 4 > 0").count()
    census = attributes.attribute_census(some)
    assert attributes.hot_attributes(census, 0.9) == [("resource_attributes", k) for k in ("deployment.environment", "service.version")]
    assert len(attributes.hot_attributes(census, 0.0, most=3)) == 3
    assert attributes.attribute_census(some.limit(0)).collect() == []


@pytest.fixture(scope="module")
def mixed(spark, logs, tmp_path_factory):
    """Files from before, under one set of keys, under another, and appended by a plain write."""
    path = str(tmp_path_factory.mktemp("logs"))
    part = lambda n: logs.where(F.col("log_id") % 4 == n)
    ingest.append_batch(part(0), path, "zero")
    attributes.promote(spark, path, [(BAG, KEY)])
    ingest.append_batch(part(1), path, "one")
    attributes.promote(spark, path, [(BAG, "log.type"), (BAG, KEY), ("resource_attributes", "a.b")])
    ingest.append_batch(part(2), path, "two")
    table.write_logs(part(3), path)
    return path


@pytest.mark.parametrize("key, value", [(KEY, "503"), ("log.type", "error"), ("a.b", "x"), ("nothing", "x")])
def test_same_rows_as_the_bag(spark, logs, mixed, key, value):
    found = attributes.logs_by_attribute(spark, mixed, BAG, key, value)
    assert ids(found) == ids(by_attribute(logs, BAG, key, value))
    assert found.columns == table.read_logs(spark, mixed).columns
    span = ("2024-01-05T00:00:00Z", "2024-01-09T00:00:00Z")
    part = attributes.logs_by_attribute(spark, mixed, BAG, key, value, *span)
    assert ids(part) == ids(by_attribute(table.read_logs(spark, mixed, *span), BAG, key, value))


def test_column_is_pushed_and_bag_left_out(spark, mixed):
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    found = attributes.logs_by_attribute(spark, mixed, BAG, KEY, "503").select("log_id")
    scans = [s for s in plan_of(found).split("FileScan")[1:]]
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    (by_column,) = [s for s in scans if f"EqualTo({attributes._column(BAG, KEY)},503)" in s]
    (by_bag,) = [s for s in scans if s is not by_column]
    assert f"{BAG}:map" not in by_column.split("ReadSchema")[1]
    assert f"{BAG}:map" in by_bag.split("ReadSchema")[1]
    files = spark.read.parquet(mixed).select("_metadata.file_name").distinct().collect()
    assert sum("attr_" in r[0] for r in files) > 0


def test_repeated_batch_replaces_itself_under_another_set(spark, logs, tmp_path):
    path = str(tmp_path)
    ingest.append_batch(logs, path, "b")
    attributes.promote(spark, path, [(BAG, KEY)])
    ingest.append_batch(logs, path, "b")
    assert ids(table.read_logs(spark, path)) == ids(logs)
    assert set.union(*batch_names(spark, path).values()) == {"b"}
    ingest.append_batch(logs.limit(0), path, "c")
    with pytest.raises(ValueError):
        attributes.promote(spark, path, [("body", "x")])
