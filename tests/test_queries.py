"""Every registered query, against its check SQL where it has one."""

from __future__ import annotations

import os

import pytest
from oracle import compare, connect

from timberline.registry import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, QUERIES[name], ORACLES[name], SF_DIR) is None


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.queries().keys() >= entry.oracle_sql().keys()
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["stream_volume_late", "compact_read"])
def test_source_of_a_stream_is_written_by_many_tasks(spark, tmp_path, monkeypatch, name):
    """No task gets all records of a batch, so what one reads does not grow with the table."""
    from timberline.registry import ingest

    spark.read.parquet(f"{SF_DIR}/events.parquet").repartition(6).write.parquet(f"{tmp_path}/events.parquet")
    made = iter(range(100))
    monkeypatch.setattr(ingest, "scratch_path", lambda _, n: f"{tmp_path}/{n}-{next(made)}")
    assert QUERIES[name](spark, str(tmp_path)).count()
    files = spark.read.parquet(f"{tmp_path}/stream-source-*").groupBy("_metadata.file_name").count().collect()
    assert len(files) >= 12 and max(f["count"] for f in files) < sum(f["count"] for f in files) / 5


def test_replays_are_dealt_to_many_tasks_and_few_files(spark, tmp_path, monkeypatch):
    """The source from a file with one row group has many files; the table has one a day, as without state."""
    from timberline.registry import ingest

    monkeypatch.setattr(ingest, "scratch_path", lambda _, n: f"{tmp_path}/{n}")
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")
    try:
        table = QUERIES["stream_dedupe"](spark, SF_DIR)
    finally:
        spark.conf.set(coalesce, before)
    sent = spark.read.parquet(f"{tmp_path}/stream-source").groupBy("_metadata.file_name").count().collect()
    assert len(sent) >= 5 and max(f["count"] for f in sent) < sum(f["count"] for f in sent) / 3
    assert sum(f["count"] for f in sent) == 2 * table.count()
    days = [*(tmp_path / "out").glob("day=*")]
    assert len([*(tmp_path / "out").glob("day=*/*.parquet")]) == len(days) > 20
