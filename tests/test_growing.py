"""Mining that goes on, replays of any age, late counts and deep pages from kept counts."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from timberline.operators import growing, paging, rollup
from timberline.operators import patterns as P
from timberline.sources import logs as table
from timberline.sources.files import Files
from timberline.streaming import ingest, live, replays


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


# --- mining -----------------------------------------------------------------------------


def test_days_one_by_one_equal_one_run(spark, logs, tmp_path):
    path = str(tmp_path / "book")
    undated = logs.withColumn("timestamp", F.when(F.col("log_id") % 50 > 0, F.col("timestamp")))
    empty = growing.mine_lines(spark, path)
    assert empty.patterns.count() == 0
    for part in range(4):
        growing.add_lines(undated.where(F.col("log_id") % 4 == part), path, f"b{part}")
    growing.add_lines(undated.where("log_id % 4 = 2"), path, "b2")
    grown, whole = growing.mine_lines(spark, path), P.mine_patterns(undated)
    for name in ("profiles", "entries", "patterns"):
        assert rows(getattr(grown, name)) == rows(getattr(whole, name))


def test_choice_of_masks_has_its_own_lines(spark, logs, tmp_path):
    path = str(tmp_path / "book")
    growing.add_lines(logs, path, "all", ["ipv4"])
    assert growing.read_lines(spark, path).isEmpty()
    assert not growing.read_lines(spark, path, ["ipv4"]).isEmpty()


def test_succession(spark, tmp_path):
    def batch(texts):
        made = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "log_id long, body string")
        return made.withColumn("timestamp", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("log_id")))

    first = [f"open door {w} now" for w in ("red", "blue")] + ["stop"] * 3
    more = [f"open gate {w} now" for w in ("green", "grey", "white")] * 2
    path = str(tmp_path / "book")
    growing.add_lines(batch(first), path, "one")
    old = growing.mine_lines(spark, path)
    kept = [tuple(r) for r in growing.read_lines(spark, path).select("masked", "count").collect()]
    lines = spark.createDataFrame(kept, "masked string, count long")
    growing.add_lines(batch(more), path, "two")
    new = growing.mine_lines(spark, path)

    def owner(model):
        logs = batch([m for m, _ in kept])
        return {r["body"]: r["pattern_id"] for r in P.assign_patterns(logs, model).collect()}

    before, after = owner(old), owner(new)
    want = Counter()
    for masked, n in kept:
        want[before[masked], after[masked]] += n
    got = growing.succession(old, new, lines).collect()
    assert {(r["old_id"], r["pattern_id"]): r["count"] for r in got} == dict(want)
    for old_id in {o for o, _ in want}:
        main = [r["pattern_id"] for r in got if r["old_id"] == old_id and r["main"]]
        top = max(n for (o, _), n in want.items() if o == old_id)
        assert main == [min(p for (o, p), n in want.items() if o == old_id and n == top)]
    strange = growing.succession(old, new, batch(["never seen before"]).select(F.col("body").alias("masked"), F.lit(2).alias("count")))
    assert [tuple(r) for r in strange.collect()] == [(None, None, 2, False)]


# --- replays ----------------------------------------------------------------------------


def ids(spark, target):
    return sorted(r[0] for r in table.read_logs(spark, target).select("log_id").collect())


@pytest.mark.parametrize("buckets", [1, 64])
def test_replays_of_any_age(spark, logs, tmp_path, buckets, monkeypatch):
    monkeypatch.setattr(replays.publish_seen, "__defaults__", (buckets,))
    target, seen = str(tmp_path / "logs"), str(tmp_path / "seen")
    timeless = logs.where("log_id < 5").withColumn("timestamp", F.lit(None).cast("timestamp"))
    some = logs.where("log_id < 600").unionByName(timeless)
    ingest.append_batch(some.unionByName(some), target, "a-1", seen=seen)
    assert ids(spark, target) == sorted([*range(600), *range(5)])
    ingest.append_batch(logs.where("log_id >= 400").unionByName(timeless), target, "a-10", seen=seen)
    assert ids(spark, target) == sorted([*range(1000), *range(5)])
    ingest.append_batch(some, target, "a-1", seen=seen)  # the same batch again replaces itself
    assert ids(spark, target) == sorted([*range(1000), *range(5)])


def test_a_batch_that_stopped_before_its_rows(spark, logs, tmp_path, monkeypatch):
    target, seen = str(tmp_path / "logs"), str(tmp_path / "seen")

    def stop(*_):
        raise InterruptedError

    with monkeypatch.context() as broken:
        broken.setattr(ingest, "publish", stop)
        with pytest.raises(InterruptedError):
            ingest.append_batch(logs, target, "a", seen=seen)
    ingest.append_batch(logs, target, "a", seen=seen)
    assert ids(spark, target) == list(range(1000))


def test_filters_merge_and_follow_plain_appends(spark, logs, tmp_path):
    target, seen = str(tmp_path / "logs"), str(tmp_path / "seen")
    ingest.append_batch(logs.where("log_id % 3 = 0"), target, "a", seen=seen)
    ingest.append_batch(logs.where("log_id % 3 = 1"), target, "b", seen=seen)
    day = "2024-01-10"
    before = rows(replays.read_seen(spark, seen))
    assert replays.merge_seen(spark, seen, day) > 1
    assert rows(replays.read_seen(spark, seen)) == before
    assert replays.catch_up(spark, target, seen) == []
    table.write_logs(logs.where("log_id % 3 = 2"), target)
    assert day in replays.catch_up(spark, target, seen)
    ingest.append_batch(logs, target, "c", seen=seen)
    assert ids(spark, target) == list(range(1000))


def test_only_doubtful_days_are_looked_at(spark, logs, tmp_path):
    """A filter that is wide enough leaves new records out of doubt."""
    known = replays.day_filters(logs.where("log_id % 2 = 0"), 64)
    new = logs.where("log_id % 2 = 1").withColumn("day", F.to_date("timestamp"))
    old = logs.where("log_id % 2 = 0").withColumn("day", F.to_date("timestamp"))
    assert replays.doubtful(new, known).count() <= 3
    assert replays.doubtful(old, known).count() == 500


# --- counts -----------------------------------------------------------------------------


def test_late_and_early_rows_are_counted(spark, logs, tmp_path):
    source, target, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    early = logs.where("log_id < 20").withColumn("timestamp", F.current_timestamp() + F.expr("INTERVAL 3 HOURS"))
    parts = [early, logs.where("timestamp >= '2024-01-15'"), logs.where("timestamp < '2024-01-15'")]
    for part in parts:
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(logs.schema).parquet(source)
        live.stream_counts(stream, target, check, "1h", ["service_name"], available_now=True).awaitTermination()
    stored = spark.read.parquet(source)
    want = stored.groupBy("service_name", F.date_trunc("hour", "timestamp").alias("b")).count()
    got = live.read_volume(spark, target, ["service_name"])
    assert rows(got) == rows(want)
    live.merge_volume(spark, target, "2024-01-20", ["service_name"])
    assert len(Files(spark, target).found(f"{target}/day=2024-01-20/*.parquet")) == 1
    assert rows(live.read_volume(spark, target, ["service_name"])) == rows(want)
    ranged = live.read_volume(spark, target, [], "2024-01-10T00:00:00Z", "2024-01-11T05:00:00Z")
    inside = stored.where("timestamp >= '2024-01-10' and timestamp < '2024-01-11 06:00:00'").count()
    assert ranged.agg(F.sum("count")).first()[0] == inside


def test_deep_pages_from_counts(spark, logs, tmp_path):
    undated = logs.withColumn("timestamp", F.when(F.col("log_id") % 10 > 0, F.col("timestamp")))
    dated = undated.withColumn("day", F.to_date("timestamp"))
    rollup.write_counts(undated, str(tmp_path), "all")
    counts = rollup.read_counts(spark, str(tmp_path))
    window = {"start": "2024-01-05T06:13:21.5Z", "end": "2024-01-20T18:30:17Z"}
    for filters in ({}, {"severity": "info"}, window, {"service": "orders-api"}):
        for offset in (0, 333, 895, 5000):
            page = paging.log_page(dated, 7, offset, True, 0, counts, **filters)
            plain = paging.log_page(dated, 7, offset, True, 10_000, **filters)
            assert page.total.first()[0] == plain.total.first()[0]
            assert rows(page.rows) == rows(plain.rows), (filters, offset)
