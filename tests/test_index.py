"""The term index as tables: what is read, what follows the table, and what a stop leaves behind."""

from __future__ import annotations

import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from timberline.functions.text import match, query_tokens, term_positions
from timberline.operators import search
from timberline.sources import files as tablefiles
from timberline.sources import logs as table
from timberline.streaming import ingest


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_term_positions(spark):
    texts = ["b a b", "", None, "--", "one", "我 a我 a", " ".join(["x", "y"] * 3000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, body string")
    for r in rows.select("body", term_positions(F.col("body")).alias("t")).collect():
        want = {}
        for n, t in enumerate(query_tokens(r.body or "")):
            want.setdefault(t, []).append(n)
        assert {e.term: e.positions for e in r.t or []} == want
        assert r.t is not None  # no body, no terms


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    words = [f"{a}{b}{c}" for a in ("con", "pre", "dis", "x") for b in ("nect", "fix", "ta") for c in ("", "ed", "ion", "9")]
    docs = spark.range(2000).select(
        F.col("id").alias("doc_id"),
        F.concat(
            F.lit("every "),
            F.get(F.array(*map(F.lit, words)), (F.col("id") % len(words)).cast("int")),
            F.lit(" w"), F.col("id").cast("string"),
        ).alias("body"),
    )
    path = str(tmp_path_factory.mktemp("index"))
    built = search.build_term_index(docs, keys=["doc_id"])
    search.write_term_index(built, path)
    return docs, search.read_term_index(spark, path, built.schema), path


@pytest.mark.parametrize(
    "mode, query",
    [("MATCH_PHRASE_PREFIX", "every connect"), ("MATCH_PHRASE_PREFIX", "disfixion w12"), ("MATCH_PHRASE_EDGE", "fixed w1"),
     ("MATCH_PHRASE_EDGE", "nection"), ("MATCH_PHRASE_EDGE", "9"), ("MATCH_REGEXP", "^pre.*9$"), ("MATCH_REGEXP", "tai?on+"),
     ("MATCH_REGEXP", "(fix|ta)ed$"), ("MATCH_REGEXP", "^w1[0-4]5$"), ("MATCH_REGEXP", "."), ("MATCH_ANY", "w3 w4 nothing"),
     ("MATCH_ALL", "every w5"), ("MATCH_PHRASE", "every xta")],
)
@pytest.mark.parametrize("most", [0, 200])
def test_modes_through_dictionary(written, monkeypatch, mode, query, most):
    """The same rows as a scan, whether the terms found are listed or joined."""
    docs, index, _ = written
    monkeypatch.setattr(search, "MAX_TERMS", most)
    want = sorted(r[0] for r in docs.where(match(F.col("body"), query, mode)).select("doc_id").collect())
    keys = search.matching_keys(index, query, mode, ["doc_id"])
    assert sorted(r[0] for r in keys.collect()) == want
    plain = search.matching_keys(index.postings, query, mode, ["doc_id"])
    assert sorted(r[0] for r in plain.collect()) == want
    assert want or query.endswith("nothing")


def test_only_the_terms_found_are_read(spark, written):
    """Postings are asked for by the terms of the dictionary, which is asked for by key."""
    _, index, _ = written
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    for mode, query, terms in [
        ("MATCH_PHRASE_PREFIX", "connection", ["connection"]),
        ("MATCH_PHRASE_EDGE", "isnect", ["disnect", "disnected", "disnection", "disnect9"]),
        ("MATCH_REGEXP", "^pretai", ["pretaion"]),
    ]:
        pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan_of(search.matching_keys(index, query, mode, ["doc_id"])))[1]
        assert sorted(re.findall(r"EqualTo\(term,(\w+)\)", pushed)) == sorted(terms)
    lookup = search._Lookup(index)
    for rows, test in [
        (lookup.beginning("con"), "StringStartsWith(key,con)"),
        (lookup.ending("ion"), "StringStartsWith(key,noi)"),
        (lookup.holding("nect"), "EqualTo(key,nec)"),
    ]:
        assert test in plan_of(rows) and "EqualTo(kind," in plan_of(rows)
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_files_are_ranges_of_terms(spark, tmp_path):
    """A term of every record is cut by records; the others lie in one file each."""
    docs = spark.range(20_000).select("id", F.concat(F.lit("all "), F.lit("t"), (F.col("id") % 1000).cast("string")).alias("body"))
    built = search.build_term_index(docs, keys=["id"])
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        search.write_term_index(built, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    rows = spark.read.parquet(f"{tmp_path}/postings").withColumn("file", F.input_file_name())
    counts = {r["term"]: (r["f"], r["n"]) for r in rows.groupBy("term").agg(F.count_distinct("file").alias("f"), F.count("*").alias("n")).collect()}
    assert counts["all"][1] == 20_000 and counts["all"][0] >= 2
    assert sum(f > 1 for t, (f, _) in counts.items() if t != "all") <= 4
    sizes = [r["n"] for r in rows.groupBy("file").agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 2 * sum(sizes) / len(sizes)


def test_bodies_are_cut_once_and_by_many_tasks(spark, tmp_path):
    """Also those of a source that gives all its records to one task."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def body(i):
        read.add(1)
        return f"all t{i}"

    docs = spark.range(1_000).coalesce(1).select("id", body("id").alias("body"))
    built = search.build_term_index(docs, keys=["id"])
    search.write_term_index(built, str(tmp_path))
    assert read.value == 1_000
    assert spark.read.parquet(f"{tmp_path}/postings").count() == 2_000
    assert "REBALANCE_PARTITIONS" in built._jdf.queryExecution().executedPlan().toString()


def test_required_literals():
    assert search.required_literals("^ah1000[13]$") == [(True, "ah1000")]
    assert search.required_literals("abc*de+f?") == [(False, "ab"), (False, "de")]
    for odd in ("a|bcd", "(abc)", r"abc\d", "abc{2}", "[]abc]", "[a[bc]d]", "(?i)abc"):
        assert search.required_literals(odd) == []


def test_index_follows_the_table(spark, logs, tmp_path):
    path, index = str(tmp_path / "logs"), str(tmp_path / "index")
    for _ in range(2):  # a repeated batch replaces itself in both
        ingest.append_batch(logs, path, "one", index=index)
    assert search.days_behind(spark, path, index) == []
    schema = search.build_term_index(table.read_logs(spark, path)).schema
    postings = search.read_term_index(spark, index, schema).postings
    assert postings.count() == search.build_term_index(table.with_day(logs)).count()
    table.write_logs(logs.where("day(timestamp) = 10"), path)
    (behind,) = search.days_behind(spark, path, index)
    assert behind.endswith("-10")
    assert search.catch_up(spark, path, index) == [behind] and search.days_behind(spark, path, index) == []
    ingest.compact_day(spark, path, behind, index=index)
    assert search.days_behind(spark, path, index) == []
    dropped = table.drop_expired(spark, path, date(2024, 1, 17), past=5, index=index)
    days = {r[0] for r in search.read_term_index(spark, index, schema).terms.select("day").distinct().collect()}
    assert dropped and min(days) == date(2024, 1, 12)
    assert days == {r[0] for r in table.read_logs(spark, path).where("body <> ''").select("day").distinct().collect()}


class Stop(Exception):
    pass


@pytest.mark.parametrize("steps", range(0, 14))
def test_compaction_can_stop_anywhere(spark, logs, tmp_path, monkeypatch, steps):
    """After ``steps`` changes of files the run ends; the next one leaves every row once."""
    path, day = str(tmp_path / "logs"), "2024-01-10"
    own = logs.where(F.to_date("timestamp") == day)
    for n in range(3):
        ingest.append_batch(own.where(F.col("log_id") % 3 == n), path, f"b{n}")
    want = sorted(r[0] for r in own.select("log_id").collect())
    left = [steps]

    def counted(real):
        def step(self, *args):
            if left[0] == 0:
                raise Stop
            left[0] -= 1
            return real(self, *args)

        return step

    with monkeypatch.context() as patch:
        for name in ("move", "delete", "write"):
            patch.setattr(tablefiles.Files, name, counted(getattr(tablefiles.Files, name)))
        try:
            ingest.compact_day(spark, path, day)
            stopped = False
        except Stop:
            stopped = True
    if steps == 0:
        assert stopped
    tablefiles.finish_replacements(spark, path)
    rows = table.read_logs(spark, path)
    assert sorted(r[0] for r in rows.select("log_id").collect()) == want
    ingest.compact_day(spark, path, day)
    assert sorted(r[0] for r in table.read_logs(spark, path).select("log_id").collect()) == want


def test_a_move_that_fails_is_an_error(spark, tmp_path):
    files = tablefiles.Files(spark, str(tmp_path))
    with pytest.raises(Exception):
        files.move(f"{tmp_path}/nowhere", f"{tmp_path}/there")
    assert tablefiles.same_path("s3://a//b/c/") == "s3://a/b/c"
    assert ingest.batch_name("/x/check/", 3) == ingest.batch_name("/x//check", 3)
