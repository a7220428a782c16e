from __future__ import annotations

import random
from collections import Counter

import pytest
from brute_miner import mine
from pyspark.sql import functions as F

from timberline.functions import templates as T
from timberline.operators import patterns as P
from timberline.settings import MiningConfig

SCHEMA = "log_id long, timestamp timestamp, service_name string, severity_text string, body string"


def table(spark, bodies, partitions=3):
    rows = spark.createDataFrame(
        [(i, b) for i, b in enumerate(bodies)], "log_id long, body string"
    ).repartition(partitions)
    return rows.select(
        "log_id",
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("log_id") * 37).alias("timestamp"),
        F.lit("svc").alias("service_name"),
        F.lit("INFO").alias("severity_text"),
        "body",
    )


def random_lines(seed: int, n: int = 400) -> list[str]:
    rng = random.Random(seed)
    verbs = ["open", "close", "read", "write", "drop"]
    out = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.3:
            out.append(f"{rng.choice(verbs)} file{rng.randint(1, 300)} by user{rng.randint(1, 9)} ok")
        elif kind < 0.5:
            out.append(" ".join(str(rng.randint(1, 999)) for _ in range(rng.randint(1, 4))))
        elif kind < 0.7:
            out.append(" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))))
        elif kind < 0.85:
            out.append(f"login of {rng.choice('klmnopqrstuv')}{rng.choice('xyz')} from 10.0.0.{rng.randint(1, 250)}")
        else:
            out.append(f"GET /items/{rng.randint(1, 500)} {rng.choice([200, 404, 503])} {rng.randint(1, 9999)}")
    return out


CONFIGS = [
    MiningConfig(),
    MiningConfig(sim_th=0.3, depth=4),
    MiningConfig(sim_th=0.7, depth=3, literal_values=4),
    MiningConfig(max_children=3),
    MiningConfig(depth=5, slice_size=6),
    MiningConfig(sim_th=0.4, depth=4, slice_tokens=20, max_children=4),
]


@pytest.mark.parametrize("config", CONFIGS, ids=str)
def test_mining_equals_single_process(spark, config):
    bodies = random_lines(7)
    logs = table(spark, bodies)
    model = P.mine_patterns(logs, config=config)
    assigned = P.assign_patterns(logs, model).withColumn("masked", T.masked_line(F.col("body")))
    got = {r["masked"]: r["template"] for r in assigned.select("masked", "template").collect()}
    masked = [r[0] for r in logs.select(T.masked_line(F.col("body"))).collect()]
    assert got == mine(masked, config)
    want = Counter(got[m] for m in masked)
    assert {r["template"]: r["count"] for r in model.patterns.collect()} == dict(want)


def test_slice_size_changes_nothing(spark):
    bodies = random_lines(17, 500) + [f"{i} {i * 7} {i % 13}.5 {i * 3}" for i in range(300)]
    results = set()
    for size in (2, 10, 50, 4000):
        model = P.mine_patterns(table(spark, bodies), config=MiningConfig(depth=4, slice_size=size))
        results.add(tuple(sorted((r["template"], r["count"]) for r in model.patterns.collect())))
    assert len(results) == 1
    twenty = P.mine_patterns(table(spark, bodies * 20), config=MiningConfig(depth=4, slice_size=10))
    assert sorted((r["template"], r["count"] // 20) for r in twenty.patterns.collect()) == list(results.pop())


def test_border_of_distinct_values(spark):
    bodies = [f"n{i} of kind a" for i in range(16)] * 2 + [f"n{i} of kind b c" for i in range(17)] * 2
    model = P.mine_patterns(table(spark, bodies), config=MiningConfig(sim_th=1.0))
    templates = {r["template"] for r in model.patterns.collect()}
    assert "<*> of kind b c" in templates and "<*> of kind a" not in templates and len(templates) == 17


def test_fixture_equals_single_process(spark, logs):
    config = MiningConfig()
    model = P.mine_patterns(logs, config=config)
    assigned = P.assign_patterns(logs, model).withColumn("masked", T.masked_line(F.col("body")))
    rows = assigned.select("masked", "template").collect()
    assert {r["masked"]: r["template"] for r in rows} == mine([r["masked"] for r in rows], config)


def test_every_line_has_one_fitting_pattern_whatever_the_order(spark):
    bodies = random_lines(11) + ["", None, "   "]
    results = []
    for seed, partitions in ((1, 1), (2, 7)):
        shuffled = bodies[:]
        random.Random(seed).shuffle(shuffled)
        logs = table(spark, shuffled, partitions)
        model = P.mine_patterns(logs)
        assigned = P.assign_patterns(logs, model)
        assert assigned.count() == len(bodies) - 2
        misfit = ~T.template_matches(F.col("template"), T.masked_line(F.col("body")))
        assert assigned.where(F.col("pattern_id").isNull() | misfit).count() == 0
        assert model.patterns.agg(F.sum("count")).first()[0] == len(bodies) - 2
        results.append(sorted((r["pattern_id"], r["template"], r["count"]) for r in model.patterns.collect()))
    assert results[0] == results[1]


def test_no_lines(spark):
    logs = table(spark, ["", None])
    model = P.mine_patterns(logs)
    assert model.patterns.count() == 0
    assert P.assign_patterns(logs, model).count() == 0


def test_one_hot_pattern_is_no_exception(spark):
    bodies = [f"hot path {i} done" for i in range(3000)] + random_lines(5, 300)
    model = P.mine_patterns(table(spark, bodies))
    top = P.list_patterns(model, limit=1).first()
    assert (top["template"], top["count"]) == ("hot path <*> done", 3000)


def test_list_is_cut_by_count_and_limit(spark):
    model = P.mine_patterns(table(spark, ["a b c"] * 5 + ["d e"] * 2 + ["f"]))
    assert [r["count"] for r in P.list_patterns(model).collect()] == [5, 2]
    assert P.list_patterns(model, min_count=1, limit=2).count() == 2
    with pytest.raises(ValueError):
        P.list_patterns(model, limit=501)


def test_saved_model_assigns_and_matches(spark, tmp_path):
    logs = table(spark, random_lines(3))
    model = P.mine_patterns(logs)
    model.save(str(tmp_path / "m"))
    loaded = P.PatternModel.load(spark, str(tmp_path / "m"), model.masks, model.config)
    pick = ("log_id", "pattern_id")
    want = sorted(P.assign_patterns(logs, model).select(*pick).collect())
    assert sorted(P.assign_patterns(logs, loaded).select(*pick).collect()) == want

    new = table(spark, ["GET /items/999999 200 31", "never seen this before at all", "open file77777 by user3 ok"])
    got = {r["log_id"]: r["template"] for r in P.match_patterns(new, loaded.patterns).collect()}
    assert got[1] is None
    assert got[0] is not None and got[2] is not None


def test_match_equals_brute_force(spark):
    logs = table(spark, random_lines(13, 200))
    patterns = [
        "<*> <*> <*>", "open <*> by <*> ok", "open <*> <*> <*> ok", "<*> <*> by <*> <*>", "a b", "a <*>",
        "<*> b", "<*>", "GET <*> 200 <*>", "GET <*> <*> <*>",
    ]
    frame = spark.createDataFrame([(f"p{i}", p) for i, p in enumerate(patterns)], "pattern_id string, template string")
    for row in P.match_patterns(logs, frame, masks=[]).collect():
        line = row["body"].split()
        fits = [
            (p.split().count("<*>"), f"p{i}")
            for i, p in enumerate(patterns)
            if len(p.split()) == len(line) and all(a in ("<*>", b) for a, b in zip(p.split(), line))
        ]
        assert row["pattern_id"] == (min(fits)[1] if fits else None), row["body"]


def test_samples_are_the_newest(spark):
    logs = table(spark, [f"hot {i}" for i in range(50)] + ["cold x y"] * 3)
    model = P.mine_patterns(logs, config=MiningConfig(literal_values=4))
    assigned = P.assign_patterns(logs, model)
    for totals in (None, model.patterns):
        rows = P.pattern_samples(assigned, 4, totals=totals).orderBy("pattern_id", "rank").collect()
        by_pattern: dict[str, list] = {}
        for r in rows:
            by_pattern.setdefault(r["pattern_id"], []).append(r)
        sizes = sorted((len(v), v[0]["total_matched"]) for v in by_pattern.values())
        assert sizes == [(3, 3), (4, 50)]
        for v in by_pattern.values():
            assert [r["timestamp"] for r in v] == sorted((r["timestamp"] for r in v), reverse=True)


def test_config_is_checked():
    for bad in (dict(sim_th=0.05), dict(sim_th=1.1), dict(depth=2), dict(depth=11), dict(max_children=1)):
        with pytest.raises(ValueError):
            MiningConfig(**bad)
