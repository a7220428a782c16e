from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_patterns import random_lines, table

from timberline.operators import matching as M
from timberline.operators import patterns as P
from timberline.operators import prefix_tree as tree_of
from timberline.streaming.live import stream_match

WILD = tree_of.WILD


def fits(template: str, line: str) -> bool:
    a, b = template.split(" "), line.split(" ")
    return len(a) == len(b) and all(x in (WILD, y) for x, y in zip(a, b))


def walked(templates: list[str], lines: list[str]):
    tree = tree_of.build(pa.array(templates, pa.string()))
    best, visits = tree_of.walk(tree, *tree_of.split_tokens(pa.array(lines, pa.string()), tree["known"]))
    return [None if b == tree["none"] else int(b) for b in best], visits


def first_fit(templates: list[str], line: str):
    return next((i for i, t in enumerate(templates) if fits(t, line)), None)


words = st.lists(st.sampled_from(["a", "b", "c", WILD, ""]), min_size=1, max_size=5).map(" ".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(words, max_size=25), st.lists(words, max_size=25))
def test_walk_finds_the_first_template_that_fits(templates, lines):
    assert walked(templates, lines)[0] == [first_fit(templates, line) for line in lines]


def test_halves_give_the_same(monkeypatch):
    rng = random.Random(4)
    templates = [" ".join(rng.choice(["a", "b", WILD]) for _ in range(6)) for _ in range(300)]
    lines = [" ".join(rng.choice("ab") for _ in range(6)) for _ in range(200)]
    want = walked(templates, lines)
    monkeypatch.setattr(tree_of, "FRONTIER", 50)
    got = walked(templates, lines)
    assert got[0] == want[0] and np.array_equal(got[1], want[1])


def test_a_line_meets_few_nodes_of_a_hundred_thousand_templates():
    """All begin alike and have one length, so a list by length and two tokens would hold them all."""
    rng = random.Random(9)
    templates = []
    for i in range(100_000):
        tokens = ["GET", "item", f"k{i % 313}", f"v{i}", "took", f"n{i % 7}", "ms"]
        tokens[rng.choice([2, 4, 5])] = WILD
        templates.append(" ".join(tokens))
    lines = [f"GET item k{i % 313} v{i} took n{i % 7} ms" for i in range(0, 100_000, 331)]
    lines += ["GET item k1 v2 took n3 ms", "GET item none of these ms", "GET"]
    best, visits = walked(templates, lines)
    for line, found in zip(lines, best):
        value = line.split(" ")[3] if line.count(" ") == 6 else ""
        own = int(value[1:]) if value[1:].isdigit() else None
        assert found == (own if own is not None and fits(templates[own], line) else None), line
    assert visits.max() <= 2 * 8


@pytest.mark.parametrize("block_bytes", [M.BLOCK_BYTES, 30_000, 15_000])
def test_blocks_give_what_the_lists_give(spark, block_bytes):
    bodies = [*random_lines(21, 300), *["open file7 by user1 ok"] * 40]
    logs = table(spark, bodies)
    patterns = P.position_templates(logs, masks=[]).select(F.md5("template").alias("pattern_id"), "template")
    extra = spark.createDataFrame(
        [("z", "<*> <*> <*>"), ("y", "<*> <*> <*>"), (None, "a b c"), ("x", None), ("w", "<*>")], "pattern_id string, template string"
    )
    patterns = patterns.union(extra)
    index = M.index_trees(patterns, block_bytes)
    assert (len(index.blocks) == 1) == (block_bytes == M.BLOCK_BYTES)
    if block_bytes == 15_000:
        assert any(b.parts > 1 for b in index.blocks)
    pick = ("log_id", "pattern_id", "template")
    known = patterns.dropna()
    want = sorted(P.match_patterns(logs, known, masks=[]).select(*pick).collect())
    assert sorted(M.match_many(logs, index, masks=[]).select(*pick).collect()) == want
    names = [(r["pattern_id"], r["template"]) for r in known.collect()]
    for (_, found, _), body in zip(want, bodies):
        all_ = [(t.split(" ").count(WILD), i) for i, t in names if fits(t, " ".join(body.split()))]
        assert found == (min(all_)[1] if all_ else None)


def test_no_patterns_no_logs_odd_columns(spark):
    schema = "log_id long, body string, `a.b` string, n int, known map<string,string>, wild int"
    rows = [(1, "x y", "p", 1, {"k": "v"}, None), (1, "x y", "p", 1, {"k": "v"}, None), (2, None, None, None, None, 3),
            (3, "", "q", 2, {}, 4), (4, "  ", "q", 2, {}, 5), (None, "y " * 60_000, "r", 3, None, 6)]
    logs = spark.createDataFrame(rows, schema)
    none = spark.createDataFrame([], "pattern_id string, template string, more int")
    one = spark.createDataFrame([("p", "x <*>", 1), ("q", "y " * 59_999 + "y", 2)], none.schema)
    for patterns, want in ((none, [None] * 4), (one, [None, "p", "p", "q"])):
        got = M.match_many(logs, patterns, masks=[])
        assert got.columns == [*logs.columns, "pattern_id", "template"]
        found = got.collect()
        assert sorted((r["pattern_id"] for r in found), key=str) == sorted(want, key=str)
        assert all(r["known"] == {"k": "v"} for r in found if r["log_id"] == 1)
    assert M.match_many(logs.limit(0), M.index_trees(one, 5_000_000), masks=[]).count() == 0


def test_one_block_shuffles_nothing_and_streams(spark, tmp_path):
    logs = table(spark, random_lines(5, 200))
    patterns = P.position_templates(logs).select(F.md5("template").alias("pattern_id"), "template")
    pick = ("log_id", "pattern_id")
    want = sorted(P.match_patterns(logs, patterns).select(*pick).collect())
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    logs.write.parquet(source)
    stored = spark.read.parquet(source)
    plan = M.match_many(stored, patterns)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and plan.count("ArrowEvalPython") == 1
    for name, bytes_ in (("one", M.BLOCK_BYTES), ("many", 30_000)):
        stream = spark.readStream.schema(logs.schema).parquet(source)
        index = M.index_trees(patterns, bytes_)
        if name == "many":
            with pytest.raises(ValueError):
                M.match_many(stream, index)
        stream_match(stream, index, f"{target}-{name}", str(tmp_path / name), available_now=True).awaitTermination()
        assert sorted(spark.read.parquet(f"{target}-{name}").select(*pick).collect()) == want


def test_shapes_and_blocks_without_the_driver(spark, monkeypatch):
    """Many patterns: shapes joined by text and trees built in tasks give what the lists give."""
    bodies = [*random_lines(21, 300), *["open file7 by user1 ok"] * 40]
    logs = table(spark, bodies)
    opened = [
        " ".join([*t[:i], WILD, *t[i + 1 :]])
        for t in (" ".join(b.split()).split(" ") for b in bodies[::2])
        for i in range(len(t))
    ]
    rows = [(f"p{i:05}", t) for i, t in enumerate(dict.fromkeys([*opened, "<*> <*> <*>", "open <*> <*> user1 <*>"]))]
    patterns = spark.createDataFrame(rows, "pattern_id string, template string")
    pick = ("log_id", "pattern_id", "template")
    want = sorted(P.match_patterns(logs, patterns, masks=[]).select(*pick).collect(), key=str)
    monkeypatch.setattr(M, "SLICE_LINES", 7)
    monkeypatch.setattr(M.TreeIndex, "best", lambda *_: pytest.fail("a block passed the driver"))
    for large in (3, 10**6):
        monkeypatch.setattr(M, "SHAPE_PATTERNS", large)
        index = M.index_trees(patterns, 15_000)
        assert len(index.others) > 1 if large > 3 else not index.shapes.isEmpty()
        assert sorted(M.match_many(logs, index, masks=[]).select(*pick).collect(), key=str) == want
