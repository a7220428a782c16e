"""Nearest neighbours, registered queries with SQL, and the pipeline."""

from __future__ import annotations

import numpy as np
import pytest
from oracle import compare, connect

from timberline.llm import multi_index
from timberline.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


def exact(rows, every=50, k=5):
    good = [(i, np.array(v, float)) for i, v in rows]
    out = {}
    for q, a in good:
        if q % every == 0:
            found = [
                (-(a @ b) / (np.linalg.norm(a) * np.linalg.norm(b)), i) for i, b in good if i != q
            ]
            out[q] = sorted(found)[:k]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    rows = [(i, (centres[i % 30] + 0.5 * rng.normal(size=16)).tolist()) for i in range(3000)]
    rows += [(4000 + i, rows[7][1]) for i in range(400)]  # one very common vector
    odd = [(5000, None), (5050, [0.0] * 16), (5100, [1.0, None] * 8), (5150, [float("nan")] * 16),
           (5200, [float("inf")] * 16), (5250, [1.0]), (None, rows[0][1]), (0, rows[0][1])]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn(
        "ids", multi_index.F.lit(1)
    )
    want = exact(rows)
    got = {}
    for r in multi_index.nearest(table).collect():
        got.setdefault(r.query_id, []).append(r)
    assert got.keys() == want.keys()
    hits = total = 0
    vectors = dict(rows)
    for q, found in got.items():
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 6))
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        for r in found:
            a, b = np.array(vectors[q]), np.array(vectors[r.vec_id])
            assert r.score == pytest.approx(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)), abs=1e-12)
        # ties at equal vectors may differ in the last bits of a score
        hits += sum(any(r.score >= -s - 1e-12 for s, _ in want[q][i : i + 1]) for i, r in enumerate(found))
        total += 5
    assert hits / total >= 0.9


def test_traversal_is_by_summed_distance():
    rng = np.random.default_rng(3)
    a, b = rng.random(9), rng.random(7)
    cells = [c for c, _ in multi_index.traversal(a, b, np.ones(63, int), np.inf)]
    sums = [a[c // 7] + b[c % 7] for c in cells]
    assert sorted(cells) == list(range(63)) and sums == sorted(sums)
    assert list(multi_index.traversal(a, b, np.full(63, 10), 25))[-1][1] == 30


def test_few_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (50, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id) for r in multi_index.nearest(few).collect()]
    assert sorted(got) == [(0, 1, 50), (0, 2, 1), (50, 1, 0), (50, 2, 1)]
    assert multi_index.nearest(few.limit(0)).count() == 0
    assert multi_index.nearest(few.where("vec_id = 1")).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(SF_DIR), QUERIES[name], ORACLES[name], SF_DIR) is None


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark, frame, tmp_path):
    import corpus_pipeline
    import sentencepiece
    from pyspark.sql import functions as F
    from test_ngram_join import brute
    from test_text_operators import base_values, brute_hits

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    more = spark.createDataFrame(
        [(None, "no id here at all, only a text", "en", None, None), (None, "no id here at all, only a text", None, "s", 1),
         (900_001, None, None, None, None), (900_002, "", "en", "s", 0),
         (900_003, "my token = q9w8e7r6t5y4u3i2 and words around it", "en", "s", 1)],
        docs.schema,
    )
    docs = docs.unionByName(more).withColumn("key", F.lit(1)).withColumn("spans", F.lit("x"))
    steps = [docs]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, steps[-1], SF_DIR).write.parquet(f"{tmp_path}/{n}")
        steps.append(spark.read.parquet(f"{tmp_path}/{n}"))
        if n < 4:
            assert steps[-1].columns == docs.columns
    rows = [[r.asDict() for r in s.collect()] for s in steps]
    text = [{(r["doc_id"], r["text"]) for r in s} for s in rows[:-1]]
    assert text[1] <= text[0] and text[2] <= text[1]
    ids = [r["doc_id"] for r in rows[2]]
    assert len(set(ids)) == len(ids)
    roots = brute([(r["doc_id"] if r["doc_id"] is not None else 1 << 62, r["text"]) for r in rows[1]], 5, 80)
    assert {i for i in ids if i is not None} == {i for i, r in roots.items() if i == r and i < 1 << 62}
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    before = brute_hits([r["text"] for r in rows[2]], items)
    assert len(rows[3]) == sum(h < n or not h for n, h, _ in before)
    assert any(h for _, h, _ in before) and not any(h for _, h, _ in brute_hits([r["text"] for r in rows[3]], items))
    clean = {r["doc_id"]: r["text"] for r, (_, h, _) in zip(rows[2], before) if not h}
    after = {r["doc_id"]: r["text"] for r in rows[3]}
    assert all(after[i] == t for i, t in clean.items())
    owners = {}
    for r in rows[3]:
        for v in base_values(r["text"] or ""):
            owners.setdefault(v, set()).add(r["source"])
    live = {v for v, o in owners.items() if len(o) < 3}
    assert live and not any(live & set(base_values(r["text"] or "")) for r in rows[4])
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows[4])
    pieces = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.PIECES)
    last = {r["doc_id"]: r for r in rows[5]}
    for r in rows[4]:
        if r["doc_id"] is not None:
            assert last[r["doc_id"]]["ids"] == pieces.encode(r["text"] or "")
            assert last[r["doc_id"]]["n_tokens"] == len(last[r["doc_id"]]["ids"])


def test_pipeline_over_nothing(spark, frame):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_DIR).count() == 0


def test_pipeline_is_registered(spark):
    import __spark_entry__ as entry
    import corpus_pipeline

    assert entry.queries()["pipeline"] is corpus_pipeline.run


def test_texts_that_share_an_id_are_judged_apart(spark, frame):
    import corpus_pipeline

    a, b = (" ".join(f"{c}{i}" for i in range(100)) for c in "ab")
    rows = frame(
        [a, b, f"{a} more", f"{b} more", a, "left alone", "left alone", b, "only here", "only here", ""],
        [5, 5, 6, 7, 5, 8, 9, None, None, None, 10],
    )
    got = corpus_pipeline.drop_near_duplicates(spark, rows, SF_DIR)
    assert got.columns == rows.columns
    assert sorted((r.text, str(r.doc_id)) for r in got.collect()) == sorted(
        [(a, "5"), (b, "5"), ("left alone", "8"), ("only here", "None"), ("", "10")]
    )


def test_index_finds_neighbours_without_its_sample(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(2000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = exact(rows)

    def share(**more):
        got = {(r.query_id, r.vec_id) for r in multi_index.nearest(table, **more).collect()}
        return sum((q, i) in got for q, found in want.items() for _, i in found) / (5 * len(want))

    print("recall with a small and a whole sample", share(train=200), share())
    assert share(train=200) >= 0.9
    # a traversal that ends at once: the sample must not make up for it
    real = multi_index.traversal
    monkeypatch.setattr(multi_index, "traversal", lambda a, b, s, n: real(a, b, s, n if n == np.inf else 1))
    assert share() < 0.9


def test_several_vectors_of_one_id_take_one_place():
    vectors = np.array([[1.0, 0.01 * i] for i in range(20)] + [[1.0, 1.0 + i] for i in range(4)])
    own = [[7]] * 20 + [[i] for i in range(4)]
    got = multi_index.best_of(np.array([[1.0, 0.0]]), np.array([50]), vectors, own, 4)
    assert [v for _, v, _, _ in got] == [7, 0, 1, 2]


def test_stages_carry_columns_of_any_name_and_type(spark, frame):
    from pyspark.sql import functions as F

    import corpus_pipeline

    text = " ".join(f"w{i}" for i in range(80))
    rows = frame([text, text, f"{text} token = q9w8e7r6t5y4u3i2", None], [1, 1, 2, None])
    odd = rows.selectExpr("*", "map('k', doc_id) AS `a.b`", "map('m', array(1)) AS m", "struct(1 AS x) AS `c``d`")
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR)
        assert docs.columns == odd.columns, name
        assert all(r["a.b"] == {"k": r.doc_id} for r in docs.collect())
    assert corpus_pipeline.STAGES[-1][1](spark, docs.withColumn("n", F.lit(1)), SF_DIR).count() == docs.count() > 0


@pytest.mark.parametrize("missing", ["ahocorasick", "xxhash", "sentencepiece", "public_tokenizers"])
def test_entry_without_a_library(missing):
    """The other queries stay; what needs the library is not registered."""
    import subprocess
    import sys
    from pathlib import Path

    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"
    root = Path(__file__).resolve().parents[2]
    said = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True)
    count, pipeline = said.stdout.split()
    assert int(count) >= 113 and (pipeline == "False" or missing == "sentencepiece")
