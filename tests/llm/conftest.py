from __future__ import annotations

import random

import pytest


@pytest.fixture
def rng():
    return random.Random(11)


@pytest.fixture
def frame(spark):
    """Rows of (doc_id, text) with further columns whose names the operators use themselves."""

    def make(texts, ids=None, partitions=3):
        rows = [
            (i, t, "en", f"src{n % 3}", None, 1, "x")
            for n, (i, t) in enumerate(zip(ids or range(len(texts)), texts))
        ]
        schema = (
            "doc_id long, text string, lang string, source string, n_chars long, key int, row string"
        )
        return spark.createDataFrame(rows, schema).repartition(partitions)

    return make


def by_id(frame):
    return {r[0]: r for r in frame.collect()}
