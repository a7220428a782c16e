"""A training corpus from raw documents: five stages, each one operator of ``timberline.llm``.

Every stage takes all rows its predecessor kept, as columns of ``documents``, and its decisions
take effect: rows that are rejected or duplicates go, benchmark passages and live secrets are taken
out of the text, and the last stage returns the encoded corpus. Each stage is written out and read
again, so a lost executor costs a task. Extra columns are carried along to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from timberline.llm.batches import show_package
from timberline.llm.stages import (
    PIECES,  # noqa: F401
    accept_quality,
    cut_benchmark,
    drop_near_duplicates,
    encode_pieces,
    redact_secrets,
)
from timberline.sources.scratch import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality", accept_quality),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark", cut_benchmark),
    ("secrets", redact_secrets),
    ("pieces", encode_pieces),
]

#: A classifier and a tokenizer are not SQL; tests compare with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    show_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
