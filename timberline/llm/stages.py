"""The stages of the corpus pipeline: each one operator over whole rows of ``documents``.

Rows that are rejected or duplicates go, benchmark passages and live secrets are taken out of the text,
and the last stage returns the encoded corpus. Extra columns of any type and name are carried along.
"""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline.llm import decontaminate, ngram_join, quality, secrets, sentencepieces
from timberline.llm.batches import map_texts, quoted, small_batches

#: What a live secret becomes.
PLACEHOLDER = "[secret]"
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _measured(docs: DataFrame) -> DataFrame:
    """``n_chars`` brought up to date where a text was changed."""
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind))


def _orderable(field: T.StructField) -> Column:
    """The column as it is, or as JSON where its type has no order."""
    column = F.col(quoted(field.name))
    if any(kind in field.dataType.simpleString() for kind in ("map<", "variant")):
        return F.to_json(F.struct(column))
    return column


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the classifier accepts; it learns from the labels outside the held-out part.

    Without labels of both kinds it has no opinion and every row passes.
    """
    small_batches(spark)
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five words, similarity 0.8): the smallest id.

    What is judged is an id with its text: repeats of both are one row, different texts under one
    id are compared like those of different ids. Of them the first by hash of the text counts as
    the smallest. Rows without an id come after all others; those with the same text are one row.
    Of rows that are one the first by their other columns stays, maps as JSON.
    """
    small_batches(spark)
    name = "row_id"
    while name in docs.columns:
        name += "_"
    named = docs.withColumn(name, F.xxhash64("doc_id", "text"))
    found = ngram_join.near_duplicates(named, n=5, percent=80, key=name)
    place = F.struct(
        F.col("doc_id").isNull().alias("late"), F.col("doc_id").alias("id"),
        F.xxhash64("text").alias("hash"), F.col(name).alias("row"),
    )
    kept = (
        named.select(name, place.alias("place"))
        .join(found.select(name, "component_id").distinct(), name)
        .groupBy("component_id")
        .agg(F.min("place").alias("place"))
        .select(F.col("place.row").alias(name))
    )
    first = Window.partitionBy(name).orderBy(*map(_orderable, sorted(docs.schema, key=lambda f: f.name)))
    rank = f"{name}_rank"
    return (
        named.join(kept, name, "left_semi")
        .withColumn(rank, F.row_number().over(first))
        .where(F.col(rank) == 1)
        .select(*map(quoted, docs.columns))
    )


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the words of benchmark passages; a row that was nothing else goes."""
    small_batches(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _measured(decontaminate.without_passages(docs, benchmark))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with live secrets replaced; values that several sources carry are examples."""
    return _measured(secrets.redacted(docs, PLACEHOLDER))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, lang, source, n_tokens, ids, round_trip)``: every row as ids.

    ``round_trip`` tells whether the ids decode to the text.
    """
    small_batches(spark)

    def make():
        model = sentencepieces.model(PIECES)

        def work(texts: list[str]) -> list[pa.Array]:
            ids = [model.encode(t) for t in texts]
            same = [model.decode(i) == t for i, t in zip(ids, texts)]
            return [
                pa.array([len(i) for i in ids], pa.int64()),
                pa.array(ids, pa.list_(pa.int32())),
                pa.array(same, pa.bool_()),
            ]

        return work

    return map_texts(
        docs, ["doc_id", "lang", "source"], "text", make,
        "n_tokens bigint, ids array<int>, round_trip boolean",
    )
