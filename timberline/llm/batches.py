"""Running a function of whole texts over Arrow batches."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Makes the function that turns a list of texts into result columns; called once a task.
Maker = Callable[[], Callable[[list[str]], Sequence[pa.Array]]]


def show_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did.

    Of use where it is on the driver's path only; an installed package is found without it.
    """
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Let whole texts travel between the JVM and Python in batches of so many rows at most.

    Both sides hold a batch and what is made of it outside the heap and keep that room for later, so
    a chain of stages over texts needs less with smaller ones. A smaller setting is left alone.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now > rows or now <= 0:
        spark.conf.set(name, rows)


_HELD: dict[str, object] = {}


def held(label: str, make: Callable[[], object]):
    """What ``make`` returns, kept for the next tasks of the worker until another label is asked for."""
    if label not in _HELD:
        _HELD.clear()
        _HELD[label] = make()
    return _HELD[label]


def quoted(name: str) -> str:
    """A column by exactly this name, also with a dot in it."""
    return "`" + name.replace("`", "``") + "`"


def slices(batches: Iterable[pa.RecordBatch], rows: int = 400) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few texts are Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    pa.default_memory_pool().release_unused()


def map_texts(
    frame: DataFrame, key: str | Sequence[str], text: str, make: Maker, schema: str
) -> DataFrame:
    """One row per row: the key and what ``make()`` returns for the text, null read as "".

    A single key is taken as a long; several columns are carried as they are. Only they and the
    text leave the JVM, so other columns of any name do no harm. Batches are bounded by Spark's
    Arrow settings; nothing is kept between them but what ``make`` keeps.
    """
    show_package(frame.sparkSession)
    if isinstance(key, str):
        keys = frame.select(F.col(key).cast("long").alias(key))
    else:
        keys = frame.select(*key)
    fields = keys.schema.fields
    full = T.StructType([*fields, *T.StructType.fromDDL(schema).fields])
    picked = frame.select(
        *(F.col(f.name).cast(f.dataType).alias(f"key{i}") for i, f in enumerate(fields)),
        F.col(text).cast("string").alias("text"),
    )

    def run(batches):
        work = make()
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(len(fields)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(fields)], *work(texts)], names=full.names
            )

    return picked.mapInArrow(run, full)
