"""Intermediate tables in the folder the cluster shares for checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where unset in local mode, a fresh folder.

    A cluster has to name one, as no folder of a single machine would do.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context_dir = spark.sparkContext.getCheckpointDir()
    if context_dir:
        return context_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="timberline-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def _application_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/timberline-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{_application_folder(spark)}/{name}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Remove the intermediate tables of this application.

    Frames that read them, models that were not saved among them, are of no use after.
    """
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_application_folder(spark))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(target, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as Parquet and read it back.

    This cuts the lineage, survives the loss of executors and gives later joins the real
    size of the frame, so Spark broadcasts it when it is below
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles it when it is not.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
