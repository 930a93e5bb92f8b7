"""Cutting lineage with files that every executor can read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from spark.checkpoint.dir; a local one where none is set and all runs on one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/tamiza-shared"


def own_dir(spark: SparkSession) -> str:
    """The application's folder in the shared one. It goes when the driver ends."""
    at = f"{shared_dir(spark).rstrip('/')}/tamiza-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        fs.mkdirs(path)
    fs.deleteOnExit(path)
    return at


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """The rows as a parquet table in the shared folder; survives the loss of executors."""
    at = f"{own_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    w = df.write.partitionBy(*partition_by) if partition_by else df.write
    w.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def clear(spark: SparkSession) -> None:
    """Removes all tables this application has written; frames read from them end with it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
