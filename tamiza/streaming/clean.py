"""The cleaning chain on a stream: every stage is row-local, so it runs as it is; rows already seen are dropped by id, however late they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tamiza.operators import emotion, intensity
from tamiza.plans.pipeline import annotate


def read(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path)


def new_rows(stream: DataFrame, id_col: str = "id_review") -> DataFrame:
    """One row per id, however late a row or its repeat comes: no watermark, so none is dropped for its time. State is the ids seen, which grow with the table; for many, set RocksDB as the state store."""
    return stream.dropDuplicates([id_col])


def annotated(stream: DataFrame, base: str = "base_emotion") -> DataFrame:
    """Corrected, labelled and graded rows of a stream."""
    return annotate(stream) if base in stream.columns else intensity.with_intensity(emotion.with_emotion(stream.withColumn("base_emotion", F.lit("Neutral"))))


def windowed_counts(stream: DataFrame, time: str = "captured_at", width: str = "1 day", *keys: str) -> DataFrame:
    """Reviews per time window and keys; late rows count whenever they come, so a count is never closed: output mode complete or update. State is one row per window and keys. Rows without a time are in no window."""
    return stream.groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def write(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    w = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once else w).start()
