"""Event-time windows over the events table, as a batch or as a stream (an extension; the operators are Spark's own)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their value by window and type; works on batches and streams alike."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.session_window("at", gap), "user_id").agg(F.count("*").alias("n"))


def read_events(spark: SparkSession, directory: str) -> DataFrame:
    """A stream of the Parquet files of a directory, with the schema of those there now."""
    schema = spark.read.parquet(directory).schema
    return spark.readStream.schema(schema).parquet(directory)
