"""Scores over streams: the same formulas on responses as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Events as a stream of files; ts becomes a timestamp with a zone, as watermarks need."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_agreement(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """By window and user: events, the share of clicks, and the mean value; a window closes when it is ``late`` behind."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", window), "event_type")
        .agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))
        .select(F.col("window.start").alias("start"), "event_type", "n", "mean_value")
    )


def to_table(df: DataFrame, path: str, checkpoint: str):
    """Appends closed windows to Parquet, exactly once by the checkpoint; stops when the input is read."""
    return df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
