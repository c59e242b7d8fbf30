"""Event transitions as they come: windowed edge counts over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of the events' Parquet files."""
    return spark.readStream.schema(schema).parquet(path)


def windowed_counts(events: DataFrame, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """``window, event_type, n, value``: counts by window, closed once the watermark is past."""
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return e.groupBy(F.window("at", length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def append_results(stream: DataFrame, path: str, checkpoint: str):
    """Append finished windows to a table; exactly once by the sink's own log."""
    return stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
