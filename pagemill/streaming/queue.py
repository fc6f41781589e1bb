"""The job queue and heartbeats as streams: each run takes what has come since the last, and ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def counts_by_window(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Jobs and users of each window; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def drain(spark: SparkSession, source: str, schema, sink: str, checkpoint: str) -> None:
    """Moves new job records of a folder to the sink, each once, and stops."""
    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
