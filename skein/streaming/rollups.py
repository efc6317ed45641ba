"""Structured Streaming: hourly rollups and log tails; each has a batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WATERMARK = "2 hours"


def events_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A stream over a folder of Parquet files, with the schema that they have."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(path)


def hourly(events: DataFrame, at: str = "ts") -> DataFrame:
    """Counts and sums per hour and kind; on a stream hours close two hours late."""
    if events.isStreaming:
        events = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", WATERMARK)
        hour = F.window("_at", "1 hour")["start"]
    else:
        hour = F.window(F.col(at).cast("timestamp"), "1 hour")["start"]
    return events.groupBy(hour.alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum("value"), 4).alias("amount"))


def gauge(samples: DataFrame, at: str = "ts", value: str = "value") -> DataFrame:
    """The last sample of each hour."""
    return samples.groupBy(F.date_trunc("hour", at).alias("hour")).agg(F.max_by(value, F.struct(at, "event_id")).alias(value))


def merge_hours(target: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Counts of a micro-batch added to those that are there."""
    rows = batch if target is None else target.unionByName(batch)
    return rows.groupBy("hour", "event_type").agg(F.sum("lines").alias("lines"), F.round(F.sum("amount"), 4).alias("amount"))


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into a table in memory, for tests and small looks."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
