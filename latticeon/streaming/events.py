"""Windowed counts of an event stream, with late data dropped after a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(events: DataFrame, width: str = "1 day", lateness: str | None = "1 hour", time: str = "ts") -> DataFrame:
    """Count and sum per event type and tumbling window; streaming or batch."""
    e = events.withWatermark(time, lateness) if lateness and events.isStreaming else events
    return e.groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def windowed_stream(spark: SparkSession, schema, folder: str, files: str, name: str, lateness: str = "1 hour", **how) -> DataFrame:
    """The same over files that a stream reads, as a table of the windows so far: what is there now is read, then the stream ends."""
    events = spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder)
    time = how.get("time", "ts")
    events = events.withColumn(time, F.col(time).cast("timestamp"))  # a watermark needs that type
    writer = windowed(events, lateness=lateness, **how).writeStream.format("memory").queryName(name).outputMode("complete")  # a row per window and type
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).withColumn("start", F.col("start").cast(schema[time].dataType))
