"""Incremental arrival: event-time windows with a watermark, each event once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reconweave.stages import Stages


def windowed(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums of each event type in each window; repeated event ids count once.

    events: ts, event_id, event_type, value, batch or stream.  On a stream, events
    later than `late` are dropped and state older than that is freed.
    """
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])
    out = once.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "events", "total")


def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as a stream until its end, and the windows it leaves.

    Each batch writes the windows that it changed under its number, so a batch that is
    tried again writes the same place; the last word on a window counts.  The watermark
    frees windows and ids that are over.
    """
    stages = Stages(spark, "stream")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    query = (
        windowed(stream)
        .writeStream.outputMode("update")
        .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{stages.root}/windows/batch={n}"))
        .option("checkpointLocation", f"{stages.root}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return merged(spark.read.parquet(f"{stages.root}/windows"))


def merged(windows: DataFrame) -> DataFrame:
    """day, event_type, events, total of the last batch that changed each window."""
    last = windows.groupBy("day", "event_type").agg(F.max_by(F.struct("events", "total"), "batch").alias("x"))
    return last.select("day", "event_type", "x.*")
