"""Streams of events: windowed counts with late data, and node versions appended to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema: str = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string", per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, some files a trigger; ts as a timestamp."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", "*.parquet").parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) by tumbling windows; what comes later than `late` is dropped."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def versions(events: DataFrame, kind: int = 3 * 10**12) -> DataFrame:
    """(rid, ts, data, value): events as node versions."""
    return events.select((F.col("user_id") + kind).alias("rid"), F.unix_micros("ts").alias("ts"), F.col("event_type").alias("data"), "value")


def latest_versions(new: DataFrame) -> DataFrame:
    """The newest version of each node, kept as state; output mode complete or update."""
    best = new.groupBy("rid").agg(F.max(F.struct("ts", "data", "value")).alias("v"))
    return best.select("rid", "v.*")


def append_versions(new: DataFrame, table: str, checkpoint: str):
    """Starts the query that appends versions to a Parquet folder, exactly once a trigger."""
    return new.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
