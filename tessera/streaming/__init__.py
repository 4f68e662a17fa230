"""Streams (an extension: the reference has none)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text


def events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of Parquet files with an event time ``ts`` of any timestamp kind."""
    rows = spark.readStream.schema(schema).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by window and event_type; rows later than ``late`` are dropped once their window is closed."""
    counted = stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n")


def tag_counts(captions: DataFrame) -> DataFrame:
    """Running counts of normalised tags over a stream of (key, text)."""
    rows = captions.select(F.explode(text.comma_list(F.col("text"))).alias("tag"))
    return rows.groupBy(text.normal_tag(F.col("tag")).alias("tag")).agg(F.count(F.lit(1)).alias("n"))


def run_once(frame: DataFrame, name: str, mode: str, checkpoint: str) -> StreamingQuery:
    """Drains what is there into a table in memory, for tests and small reports."""
    query = frame.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
