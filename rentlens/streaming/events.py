"""Event-time queries on the events table, beyond what polling needs: deduplication and tumbling counts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import shared_dir


def _drain(df: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there and return its rows as a table in the shared folder."""
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = df.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/rows")


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(events: DataFrame, late: str = "30 days") -> DataFrame:
    """The first row of every event id, as long as it comes no later than ``late``."""
    return _drain(events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]), "append")


def tumbling(events: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts by window and type of the windows that are closed."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"))
    return _drain(rows.select(F.col("window.start").alias("start"), "event_type", "n"), "append")
