"""Incremental rebuilds: signatures of inputs, a scan cache, a watcher on Structured Streaming."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCANNER_VERSION = 1
LEAST_INTERVAL_S, REFRESH_S = 5, 300


def signature(files: DataFrame, *by: str) -> DataFrame:
    """One row, or one for each group: a hash over (path, size, mtime) in any order, and the number of files."""
    row = F.xxhash64("path", "size", "mtime")
    return files.groupBy(*by).agg(F.count("*").alias("files"), F.bit_xor(row).alias("xor"), F.sum(row.cast("decimal(38,0)")).alias("sum"))


def to_scan(files: DataFrame, cache: DataFrame, version: int = SCANNER_VERSION) -> DataFrame:
    """Files that the cache does not hold as they are, for this version of the scanner."""
    known = cache.where(F.col("version") == version).select("path", "size", "mtime")
    return files.join(known, ["path", "size", "mtime"], "left_anti")


def refreshed(cache: DataFrame, scanned: DataFrame, failed: DataFrame) -> DataFrame:
    """The cache with new scans over old ones; a file that failed keeps its old value, marked to be tried again."""
    old = cache.join(scanned.select("path"), "path", "left_anti")
    again = old.join(failed.select("path", F.lit(True).alias("__f")), "path", "left")
    again = again.withColumn("version", F.when(F.col("__f"), F.lit(-1)).otherwise(F.col("version"))).drop("__f")
    return again.unionByName(scanned)


def due(fetched_at: float | None, now: float, every: float = REFRESH_S) -> bool:
    return fetched_at is None or now - fetched_at >= every


def watch(source: DataFrame, rebuild: Callable[[DataFrame, int], None], checkpoint: str, interval: float = 30.0, once: bool = False, retries: int = 3) -> StreamingQuery:
    """Call ``rebuild`` with each batch of new files; a batch that fails is tried again. Stop with query.stop().

    once: only what is there now. The checkpoint remembers what was seen, so a restart skips it.
    """
    if interval < LEAST_INTERVAL_S:
        raise ValueError(f"the interval has to be {LEAST_INTERVAL_S} s or more")

    def go(batch: DataFrame, number: int) -> None:
        for k in range(retries):
            try:
                return rebuild(batch, number)
            except Exception:
                if k + 1 == retries:
                    raise
                time.sleep(min(2**k, 30))

    writer = source.writeStream.option("checkpointLocation", checkpoint).foreachBatch(go)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{interval} seconds")
    return writer.start()


def ticks(spark: SparkSession) -> DataFrame:
    """A stream that has something new at every look, for watch()."""
    return spark.readStream.format("rate").option("rowsPerSecond", 1).load()


def heartbeat(query: StreamingQuery) -> dict:
    """State, time of the last progress and rows a second of a query."""
    p = query.lastProgress
    return {"state": query.status["message"], "active": query.isActive, "checked_at": p["timestamp"] if p else None, "rows": p["numInputRows"] if p else 0}


def file_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
