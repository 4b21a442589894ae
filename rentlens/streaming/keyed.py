"""A keyed memory of scans: what has not changed is not scanned again, what failed keeps its value and is tried again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import versions
from ..sources.sinks import settled

#: Columns beside a scan's own: the signature of what was scanned (null: to be tried again) and the run that scanned it.
STATE = ("signature", "run")


def folder_signatures(files: DataFrame, key: str = "folder", version: int = 1) -> DataFrame:
    """(key, signature) over the names, sizes and times of a folder's files, and the scanner's version."""
    row = F.xxhash64("name", "size", "mtime", F.lit(version))
    return files.groupBy(key).agg(F.xxhash64(F.array_sort(F.collect_list(row))).alias("signature"))  # a folder has a few files


def todo(now: DataFrame, state: DataFrame | None, key: str) -> DataFrame:
    """The rows of ``now`` (key, signature) that the state does not hold as they are."""
    if state is None:
        return now
    return now.join(state.where("signature is not null").select(key, "signature"), [key, "signature"], "left_anti")


def update(now: DataFrame, state: DataFrame | None, key: str, scan: Callable[[DataFrame], DataFrame], run: int = 0) -> DataFrame:
    """The next state: a row for each key of ``now`` (key, signature), of the scan's columns, signature and run.

    scan: gets the (key, signature) rows to scan, and returns a row for each with the same columns at every run, and
    ``failed``. A key that failed keeps its old values, if it has some, and loses its signature, so the next update
    tries it again. A key that is gone from ``now`` is forgotten.
    """
    asked = settled(todo(now, state, key))
    got = settled(scan(asked).join(asked, key).withColumn("run", F.lit(run).cast("long")))
    fine = got.where(~F.col("failed")).drop("failed")
    bad = got.where("failed").drop("failed").withColumn("signature", F.lit(None).cast("long"))
    if state is None:
        return fine.unionByName(bad)
    kept = state.join(now.select(key), key, "left_semi").join(fine.select(key), key, "left_anti")
    again = kept.join(bad.select(key, F.lit(True).alias("__again")), key, "left")
    again = again.withColumn("signature", F.when(F.col("__again"), F.lit(None).cast("long")).otherwise(F.col("signature"))).drop("__again")
    return fine.unionByName(again).unionByName(bad.join(kept.select(key), key, "left_anti"))


def remembered(now: DataFrame, path: str | None, name: str, key: str, scan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """update() of the state under ``path``, which becomes its next version; without a path all is scanned."""
    spark = now.sparkSession
    if path is None:
        return settled(update(now, None, key, scan))
    state = versions.table(spark, f"{path}/{name}", "state")
    run = 1 if state is None else 1 + (state.agg(F.max("run")).first()[0] or 0)
    at = versions.commit(spark, f"{path}/{name}", {"state": update(now, state, key, scan, run)})
    return spark.read.parquet(f"{at}/state")
