"""Immutable versions of a set of tables, and one pointer that names the current one.

A version is a folder that is written once. The pointer is a small file that is replaced by one atomic rename, so a
reader finds the old version or the new one, whole, whatever a writer is doing or died doing.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from . import tables as readers

POINTER = "CURRENT"


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _point(spark: SparkSession, path: str, version: str) -> None:
    """Name the current version: written beside, renamed over the old pointer in one step."""
    beside = _path(spark, f"{path}/.{POINTER}-{version}")
    out = _fs(spark, path).create(beside, True)
    out.write(bytearray(version.encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(_fs(spark, path).makeQualified(beside).toUri(), spark._jsc.hadoopConfiguration())
    kind = spark._jvm.org.apache.hadoop.fs.Options.Rename
    over = spark.sparkContext._gateway.new_array(kind, 1)
    over[0] = kind.OVERWRITE
    context.rename(_fs(spark, path).makeQualified(beside), _fs(spark, path).makeQualified(_path(spark, f"{path}/{POINTER}")), over)


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the current version, if there is one."""
    if not readers.exists(spark, f"{path}/{POINTER}"):
        return None
    return f"{path}/{spark.read.text(f'{path}/{POINTER}').first()[0]}"


def table(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """A table of the current version; None where there is no version, or it has no such table."""
    at = current(spark, path)
    return spark.read.parquet(f"{at}/{name}") if at and readers.exists(spark, f"{at}/{name}/_SUCCESS") else None


def commit(spark: SparkSession, path: str, made: dict[str, DataFrame], keep: int = 3) -> str:
    """Write a version and point to it; the ``keep`` newest stay, for readers of an older one. Returns its folder."""
    version = f"v-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    for name, df in made.items():
        df.write.parquet(f"{path}/{version}/{name}")
    _point(spark, path, version)
    fs = _fs(spark, path)
    old = sorted(s.getPath().getName() for s in fs.listStatus(_path(spark, path)) if s.isDirectory() and s.getPath().getName().startswith("v-"))
    for name in old[: -max(keep, 1)]:
        if name != version:
            fs.delete(_path(spark, f"{path}/{name}"), True)
    return f"{path}/{version}"
