"""Written tables that cut lineage, in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only where one JVM is all there is (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="rentlens-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Later plans then depend on files that every executor can read, not on shuffle output that goes with a lost
    executor, and a plan that uses the rows twice computes them once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_written: list[str] = []


def clear(spark: SparkSession) -> int:
    """Delete what store() has written so far, once no result that reads it is needed any more; how many tables that were."""
    for path in (gone := _written[:]):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        _written.remove(path)
    return len(gone)


def partitions(spark: SparkSession, size: float = 0, each: float = 1) -> int:
    """Parts to deal rows to: as the session says, and enough for ``each`` of ``size`` a part."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(-(-size // each)))


def columns(df: DataFrame, without: tuple[str, ...] = ()) -> list[Column]:
    """The columns of ``df``, whatever their names, but for some."""
    gone = {n.lower() for n in without}
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c.lower() not in gone]


def as_row(df: DataFrame, without: tuple[str, ...] = ()) -> Column:
    """All columns as one struct ``row``: no name of theirs can meet a name that an operator needs."""
    return F.struct(*columns(df, without)).alias("row")
