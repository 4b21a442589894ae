"""Writers."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nested_as_json(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, for CSV."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*(F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields))


def write_csv(df: DataFrame, path: str) -> None:
    nested_as_json(df).write.mode("overwrite").csv(path, header=True, escape='"')


def write_sharded(df: DataFrame, path: str, bucket: str) -> None:
    """JSON by shard, one task a shard."""
    df.repartition(bucket).write.mode("overwrite").partitionBy(bucket).json(path)


def write_chunks(df: DataFrame, path: str, records: int) -> None:
    df.write.mode("overwrite").option("maxRecordsPerFile", records).json(path)


def write_archive(df: DataFrame, path: str, per_part: int = 250) -> None:
    """Rows out of scope, in files of at most ``per_part``; sources stay where they are."""
    write_chunks(df, path, per_part)


def write_tiles(df: DataFrame, path: str, tile: str = "tile") -> None:
    """Rows in a folder for each tile, so that readers open the tiles that they ask for; a crowded tile has several files."""
    df.hint("rebalance", F.col(tile)).write.mode("overwrite").partitionBy(tile).parquet(path)


def key_union(df: DataFrame, cells: str, fields: list[str] | None = None) -> DataFrame:
    """One column for each key that any row's map has, in order, or for each of ``fields``; other keys are ignored.

    The keys of a table's maps are its header: they go to the driver.
    """
    names = fields or sorted(r[0] for r in df.select(F.explode(F.map_keys(cells))).distinct().collect())
    return df.select(*(c for c in df.columns if c != cells), *(F.try_element_at(cells, F.lit(n)).alias(n) for n in names))


def without_nan(df: DataFrame) -> DataFrame:
    """``df``, which fails where a number is not finite: JSON has none such."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    return df.withColumns({c: F.when(bad(F.col(c)), F.raise_error(F.lit(f"{c} is not finite"))).otherwise(F.col(c)) for c in floats})


def publish(tables: dict[str, DataFrame], report: DataFrame, path: str) -> None:
    """Tables first, written beside the old ones and swapped in, the report last: it marks a complete publication.

    The old report goes before the first swap, so that whoever finds a report finds its tables.
    """
    spark = report.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    made = {**tables, "report": report.coalesce(1)}
    beside = f"{path}/.next-{uuid.uuid4().hex}"
    for name, df in made.items():
        without_nan(df).write.json(f"{beside}/{name}") if name == "report" else df.write.parquet(f"{beside}/{name}")
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(fs_path(f"{path}/report"), True)
    for name in made:
        fs.delete(fs_path(f"{path}/{name}"), True)
        if not fs.rename(fs_path(f"{beside}/{name}"), fs_path(f"{path}/{name}")):
            raise OSError(f"cannot replace {path}/{name}")
    fs.delete(fs_path(beside), True)


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file, written beside and renamed over the old one."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    target, part = fs_path(path), fs_path(path + ".part")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"cannot replace {path}")


def feature_collection(df: DataFrame, geometry: str, kind: str = "Polygon") -> DataFrame:
    """(value): a GeoJSON feature a row; the other columns are its properties."""
    rest = [c for c in df.columns if c != geometry]
    shape = F.struct(F.lit(kind).alias("type"), F.col(geometry).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*rest).alias("properties"), shape.alias("geometry"))).alias("value"))


def checksums(df: DataFrame, part: str, value: str) -> DataFrame:
    """(part, rows, sha256) over each part's values in order."""
    return df.groupBy(part).agg(F.count("*").alias("rows"), F.sha2(F.array_join(F.array_sort(F.collect_list(value)), "\n"), 256).alias("sha256"))


def oversized(files: DataFrame, most: int = 100 * 1024 * 1024) -> DataFrame:
    """Files (path, size) over a limit."""
    return files.where(F.col("size") > most).select("path", "size")


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only where one JVM is all there is (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="rentlens-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def settled(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the folder of ``spark.checkpoint.dir`` and read back: one computation, a short plan."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_written: list[str] = []


def clear(spark: SparkSession) -> int:
    """Delete what settled() has written so far, once nothing reads it any more; how many tables that were."""
    for path in (gone := _written[:]):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        _written.remove(path)
    return len(gone)


def memoised(spark: SparkSession, folder: str | None, name: str, key: object, make) -> DataFrame:
    """What ``make`` returns, written under the hash of ``key``: a later build of the same inputs reads it. No folder, no memory.

    A result that was not written to its end lacks its mark and is made again.
    """
    if folder is None:
        return settled(make())
    path = f"{folder}/{name}-{hashlib.sha256(repr(key).encode()).hexdigest()[:24]}"
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
