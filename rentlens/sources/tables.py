"""Readers. A missing input is an empty table with its schema; ids stay strings."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions.coerce import before_marker, number, pin, text_of_keys
from .sinks import settled

#: A metadata entry is scanned if its key holds one of these.
SCANNED = ("description", "title", "registration", "license", "permit", "amenit", "rule")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob has anything, in whatever store Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def csv_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Strings by the header's names, with quoted newlines; missing columns are null, other columns stay."""
    if not exists(spark, path):
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    df = df.toDF(*(c.removeprefix("﻿").strip() for c in df.columns))
    return df.select("*", *(F.lit(None).cast("string").alias(c) for c in columns if c not in df.columns))


def whole_files(spark: SparkSession, *globs: str) -> DataFrame:
    """(path, folder, name, size, mtime, text) of whole text files; folder and name are the path's last two parts."""
    have = [g for g in globs if exists(spark, g)]
    if not have:
        return spark.createDataFrame([], "path string, folder string, name string, size long, mtime timestamp, text string")
    df = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "false").load(have)
    path = F.col("_metadata.file_path")
    return df.select(path.alias("path"), F.element_at(F.split(path, "/"), -2).alias("folder"), F.element_at(F.split(path, "/"), -1).alias("name"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("mtime"), F.col("value").alias("text"))


_FILES = ("metadata.json", "details.txt", "description.txt")
#: Paths that are read by name; more are read as their folders, and then chosen.
BY_NAME = 10_000


def _in_order(files: DataFrame, *columns: str) -> DataFrame:
    order = F.array_position(F.array(*map(F.lit, _FILES)), F.col("name"))
    return files.where(F.col("folder").rlike(r"^\d+$")).select(F.col("folder").alias("listing_id"), order.alias("ordinal"), *columns)


def listing_folders(spark: SparkSession, *roots: str) -> DataFrame:
    """(listing_id, ordinal, name, size, mtime, text): the files of folders named by digits.

    ordinal: metadata.json, details.txt, description.txt, in that order.
    """
    return _in_order(whole_files(spark, *_folder_globs(roots)), "name", "size", "mtime", "text")


def _folder_globs(roots: tuple[str, ...]) -> list[str]:
    return [f"{r}/*/{{{','.join(_FILES)}}}" for r in roots]


def listing_files(spark: SparkSession, *roots: str) -> DataFrame:
    """(listing_id, ordinal, path, name, size, mtime) of the same files; none is opened."""
    have = [g for g in _folder_globs(roots) if exists(spark, g)]
    if not have:
        return spark.createDataFrame([], "listing_id string, ordinal long, path string, name string, size long, mtime timestamp")
    df = spark.read.format("binaryFile").load(have).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    parts = F.split("path", "/")
    return _in_order(df.withColumns({"folder": F.element_at(parts, -2), "name": F.element_at(parts, -1)}), "path", "name", "size", "mtime")


def texts_of(files: DataFrame, *roots: str) -> DataFrame:
    """listing_folders() of some of listing_files(): few are opened by name, of many the folders are read and chosen from."""
    spark = files.sparkSession
    paths = [r[0] for r in files.select("path").limit(BY_NAME + 1).collect()]
    if len(paths) <= BY_NAME:
        return _in_order(whole_files(spark, *paths), "name", "size", "mtime", "text")
    return listing_folders(spark, *roots).join(files.select("listing_id", "name"), ["listing_id", "name"], "left_semi")


def scanned_listings(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(listing_id, attrs, hotel_text, occupancy, permits, amenities) of listing_folders(), and (listing_id, warning) of bad JSON.

    Header attributes, then metadata's, which win. Of the files in order: a permit's first evidence, an amenity's last.
    Metadata is scanned where a key says text or permits (SCANNED), other files up to the host's details; hotel_text
    has those whole.
    """
    kind = T.MapType(T.StringType(), T.StringType())
    rows = files.withColumn("meta", F.when(F.col("name") == "metadata.json", F.from_json("text", kind)))
    bad = rows.where((F.col("name") == "metadata.json") & (F.col("meta").isNull() | ~F.ltrim("text").startswith("{"))).select("listing_id", F.lit("metadata is no JSON object").alias("warning"))
    attrs = F.when(F.col("name") == "metadata.json", F.col("meta")).when(F.col("name") == "details.txt", tx.header(F.col("text")))
    plain = F.when(F.col("name") == "metadata.json", F.coalesce(text_of_keys(F.col("meta"), SCANNED, keyed=True), F.lit(""))).otherwise(before_marker(F.col("text")))
    told = F.struct("ordinal", F.concat(F.lit("\n"), "text").alias("text"))
    narrative = files.where("name <> 'metadata.json'").groupBy("listing_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(told)), lambda w: w.text), "").alias("hotel_text"))
    rows = settled(rows.select("listing_id", "ordinal", attrs.alias("attrs"), plain.alias("plain"))).withColumn("plain", tx.nfkc(F.col("plain")))  # read three times below
    rows = rows.select("listing_id", "ordinal", "attrs", tx.occupancy(F.col("plain")).alias("occupancy"), tx.permits(F.col("plain")).alias("permits"), tx.amenities(F.col("plain")).alias("amenities"))
    prefer = F.when(F.col("attrs").isNotNull(), -F.col("ordinal"))  # metadata over header
    entries = rows.select("listing_id", prefer.alias("p"), F.explode("attrs")).groupBy("listing_id", "key").agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.col("p"))).alias("value"))
    folded = entries.groupBy("listing_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("attrs"))
    permits = rows.select("listing_id", "ordinal", F.posexplode("permits").alias("i", "p")).groupBy("listing_id", F.col("p.number").alias("number")).agg(F.min_by("p", F.struct("ordinal", "i")).alias("p"))
    permits = permits.groupBy("listing_id").agg(F.array_sort(F.collect_list("p")).alias("permits"))
    found = rows.select("listing_id", "ordinal", F.explode("amenities")).groupBy("listing_id", "key").agg(F.max_by("value", "ordinal").alias("value"))
    found = found.groupBy("listing_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("amenities"))
    guests = rows.groupBy("listing_id").agg(F.max_by("occupancy", F.when(F.col("occupancy").isNotNull(), F.col("ordinal"))).alias("occupancy"))
    return guests.join(narrative, "listing_id", "left").join(folded, "listing_id", "left").join(permits, "listing_id", "left").join(found, "listing_id", "left"), bad


RINGS = "array<array<array<double>>>"


def geojson(spark: SparkSession, path: str, properties: list[str]) -> DataFrame:
    """Properties as strings, with rings (of all polygons of a feature) or point; features without geometry stay."""
    raw = spark.read.format("text").option("wholetext", "true").load(path)
    schema = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    f = raw.select(F.explode(F.from_json("value", schema)["features"]).alias("f"))
    kind, at = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    rings = F.when(kind == "Polygon", F.from_json(at, RINGS)).when(kind == "MultiPolygon", F.flatten(F.from_json(at, f"array<{RINGS}>")))
    point = F.when(kind == "Point", F.from_json(at, "array<double>"))
    return f.select(*(F.col("f.properties")[p].alias(p) for p in properties), rings.alias("rings"), point.alias("point"))


def boundary(spark: SparkSession, path: str, geoid: str) -> DataFrame:
    """The one feature with its GEOID; anything else is an error."""
    rows = geojson(spark, path, ["GEOID"])
    found = rows.take(2)
    if len(found) != 1 or found[0]["GEOID"] != geoid:
        raise ValueError(f"the boundary has to be one feature of GEOID {geoid}")
    return rows


def manifest_paths(spark: SparkSession, root: str, manifest: str = "parcel_chunks.json", fallback: str = "Parcels*.geojson") -> list[str]:
    """Chunk paths of a manifest, else what the fallback matches, sorted, the first only."""
    if exists(spark, f"{root}/{manifest}"):
        text = spark.read.format("text").option("wholetext", "true").load(f"{root}/{manifest}").first()[0]
        return [f"{root}/{p['path'] if isinstance(p, dict) else p}" for p in json.loads(text)["parts"]]
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{fallback}")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []
    return sorted(str(s.getPath()) for s in found)[:1]


def js_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the first array literal in a script, as JSON; the script is never run."""
    raw = spark.read.format("text").option("wholetext", "true").load(path)
    literal = F.regexp_extract("value", r"(?s)=\s*(\[.*\])\s*;?", 1)
    return raw.select(F.explode(F.from_json(literal, f"array<struct<{schema}>>")).alias("r")).select("r.*")


def points(rows: DataFrame, lon: str, lat: str) -> DataFrame:
    """Rows with finite coordinates, as doubles."""
    return rows.withColumns({lon: number(F.col(lon)), lat: number(F.col(lat))}).where(F.col(lon).isNotNull() & F.col(lat).isNotNull())


def registry(rows: DataFrame, source: str, url: str = "url") -> DataFrame:
    """(listing_id, source, hotel_name, proof_url, address, notes): a row for each id in a cell."""
    have = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in ("hotel_name", "proof_url", "address", "notes")]
    return rows.select(F.explode(tx.room_ids(F.col(url))).alias("listing_id"), F.lit(source).alias("source"), *have)


def names(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed (name1, relationship, name2) of a CSV with that header."""
    return csv_table(spark, path, ["name1", "relationship", "name2"]).select(*(F.trim(c).alias(c) for c in ("name1", "relationship", "name2")))


def licensed_parcels(parcels: DataFrame, licenses: DataFrame, parcel_pin: str = "PIN", license_pin: str = "Parcel_PIN") -> DataFrame:
    """Parcels whose number a licence has; blank numbers match nothing."""
    known = licenses.select(pin(F.col(license_pin)).alias("__p")).where("__p <> ''").distinct()
    return parcels.withColumn("__p", pin(F.col(parcel_pin))).join(known, "__p", "left_semi").drop("__p")


def renamed(df: DataFrame, names: dict[str, str], defaults: tuple[str, ...] = ()) -> DataFrame:
    """Columns renamed; a new name that exists is an error; missing defaults are null."""
    if clash := [b for a, b in names.items() if a in df.columns and b in df.columns]:
        raise ValueError(f"both old and new columns exist: {clash}")
    df = df.withColumnsRenamed(names)
    return df.withColumns({c: F.lit(None).cast("string") for c in defaults if c not in df.columns})


def shard(spark: SparkSession, path: str, bucket: str, value: str) -> DataFrame:
    """One shard of what sinks.write_sharded() wrote; a missing path is an error, a missing shard has no rows."""
    return spark.read.json(path).where(F.col(bucket).cast("string") == value).drop(bucket)  # only that folder is read


def inspected(df: DataFrame, *by: str) -> DataFrame:
    """(rows, columns, first): how many rows there are, the columns' names and types, and one row as JSON; of each group, if asked."""
    kinds = F.array(*(F.lit(f"{f.name} {f.dataType.simpleString()}") for f in df.schema.fields))
    found = df.groupBy(*by).agg(F.count("*").alias("rows"), F.min(F.to_json(F.struct(*df.columns))).alias("first"))
    return found.select(*by, "rows", kinds.alias("columns"), "first")
