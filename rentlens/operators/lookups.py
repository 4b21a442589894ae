"""Lookups behind a map: tiles in a view, addresses, records of a property, and places that listings and licences share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import buckets, coerce, geo
from . import spatial

REACH_M = 550.0
#: Tiles of views that are sent to all tasks, at most.
MOST_ASKED = 100_000


def view_tiles(views: DataFrame, tiles: DataFrame, per_degree: int = 100) -> DataFrame:
    """Pairs of a view (west, south, east, north) and a tile (tile: x_y) that it touches."""
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) * per_degree), F.floor(F.col(hi) * per_degree))
    rows = views.withColumn("__x", F.explode(span("west", "east"))).withColumn("__y", F.explode(span("south", "north")))
    return rows.withColumn("tile", F.concat_ws("_", "__x", "__y")).drop("__x", "__y").join(tiles, "tile")


def in_views(views: DataFrame, path: str, lon: str = "lon", lat: str = "lat", per_degree: int = 100) -> DataFrame:
    """Pairs of a view (west, south, east, north) and a point in it, of a table that sinks.write_tiles() wrote.

    The tiles that views touch are known when the table is read: Spark prunes its folders by them as the join runs, so
    files of other tiles are not opened, as long as views touch MOST_ASKED tiles or fewer: more are not sent to all
    tasks. A view that is turned round, or null, holds nothing.
    """
    spark = views.sparkSession
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) * per_degree), F.floor(F.col(hi) * per_degree))
    rows = views.where("west <= east and south <= north").withColumn("__x", F.explode(span("west", "east"))).withColumn("__y", F.explode(span("south", "north")))
    asked = rows.withColumn("tile", F.concat_ws("_", "__x", "__y")).drop("__x", "__y")
    asked = F.broadcast(asked) if asked.limit(MOST_ASKED + 1).count() <= MOST_ASKED else asked
    inside = F.col(lon).between(F.col("west"), F.col("east")) & F.col(lat).between(F.col("south"), F.col("north"))
    return spark.read.parquet(path).join(asked, "tile").where(inside)


def bounds_meet(west, south, east, north, x0, y0, x1, y1) -> Column:
    """Whether two boxes touch."""
    c = lambda v: F.col(v) if isinstance(v, str) else v
    return (c(x0) <= c(east)) & (c(x1) >= c(west)) & (c(y0) <= c(north)) & (c(y1) >= c(south))


def with_neighbor(left: DataFrame, right: DataFrame, metres: float = REACH_M, left_xy=("lon", "lat"), right_xy=("r_lon", "r_lat")) -> DataFrame:
    """Rows of ``left`` with a point of ``right`` within ``metres``."""
    return spatial.with_neighbor(left, right, metres, left_xy, right_xy)


def address_options(options: DataFrame, prefix: str) -> DataFrame:
    """Addresses of candidates.address_index() that start with a prefix; its first character prunes. An empty one finds none."""
    return options.where((F.col("first") == prefix[:1]) & F.startswith("address", F.lit(prefix))).select("address").distinct()


def street_key(address: Column) -> Column:
    """Letters and digits before the first comma, upper case."""
    return F.regexp_replace(F.upper(F.split(F.coalesce(address, F.lit("")), ",")[0]), "[^A-Z0-9]", "")


def address_points(keys: DataFrame, shards: DataFrame, records: DataFrame) -> DataFrame:
    """(key, lon, lat, address) of the records that a key names, in full or by its street, a point once.

    keys: key. shards: candidates.address_index(). records: tile, lon, lat, address.
    """
    asked = keys.select(coerce.squeeze_upper(F.col("key")).alias("address"), "key").withColumn("bucket", buckets.polynomial(F.col("address")))
    tiles = asked.join(shards, ["bucket", "address"]).select("key", F.col("address").alias("__k"), F.explode("tiles").alias("tile"))
    whole = coerce.squeeze_upper(F.col("address"))
    forms = F.array_distinct(F.array(whole, F.trim(F.split(whole, ",")[0])))
    named = records.where("lon is not null and lat is not null").withColumn("__k", F.explode(forms))
    rows = tiles.join(named, ["tile", "__k"])  # by tile alone, every record of a tile would meet every key
    return rows.groupBy("key", "lon", "lat").agg(F.max("address").alias("address"))


def permit_distances(permits: DataFrame, parcels: DataFrame, lon: Column, lat: Column, reach: float = REACH_M) -> DataFrame:
    """Permits no farther than ``reach`` from a point, with distance_m and its basis.

    The nearest boundary of the permit's parcel decides; without one, the permit's own point. permits: id, parcel,
    owner, lon, lat. parcels: parcel, owner, distance_m.
    """
    least = parcels.groupBy("parcel").agg(F.min_by(F.struct(F.col("owner").alias("parcel_owner"), F.col("distance_m").alias("__d")), "distance_m").alias("__p"))
    d = F.coalesce("__p.__d", geo.haversine(lon, lat, F.col("lon"), F.col("lat")))
    rows = permits.join(least, "parcel", "left").withColumn("distance_m", d).where(F.col("distance_m") <= reach)
    basis = F.when(F.col("__p.__d").isNotNull(), "parcel boundary").otherwise("permit point")
    owner = F.coalesce(F.nullif("owner", F.lit("")), F.col("__p.parcel_owner"), F.lit(""))
    return rows.withColumns({"distance_basis": basis, "owner": owner}).drop("__p")


def property_records(properties: DataFrame, permits: DataFrame) -> DataFrame:
    """(id, records, primary): a property's permits by parcel, else by id, in order; the first current one, else the first, is primary.

    properties: id, parcel. permits: id, parcel, status, ordinal.
    """
    p = permits.select(F.col("id").alias("permit_id"), coerce.parcel_key(F.col("parcel")).alias("__k"), "status", "ordinal")
    asked = properties.select("id", coerce.parcel_key(F.col("parcel")).alias("__k"))
    rows = asked.where("__k <> ''").join(p, "__k").drop("__k")
    rows = rows.unionByName(asked.where("__k = ''").drop("__k").join(p.drop("__k").withColumn("id", F.col("permit_id")), "id"))
    rank = F.struct((F.col("status") != "current").cast("int").alias("r"), "ordinal", "permit_id")
    got = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "permit_id"))).alias("r"), F.min_by("permit_id", rank).alias("primary"))
    return got.select("id", F.col("r.permit_id").alias("records"), "primary")


def same_parcel(listings: DataFrame, parcels: DataFrame, size: float = 0.01) -> DataFrame:
    """``listings`` with same_parcel: whether its approximate and actual places are one.

    They are if the points or the streets are equal, or a parcel covers both. listings: listing_id, lon, lat, address,
    actual_lon, actual_lat, actual_address. parcels: rings. Without an actual point it is false.
    """
    ask = listings.select("listing_id", "lon", "lat", "actual_lon", "actual_lat").where("actual_lon is not null and actual_lat is not null")
    held = spatial.polygons_at(ask, parcels.select("rings"), "lon", "lat", "rings", size)
    held = held.where(geo.covers(F.col("lon"), F.col("lat"), F.col("rings")) & geo.covers(F.col("actual_lon"), F.col("actual_lat"), F.col("rings")))
    held = held.select("listing_id", F.lit(True).alias("__held")).distinct()
    street, actual = street_key(F.col("address")), street_key(F.col("actual_address"))
    one = F.coalesce((F.col("lon") == F.col("actual_lon")) & (F.col("lat") == F.col("actual_lat")), F.lit(False))
    known = F.col("actual_lon").isNotNull() & F.col("actual_lat").isNotNull()
    return listings.join(held, "listing_id", "left").withColumn("same_parcel", known & (one | ((street != "") & (street == actual)) | F.coalesce("__held", F.lit(False)))).drop("__held")


def location_features(listings: DataFrame) -> DataFrame:
    """(listing_id, location_kind, points): approximate, actual and the connection of listings whose places differ. See same_parcel()."""
    a, b = F.array("lon", "lat"), F.array("actual_lon", "actual_lat")
    made = F.array(*(F.struct(F.lit(k).alias("location_kind"), p.alias("points")) for k, p in (("approximate", F.array(a)), ("actual", F.array(b)), ("connection", F.array(a, b)))))
    rows = listings.where("not same_parcel and lon is not null and lat is not null and actual_lon is not null and actual_lat is not null")
    return rows.select("listing_id", F.explode(made).alias("f")).select("listing_id", "f.*")


def license_connections(features: DataFrame, listings: DataFrame) -> DataFrame:
    """``features`` (feature_id, url, lon, lat) with the listing_id they belong to: by url, else by point; null without one.

    listings: listing_id, url, lon, lat, ordinal; of several the last counts.
    """
    last = lambda keys: listings.groupBy(*keys).agg(F.max_by("listing_id", "ordinal").alias("__id"))
    by_url = features.where("url <> ''").join(last(["url"]), "url", "left")
    by_point = features.where("url is null or url = ''").join(last(["lon", "lat"]), ["lon", "lat"], "left")
    return by_url.unionByName(by_point).withColumnRenamed("__id", "listing_id")


def grouped_status(rows: DataFrame, status: str, key: str) -> DataFrame:
    """Rows and distinct keys of each status, e.g. of normalised addresses, or matches and files of a scan."""
    return rows.groupBy(status).agg(F.count("*").alias("n"), F.count_distinct(key).alias("keys"))


def sized_groups(df: DataFrame, group: str, order: str) -> DataFrame:
    """``df`` with the size of each row's group and its place in it, from 0."""
    w = Window.partitionBy(group)
    return df.withColumns({"size": F.count("*").over(w), "place": F.row_number().over(w.orderBy(order)) - 1})


def by_distance(rows: DataFrame, key: str, distance: str, address: str) -> DataFrame:
    """(key, addresses) of each key, nearest first, then by address."""
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(distance).alias("d"), F.col(address).alias("a")))), lambda x: x.a).alias("addresses"))


def collated(rows: DataFrame, *names: str) -> DataFrame:
    """Rows in the order that readers expect, whatever case and marks: by the Unicode collation."""
    return rows.orderBy(*(F.collate(F.col(n), "UNICODE") for n in names))
