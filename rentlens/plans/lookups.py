"""Queries on tiles, addresses, properties' records and places."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import geo, labels
from ..operators import candidates, lookups
from ..sources import sinks
from .fixtures import POINTS, points
from .registry import query, table

_CUSTOMERS = "SELECT c_custkey, (c_custkey % 97) / 100.0 + 0.003 AS lon, (c_custkey % 53) / 100.0 + 0.004 AS lat FROM customer"


def _customers(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", ((k % 97) / 100.0 + 0.003).alias("lon"), ((k % 53) / 100.0 + 0.004).alias("lat"))


@query(f"""WITH c AS ({_CUSTOMERS}), v AS (SELECT s_suppkey, (s_suppkey % 90) / 100.0 + 0.005 AS west, (s_suppkey % 50) / 100.0 + 0.005 AS south FROM supplier)
SELECT s_suppkey, count(*) AS n FROM v JOIN c ON floor(lon * 100) BETWEEN floor(west * 100) AND floor((west + 0.02) * 100) AND floor(lat * 100) BETWEEN floor(south * 100) AND floor((south + 0.01) * 100) GROUP BY 1""")
def view_tile_counts(spark, sf_dir):
    k = F.col("s_suppkey")
    west, south = (k % 90) / 100.0 + 0.005, (k % 50) / 100.0 + 0.005
    views = table(spark, sf_dir, "supplier").select("s_suppkey", west.alias("west"), south.alias("south"), (west + 0.02).alias("east"), (south + 0.01).alias("north"))
    tiles = _customers(spark, sf_dir).select(geo.tile_key(F.col("lon"), F.col("lat")).alias("tile")).groupBy("tile").agg(F.count("*").alias("held"))
    return lookups.view_tiles(views, tiles).groupBy("s_suppkey").agg(F.sum("held").alias("n"))


def _addresses(spark, sf_dir):
    return _customers(spark, sf_dir).select((F.col("c_custkey") % 20).alias("tile"), "lon", "lat", F.concat(F.lower("c_mktsegment"), F.lit(" "), F.col("c_nationkey").cast("string"), F.lit(", X")).alias("address"))


@query(f"""WITH c AS ({_CUSTOMERS}), a AS (SELECT DISTINCT upper(c_mktsegment) || ' ' || c_nationkey || ', X' AS address, lon, lat FROM c JOIN customer USING (c_custkey))
SELECT address AS key, count(*) AS n, round(sum(lon), 6) AS lon, round(sum(lat), 6) AS lat FROM a GROUP BY 1""")
def address_key_points(spark, sf_dir):
    records = _addresses(spark, sf_dir)
    shards, options = candidates.address_index(records)
    keys = options.select(F.col("address").alias("key")).distinct()
    return lookups.address_points(keys, shards, records).groupBy("key").agg(F.count("*").alias("n"), F.round(F.sum("lon"), 6).alias("lon"), F.round(F.sum("lat"), 6).alias("lat"))


@query("SELECT DISTINCT upper(c_mktsegment) || ' ' || c_nationkey || ', X' AS address FROM customer WHERE starts_with(upper(c_mktsegment) || ' ' || c_nationkey, 'BUILDING 1')")
def address_prefix_options(spark, sf_dir):
    return lookups.address_options(candidates.address_index(_addresses(spark, sf_dir))[1], "BUILDING 1")


@query("""SELECT o_custkey AS id, list(o_orderkey ORDER BY o_orderdate, o_orderkey) AS records,
  first(o_orderkey ORDER BY (o_orderstatus <> 'O')::INT, o_orderdate, o_orderkey) AS "primary" FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def property_permit_records(spark, sf_dir):
    properties = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("P-"), "c_custkey").alias("parcel"))
    status = F.when(F.col("o_orderstatus") == "O", "current").otherwise("expired")
    permits = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("p "), "o_custkey").alias("parcel"), status.alias("status"), F.col("o_orderdate").alias("ordinal"))
    return lookups.property_records(properties, permits)


@query("""WITH b AS (SELECT l_partkey - l_partkey % 3 AS l_partkey, min(l_quantity)::DOUBLE * 20 AS d FROM lineitem GROUP BY 1)
SELECT p_partkey AS id, round(coalesce(d, 6371008.8 * radians(p_size / 10000.0)), 3) AS distance_m, CASE WHEN d IS NULL THEN 'permit point' ELSE 'parcel boundary' END AS distance_basis
FROM part LEFT JOIN b ON l_partkey = p_partkey WHERE coalesce(d, 6371008.8 * radians(p_size / 10000.0)) <= 550""")
def permit_boundary_distances(spark, sf_dir):
    permits = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("parcel"), F.lit("").alias("owner"), F.lit(0.0).alias("lon"), (F.col("p_size") / 10000.0).alias("lat"))
    parcels = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") - F.col("l_partkey") % 3).alias("parcel"), F.lit("o").alias("owner"), (F.col("l_quantity").cast("double") * 20).alias("distance_m"))
    return lookups.permit_distances(permits, parcels, F.lit(0.0), F.lit(0.0)).select("id", F.round("distance_m", 3).alias("distance_m"), "distance_basis")


@query("""WITH c AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'equal' WHEN 1 THEN 'street' WHEN 2 THEN 'parcel' WHEN 3 THEN 'apart' ELSE 'none' END AS k FROM customer)
SELECT c_custkey AS listing_id, f.location_kind FROM c, (VALUES ('approximate'), ('actual'), ('connection')) f(location_kind) WHERE k = 'apart'""")
def location_feature_rows(spark, sf_dir):
    c, k = _customers(spark, sf_dir), F.col("c_custkey") % 5
    x, y = F.floor(F.col("lon") * 100) / 100.0, F.floor(F.col("lat") * 100) / 100.0
    move = F.when(k == 0, 0.0).when(k == 2, 0.001).when(k < 4, 0.01)
    rows = c.select(F.col("c_custkey").alias("listing_id"), "lon", "lat", F.lit("1 Oak St, X").alias("address"), (F.col("lon") + move).alias("actual_lon"), F.col("lat").alias("actual_lat"), F.when(k == 1, "1 OAK ST.").otherwise("2 Elm St").alias("actual_address"))
    parcels = c.select(x.alias("x"), y.alias("y")).distinct().select(geo.box(F.col("x"), F.col("y"), F.col("x") + 0.0099, F.col("y") + 0.0099).alias("rings"))
    return lookups.location_features(lookups.same_parcel(rows, parcels)).select("listing_id", "location_kind")


@query("""WITH k(type, label, color) AS (VALUES ('license_number', 'License number', '#166534'), ('permit_owner_nickname', 'Permit owner / host nickname', '#7e22ce'),
  ('owner_first_name', 'Owner / host first name', '#a16207'), ('owner_name', 'Full owner / host name', '#1d4ed8'), ('distance', 'Distance only', '#475569'))
SELECT label, color, count(*) AS n FROM lineitem JOIN k ON type = CASE l_linenumber % 5 WHEN 0 THEN 'license_number' WHEN 1 THEN 'permit_owner_nickname' WHEN 2 THEN 'owner_first_name' WHEN 3 THEN 'owner_name' ELSE 'distance' END GROUP BY ALL""")
def match_badges(spark, sf_dir):
    n = F.col("l_linenumber") % 5
    kind = F.when(n == 0, "license_number").when(n == 1, "permit_owner_nickname").when(n == 2, "owner_first_name").when(n == 3, "owner_name").otherwise("distance")
    rows = table(spark, sf_dir, "lineitem").select(labels.match_label(kind).alias("label"), labels.match_color(kind).alias("color"))
    return rows.groupBy("label", "color").agg(F.count("*").alias("n"))


@query(f"""WITH {POINTS}, v AS (SELECT n_nationkey, -86.85 + n_nationkey * 0.005 AS west, 36.10 + (n_nationkey % 6) * 0.02 AS south FROM nation WHERE n_nationkey % 3 = 1)
SELECT n_nationkey, vec_id FROM v JOIN p ON lon BETWEEN west AND west + 0.008 AND lat BETWEEN south AND south + 0.008""")
def points_in_views(spark, sf_dir):
    """Points of the views of some nations, from a table by tiles of which only theirs are opened."""
    path = f"{sinks.shared_dir(spark)}/tiles-{uuid.uuid4().hex}"
    p = points(spark, sf_dir)
    sinks.write_tiles(p.withColumn("tile", geo.tile_key(F.col("lon"), F.col("lat"))), path)
    west, south = F.lit(-86.85) + F.col("n_nationkey") * 0.005, F.lit(36.10) + (F.col("n_nationkey") % 6) * 0.02
    views = table(spark, sf_dir, "nation").where("n_nationkey % 3 = 1").select("n_nationkey", west.alias("west"), south.alias("south"), (west + 0.008).alias("east"), (south + 0.008).alias("north"))
    return lookups.in_views(views, path).select("n_nationkey", "vec_id")
