"""The whole build: snapshots of listings, permits, parcels and reports to screened tables.

One plan of DataFrames; tables are written at the end, the report last. Sources are never changed: what is out of
scope is written as a table of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coerce, geo, hotels, names, rules, text
from ..operators import candidates, delta, merge, nicknames, screening, spatial
from ..sources import sinks, tables, versions
from ..sources.sinks import settled
from ..streaming import keyed, watch

FIELDS = ("url", "title", "name", "description", "host_name", "host_user_id", "host_profile_url", "rental_type", "property_type", "room_type", "accommodation_type", "location_name", "host_details", "permit_number")
NUMBERS = ("bedrooms", "occupancy", "latitude", "longitude", "privacy_radius_meters")
PERMIT_COLUMNS = ["ObjectId", "Permit #", "Address", "Parcel", "Permit Owner Name", "Permit Subtype Description", "Permit Status", "Expiration Date", "Date Issued", "Longitude", "Latitude"]
RADIUS_M, SCOPE_M, CELL_M = 550.0, 550.0, 500.0


@dataclass
class Inputs:
    """Paths under a root; globs are fine, and what is missing is empty."""

    urls: str = "listing_urls.csv"
    details: str = "listing_details.csv"
    folders: str = "listing_results"
    permits: str = "*permits.csv"
    crosswalk: str = "permit_number_crosswalk.csv"
    boundary: str = "geography/*county*.geojson"
    parcels: str = "Parcels*.geojson"
    hotels: str = "hotels.csv"
    not_hotels: str = "not_hotels.csv"
    names: str = "names.csv"


def permits(spark: SparkSession, root: str, as_of: str, at: Inputs) -> DataFrame:
    raw = tables.csv_table(spark, f"{root}/{at.permits}", PERMIT_COLUMNS)
    rows = raw.select(F.col("ObjectId").alias("object_id"), F.col("Permit #").alias("source_permit_field"), coerce.permit_key(F.col("Permit #")).alias("permit_number"), F.col("Address").alias("address"), F.trim("Parcel").alias("parcel"), F.col("Permit Owner Name").alias("owner"), F.col("Permit Subtype Description").alias("type"), F.col("Permit Status").alias("source_status"), coerce.parse_date(F.col("Expiration Date")).alias("expiration"), coerce.parse_date(F.col("Date Issued")).alias("issued"), coerce.point(F.col("Longitude"), F.col("Latitude")).alias("point"))
    cross = tables.csv_table(spark, f"{root}/{at.crosswalk}", ["object_id", "permit_number", "source_url"])
    cross = cross.select("object_id", coerce.permit_key(F.col("permit_number")).alias("permit_number"), "source_url", F.monotonically_increasing_id().alias("ordinal"))
    rows = merge.with_crosswalk(rows, cross, "object_id")
    status = rules.permit_status(F.col("source_status"), F.col("expiration"), F.lit(as_of).cast("date"))
    return settled(rows.withColumnRenamed("object_id", "id").withColumns({"status": status, "permit_number": F.nullif("permit_number", F.lit(""))}))


def _source(df: DataFrame, get) -> DataFrame:
    return df.select("listing_id", *(get(c).cast("string").alias(c) for c in FIELDS), *(coerce.number(get(c)).cast("string").alias(c) for c in NUMBERS)).where("listing_id is not null")


def scanned(spark: SparkSession, folders: str, cache: str | None = None) -> tuple[DataFrame, DataFrame]:
    """tables.scanned_listings() of folders, and warnings. With a cache only folders that changed, or failed, are opened.

    A folder that fails keeps what it had, and is tried again at the next build.
    """
    files = tables.listing_files(spark, folders)
    now = keyed.folder_signatures(files, "listing_id", watch.SCANNER_VERSION)

    def scan(asked: DataFrame) -> DataFrame:
        rows, bad = tables.scanned_listings(tables.texts_of(files.join(asked, "listing_id", "left_semi"), folders))
        return rows.join(bad.select("listing_id", F.lit(True).alias("failed")), "listing_id", "left").withColumn("failed", F.coalesce("failed", F.lit(False)))

    state = keyed.remembered(now, cache, "scanned", "listing_id", scan)
    return state, state.where("signature is null").select("listing_id", F.lit("metadata is no JSON object").alias("warning"))


def listings(spark: SparkSession, root: str, at: Inputs, cache: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Listings of all sources, what folders changed in the tables' values, and warnings."""
    columns = [*FIELDS, *NUMBERS]
    held = lambda df: lambda c: F.col(c) if c in df.columns else F.lit(None)
    urls = tables.csv_table(spark, f"{root}/{at.urls}", ["url"])
    details = tables.csv_table(spark, f"{root}/{at.details}", ["url", "listing_id"])
    first = [_source(df.withColumn("listing_id", coerce.listing_id(F.col("url"), held(df)("listing_id").cast("string"))), held(df)) for df in (urls, details)]
    found, warnings = scanned(spark, f"{root}/{at.folders}", cache)
    own = _source(found, lambda c: F.col("attrs")[c])
    header = found.select("listing_id", *(F.lit(None).cast("string").alias(c) for c in FIELDS), F.col("occupancy.bedrooms").cast("string").alias("bedrooms"), F.col("occupancy.guests").cast("string").alias("occupancy"), *(F.lit(None).cast("string").alias(c) for c in NUMBERS[2:]))
    reports = [tables.registry(tables.csv_table(spark, f"{root}/{p}", ["url"]), s) for p, s in ((at.hotels, "manual"), (at.not_hotels, "not_hotel"))]
    known = [r.select("listing_id").distinct() for r in reports]
    before = settled(merge.merge_sources(first, "listing_id", columns))
    merged = settled(merge.merge_sources([header, *first, own, *known], "listing_id", columns))  # a header fills what nothing else has
    changes = merge.repairs(before, merged.join(before.select("listing_id"), "listing_id", "left_semi"), "listing_id", columns)
    rows = merged.join(found.select("listing_id", F.col("permits").alias("found"), "amenities", "hotel_text", F.lit(True).alias("text_scanned")), "listing_id", "left")
    rows = rows.join(known[0].withColumn("reported", F.lit(True)), "listing_id", "left").join(known[1].withColumn("tipped", F.lit(True)), "listing_id", "left")
    said = text.permits(text.nfkc(F.concat_ws("\n", "title", "description", F.concat(F.lit("permit "), "permit_number"))))
    rows = rows.withColumn("evidence", F.concat(F.coalesce("found", F.array().cast("array<struct<number:string,raw:string,method:string,evidence:string>>")), said))
    rows = rows.withColumns({c: F.col(c).cast("double") for c in NUMBERS}).withColumns({"permit_numbers": F.array_distinct(F.col("evidence.number")), "point": coerce.point(F.col("longitude"), F.col("latitude"))})
    rows = settled(rows.drop("found"))
    fields = {c: F.coalesce(c, F.lit("")) for c in ("title", "name", "rental_type", "property_type", "room_type", "accommodation_type", "location_name", "description", "host_name", "host_details", "hotel_text")}
    hotel = hotels.classify(fields, F.col("reported"), F.col("tipped"))
    n = rules.license_count(F.size("permit_numbers"), F.col("permit_numbers"))
    rows = rows.withColumns({"hotel": hotel, "licenses": n, "allowed": rules.capacity(F.col("bedrooms"), n), "over_capacity": rules.overage(F.col("bedrooms"), F.col("occupancy"), n), "host_key": coerce.host_key(F.col("host_user_id"), F.col("host_profile_url"), F.col("host_name")), "party": F.coalesce(F.size("amenities") > 0, F.lit(False))})
    return settled(rows), changes, warnings


def projected(rings: Column) -> Column:
    def one(p: Column) -> Column:
        x, y = geo.utm(p[0], p[1])
        return F.array(x, y)

    return F.transform(rings, lambda r: F.transform(r, one))


def build(spark: SparkSession, root: str, as_of: str, at: Inputs | None = None, cache: str | None = None) -> dict[str, DataFrame]:
    """The tables of a build, and its one-row report.

    cache: a folder that remembers scans of unchanged folders, and the distances of unchanged points to unchanged parcels:
    a changed folder, point or parcel costs its own share.
    """
    at = at or Inputs()
    p = permits(spark, root, as_of, at)
    rows, changes, warnings = listings(spark, root, at, cache)
    matched = merge.matched_permits(rows, p.where("permit_number is not null").select("id", "permit_number", "status"))
    rows = rows.join(matched.withColumnRenamed("permits", "matched_permits"), "listing_id", "left")
    statuses = F.coalesce(F.transform("matched_permits", lambda m: m.status), F.array().cast("array<string>"))
    rows = rows.withColumn("status", rules.listing_status(statuses, F.col("permit_numbers")))
    x, y = geo.utm(F.col("point.lon"), F.col("point.lat"))
    rows = settled(rows.withColumns({"x": x, "y": y}))
    if tables.exists(spark, f"{root}/{at.boundary}"):
        edge = tables.geojson(spark, f"{root}/{at.boundary}", ["GEOID"]).select(projected(F.col("rings")).alias("edge"), F.lit(1).alias("__one"))
        if edge.count() != 1:
            raise ValueError("the boundary has to be one feature")
        rows = rows.withColumn("__one", F.lit(1)).join(F.broadcast(edge), "__one")  # one row
        rows = rows.withColumn("boundary_distance_m", F.when(F.col("x").isNotNull(), F.round(geo.signed_edge_distance(F.col("x"), F.col("y"), F.col("edge")), 3))).drop("edge", "__one")
    else:
        rows = rows.withColumn("boundary_distance_m", F.lit(None).cast("double"))
    rows, outside = merge.same_partition(settled(rows), F.col("boundary_distance_m") >= -(SCOPE_M + rules.SLACK))
    out = {"permits": p, "repairs": changes, "warnings": warnings, "out_of_scope": outside, "permit_evidence": rows.select("listing_id", F.explode("evidence").alias("e")).select("listing_id", "e.*")}
    direct = candidates.license_matches(rows.select("listing_id", F.col("matched_permits").alias("permits")), p)
    best = merge.parcel_status(p.where("parcel <> ''"), rules.PARCEL_ORDER)
    if tables.exists(spark, f"{root}/{at.parcels}"):
        paths = tables.manifest_paths(spark, root, fallback=at.parcels)
        parcel = tables.geojson(spark, ",".join(paths) if len(paths) > 1 else paths[0], ["OBJECTID", "STANPAR", "PropAddr", "Owner"])
        parcel = settled(parcel.where("rings is not null").select(F.col("OBJECTID").alias("id"), F.trim("STANPAR").alias("parcel"), F.trim("PropAddr").alias("address"), F.col("Owner").alias("owner"), "rings", projected(F.col("rings")).alias("xy")))
        spots = settled(rows.where("x is not null").select("listing_id", "x", "y", "host_name"))
        held = spatial.containing(spots, parcel.where("address <> ''"), "listing_id", "x", "y", "xy", ["parcel", "address"], 100.0)
        rows = rows.join(held.select("listing_id", F.col("parcel").alias("own_parcel"), F.col("address").alias("own_address")), "listing_id", "left")
        licensed = settled(parcel.join(best.where("status = 'current'").select("parcel"), "parcel", "left_semi"))
        kept = lambda name: f"{cache}/{name}" if cache else None
        near = delta.kept_up(spark, kept("nearest"), delta.nearest, spots, licensed, RADIUS_M, "xy")
        near = spots.join(near, ["x", "y"]).select("listing_id", F.round("distance_m", 3).alias("nearest_licensed_parcel_m"))
        rows = rows.join(near, "listing_id", "left")
        close = delta.kept_up(spark, kept("close"), delta.within, spots, parcel, RADIUS_M, "xy")
        close = settled(spots.join(close, ["x", "y"]).select("listing_id", "id", F.round("distance_m", 3).alias("distance_m"), names.tokens(F.col("host_name")).alias("host_tokens")))
        edges = nicknames.token_map(tables.names(spark, f"{root}/{at.names}"))
        nick = F.create_map(*(v for k, ns in edges.items() for v in (F.lit(k), F.array(*map(F.lit, ns))))) if edges else F.create_map().cast("map<string,array<string>>")
        owned = p.select("parcel", names.tokens(F.col("owner")).alias("owner_tokens"), F.col("id").alias("permit_id"), F.col("id").alias("ordinal"))
        owners = settled(parcel.select("id", "parcel", names.tokens(F.col("owner")).alias("owner_tokens")))
        found = settled(candidates.typed_matches(close, owners, settled(owned), nick).unionByName(direct))
        tile = geo.tile_key(F.col("rings")[0][0][0], F.col("rings")[0][0][1])
        out |= {"parcels": parcel.drop("xy").join(best, "parcel", "left").withColumn("tile", tile)}
    else:
        found = settled(direct)
        rows = rows.withColumn("nearest_licensed_parcel_m", F.lit(None).cast("double"))
    out |= {"matches": found, "property_matches": candidates.reverse_index(found)}
    rows = rows.join(candidates.listing_lists(found), "listing_id", "left")
    rows = rows.withColumn("preliminary_matches", F.filter("matches", lambda m: m.type != "distance"))
    overlap = rules.circle_overlaps(F.col("nearest_licensed_parcel_m"), F.col("privacy_radius_meters"))
    rows = rows.withColumns({"circle_overlaps_parcel": overlap, "likely_unlicensed": rules.likely_unlicensed(F.col("hotel.likely_hotel"), rules.in_scope(F.col("boundary_distance_m")), overlap), "cell_id": F.when(F.col("x").isNotNull(), geo.cell(F.col("x"), F.col("y"), CELL_M))})
    rows = settled(rows)
    auto = candidates.auto_match(rows.select("listing_id", F.col("hotel.likely_hotel").alias("likely_hotel"), F.col("circle_overlaps_parcel").alias("overlap"), "nearest_licensed_parcel_m"), found, best.where("status = 'current'"))
    rows = settled(rows.join(auto, "listing_id"))
    out["listings"] = rows.orderBy("listing_id")
    yes = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    counts = rows.agg(F.count("*").alias("listings"), yes(F.col("point").isNotNull()).alias("mapped"), yes(F.col("hotel.likely_hotel")).alias("hotels"), yes(F.col("text_scanned")).alias("scanned"), yes(F.col("over_capacity") > 0).alias("over_capacity"), yes(F.col("party")).alias("party"), yes(F.size("permit_numbers") > 0).alias("with_permits"), yes(F.col("likely_unlicensed")).alias("likely_unlicensed"), yes(F.col("privacy_radius_meters").isNull()).alias("unknown_radius"))
    by = screening.count_map(rows, "status").withColumnRenamed("counts", "listing_statuses").join(screening.count_map(p, "status").withColumnRenamed("counts", "permit_statuses"))
    out["report"] = counts.join(by).withColumn("as_of", F.lit(as_of))  # rows of one each
    return out


def publish(made: dict[str, DataFrame], output: str, versioned: bool = False) -> None:
    """The tables under ``output``; versioned: as an immutable version there, which a pointer makes the current one."""
    made = dict(made)
    if versioned:
        versions.commit(made["report"].sparkSession, output, {k: sinks.without_nan(v) if k == "report" else v for k, v in made.items()})
        return
    sinks.publish({k: v for k, v in made.items() if k != "report"}, made["report"], output)
