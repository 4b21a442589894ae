"""Ranked candidates of listings, and their reverse index by parcel. Candidates are unverified; all are kept."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import buckets, coerce, names, rules
from ..sources.sinks import settled
from . import spatial

#: Ranks of kinds of match; matches that count only within WEAK_M.
WEAK = ("partial_name_match", "fuzzy_one_name_match")
WEAK_M, RADIUS_M = 500.0, 1100.0


def typed_matches(candidates: DataFrame, properties: DataFrame, permits: DataFrame, nicknames: Column) -> DataFrame:
    """(listing_id, parcel, type, distance_m, permit_ids) of candidates (listing_id, id, distance_m, host tokens).

    The type is what the owner's name gives, else distance; the first permit of the parcel (by ordinal) whose owner
    matches replaces it, with permit_ before. permit_ids are all of the parcel's; parcels match by letters and digits.
    Candidates without a property are left out.
    """
    named = candidates.join(properties.select("id", "parcel", F.col("owner_tokens")), "id")
    kind = F.coalesce(names.name_match(F.col("host_tokens"), F.col("owner_tokens"), nicknames), F.lit("distance"))
    rows = named.select("listing_id", "id", "parcel", "distance_m", "host_tokens", kind.alias("kind"))
    plain = F.regexp_replace("parcel", "[^0-9A-Za-z]", "")
    known = permits.select(plain.alias("__k"), F.col("owner_tokens").alias("permit_owner"), "permit_id", "ordinal")
    hits = rows.withColumn("__k", plain).join(known, "__k")
    hits = hits.withColumn("m", names.name_match(F.col("host_tokens"), F.col("permit_owner"), nicknames))
    first = F.min_by("m", F.when(F.col("m").isNotNull(), F.col("ordinal")))
    hits = hits.groupBy("listing_id", "id").agg(first.alias("m"), F.array_sort(F.collect_set("permit_id")).alias("permit_ids"))
    out = rows.join(hits, ["listing_id", "id"], "left")
    return out.select("listing_id", "parcel", F.coalesce(F.concat(F.lit("permit_"), "m"), "kind").alias("type"), "distance_m", "permit_ids")


#: Kinds of names.name_match() by number; those of permits come after them.
_KINDS = ("distance", "owner_name", "owner_first_name", "owner_nickname")


def typed_near(listings: DataFrame, properties: DataFrame, permits: DataFrame, nicknames: dict[str, list[str]], metres: float, columns: tuple[str, ...] = ("parcel",), digits: int = 3) -> DataFrame:
    """(listing_id, ``columns``, type, distance_m) like typed_matches(), of all ``properties`` within ``metres`` of each listing.

    listings: listing_id, lon, lat, host_tokens. properties: parcel, r_lon, r_lat, owner_tokens, and what ``columns``
    names; permit_ids can be among them. nicknames: small, it goes to all tasks. Permits are looked up before properties
    are paired. Pairs leave the task that finds them; a name is judged once for all pairs that have it at that step.
    """
    plain = F.regexp_replace("parcel", "[^0-9A-Za-z]", "")
    held = F.transform(F.array_sort(F.collect_list(F.when(F.col("ordinal").isNotNull(), F.struct("ordinal", F.col("owner_tokens").alias("t"))))), lambda x: x.t)
    owned = permits.groupBy(plain.alias("__k")).agg(held.alias("__held"), F.array_sort(F.collect_set("permit_id")).alias("permit_ids"))
    found = properties.withColumn("__k", plain).join(owned, "__k", "left")
    names_of = F.concat(F.array("owner_tokens"), F.coalesce("__held", F.array().cast("array<array<string>>")))
    right = found.select(*dict.fromkeys(columns), "r_lon", "r_lat", F.to_json(names_of).alias("__names"))
    left = listings.select("listing_id", "lon", "lat", F.to_json("host_tokens").alias("__host"))
    types = {f.name: f.dataType.simpleString() for df in (left, right) for f in df.schema}
    schema = ", ".join(f"`{c}` {types[c]}" for c in ("listing_id", *columns)) + ", __kind int, distance_m double"

    def typed(a, ready, i, j, d):
        b, owners, at = ready
        hosts = a["__host"].combine_chunks().dictionary_encode()
        kinds = owners.kinds([h and json.loads(h) for h in hosts.dictionary.to_pylist()])
        host = hosts.indices.fill_null(len(hosts.dictionary)).to_numpy()  # the last row of kinds is that of no host
        return {"listing_id": a["listing_id"].take(i).combine_chunks(), **{c: b[c].take(j).combine_chunks() for c in columns}, "__kind": kinds[host[i], at[j]], "distance_m": spatial.rounded(d, digits)}

    def ready(b):
        rows = b["__names"].combine_chunks().dictionary_encode()
        return b, names.Owners([json.loads(x) for x in rows.dictionary.to_pylist()], nicknames), rows.indices.to_numpy()

    pairs = spatial.folded(left, right, metres, typed, schema, ready=ready, parts=spatial.PARTS)
    kind = F.element_at(F.array(*map(F.lit, (*_KINDS, *(f"permit_{k}" for k in _KINDS[1:])))), F.col("__kind") + 1)
    return pairs.select("listing_id", *columns, kind.alias("type"), "distance_m")


def license_matches(matched: DataFrame, permits: DataFrame) -> DataFrame:
    """Rows like typed_matches() for the permits that a listing's own numbers name. matched: merge.matched_permits()."""
    pairs = matched.select("listing_id", F.explode("permits.id").alias("permit_id")).join(permits.select(F.col("id").alias("permit_id"), "parcel"), "permit_id")
    return pairs.select("listing_id", "parcel", F.lit("license_number").alias("type"), F.lit(None).cast("double").alias("distance_m"), F.array("permit_id").alias("permit_ids"))


def auto_match(listings: DataFrame, matches: DataFrame, current: DataFrame, near_m: float = rules.TOLERANCE_M) -> DataFrame:
    """(listing_id, auto_status) of rules.auto_match_status().

    listings: listing_id, likely_hotel, overlap, nearest_licensed_parcel_m. matches: listing_id, type, parcel; only
    those by an owner's name count. current: parcel, of the current permits.
    """
    k = coerce.parcel_key(F.col("parcel"))
    has = current.select(k.alias("__k"), F.lit(True).alias("has")).where("__k <> ''").distinct()
    named = matches.where(F.contains("type", F.lit("owner_"))).select("listing_id", k.alias("__k")).where("__k <> ''").join(has, "__k", "left")
    found = named.groupBy("listing_id").agg(F.bool_or(F.col("has").isNotNull()).alias("yes"), F.bool_or(F.col("has").isNull()).alias("no"))
    near = F.coalesce("overlap", F.lit(False)) | F.coalesce(F.col("nearest_licensed_parcel_m") <= near_m, F.lit(False))
    return listings.join(found, "listing_id", "left").select("listing_id", rules.auto_match_status(F.col("likely_hotel"), F.col("yes"), F.col("no"), near).alias("auto_status"))


def kind_rank(kind: Column) -> Column:
    """A licence number first, then a name, then distance."""
    return F.when(kind == "license_number", 0).when(kind != "distance", 1).otherwise(2)


def listing_lists(matches: DataFrame) -> DataFrame:
    """Matches of each listing: those by distance last, then nearest, then by parcel; unknown distances first."""
    order = F.struct((F.col("type") == "distance").cast("int").alias("far"), F.coalesce("distance_m", F.lit(-1.0)).alias("d"), "parcel", "type")
    return matches.groupBy("listing_id").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: F.struct(x.type.alias("type"), x.parcel.alias("parcel"), F.when(x.d >= 0, x.d).alias("distance_m"))).alias("matches"))


def reverse_index(matches: DataFrame) -> DataFrame:
    """Listings of each parcel: licence numbers, names, distances; unknown distances last. With the shard of the parcel."""
    order = F.struct(kind_rank(F.col("type")).alias("rank"), F.coalesce("distance_m", F.lit(float("inf"))).alias("d"), "listing_id", "type")
    listed = matches.where("parcel <> ''").groupBy("parcel").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: F.struct(x.listing_id.alias("listing_id"), x.type.alias("type"), F.when(x.d < float("inf"), x.d).alias("distance_m"))).alias("listings"))
    return listed.withColumn("bucket", buckets.sha_prefix(F.col("parcel")))


def best_of(scored: DataFrame, key: str, score: str = "score", distance: str = "distance_m", columns: tuple[str, ...] = ()) -> DataFrame:
    """The candidate of the highest score, nearest first, then of the least ``columns``, and how many there are."""
    best = F.min_by(F.struct(score, distance, *columns), F.struct((-F.col(score)).alias("s"), F.col(distance).alias("d"), *columns))
    return scored.groupBy(key).agg(best.alias("b"), F.count("*").alias("candidate_count")).select(key, "b.*", "candidate_count")


def best_near(left: DataFrame, right: DataFrame, key: str, metres: float, score: str, columns: tuple[str, ...] = (), digits: int = 3) -> DataFrame:
    """best_of() of all points of ``right`` within ``metres`` of each row of ``left``, by the score that ``right`` has.

    Distances are rounded to ``digits``; among equal scores and distances the least ``columns`` count. Rows of a key
    are one candidate list. Pairs stay in the task that finds them.
    """
    types = {f.name: f.dataType.simpleString() for df in (left, right) for f in df.schema}
    schema = ", ".join(f"`{c}` {t}" for c, t in ((key, types[key]), (score, "double"), ("distance_m", "double"), *((c, types[c]) for c in columns), ("candidate_count", "long")))

    def best(a, b, i, j, d):
        points, d = b[score].to_numpy(), np.round(d, digits)
        at = spatial.first_rows(-points[j], d, i=i)
        n = np.diff(np.append(np.flatnonzero(np.diff(i, prepend=-1)), len(i)))
        return {key: a[key].take(i[at]).combine_chunks(), score: points[j[at]], "distance_m": d[at], **{c: b[c].take(j[at]).combine_chunks() for c in columns}, "candidate_count": n}

    found = spatial.folded(left, right, metres, best, schema, columns)
    first = F.min(F.struct((-F.col(score)).alias("s"), "distance_m", *columns)).alias("b")
    return found.groupBy(key).agg(first, F.sum("candidate_count").alias("candidate_count")).select(key, (-F.col("b.s")).alias(score), "b.distance_m", *(f"b.{c}" for c in columns), "candidate_count")


def lists_near(left: DataFrame, right: DataFrame, key: str, item: str, metres: float, rank: str | None = None, digits: int = 3) -> DataFrame:
    """(key, items): the items of all points of ``right`` within ``metres`` of each row of ``left``, by rank, distance and item.

    Distances are rounded to ``digits``. A list is made in the task that finds its pairs; only keys of several rows have
    their pairs shuffled.
    """
    schema = f"`{key}` {left.schema[key].dataType.simpleString()}, items array<{right.schema[item].dataType.simpleString()}>"

    def listed(a, b, i, j, d):
        level = np.unique(b[rank].to_numpy(), return_inverse=True)[1] if rank else np.zeros(b.num_rows, np.int64)
        step = np.rint(d * 10**digits).astype(np.int64)
        parts = (i, level[j], step, j)
        bits = [int(p.max()).bit_length() for p in parts]
        if sum(bits) < 63:  # one number a pair; sorting it sorts them all
            packed = parts[0].astype(np.int64)
            for p, n in zip(parts[1:], bits[1:], strict=True):
                packed = packed << n | p
            packed.sort()
            order = packed & ((1 << bits[3]) - 1)
        else:
            order = j[np.lexsort((j, step, level[j], i))]
        starts = np.flatnonzero(np.diff(i, prepend=-1))
        items = b[item].combine_chunks().take(order)
        return {key: a[key].take(i[starts]).combine_chunks(), "items": pa.ListArray.from_arrays(np.append(starts, len(i)).astype(np.int32), items)}

    many = settled(left.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.col(key).alias("__k")))
    if many.isEmpty():
        return spatial.folded(left, right, metres, listed, schema, (item,))
    same = F.col(key).eqNullSafe(F.col("__k"))
    once = spatial.folded(left.join(many, same, "left_anti"), right, metres, listed, schema, (item,))
    pairs = spatial.within_radius(left.join(many, same, "left_semi"), right, metres)
    order = F.struct((F.col(rank) if rank else F.lit(0)).alias("r"), F.round("distance_m", digits).alias("d"), F.col(f"`{item}`").alias("i"))
    return once.unionByName(pairs.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x.i).alias("items")))


def strong_enough(kind: Column, distance: Column) -> Column:
    return ~kind.isin(*WEAK) | (distance <= WEAK_M)


def address_index(tiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of (tile, address): the tiles of each address by shard, and the addresses by first character."""
    from ..functions.coerce import squeeze_upper

    rows = tiles.select("tile", squeeze_upper(F.col("address")).alias("address")).where("address <> ''")
    shards = rows.groupBy("address").agg(F.array_sort(F.collect_set("tile")).alias("tiles")).withColumn("bucket", buckets.polynomial(F.col("address")))
    options = rows.select(F.substring("address", 1, 1).alias("first"), "address").distinct()
    return shards, options
