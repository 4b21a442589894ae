"""Hosts against licence holders nearby, by name and distance. Results are unverified candidates."""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import coerce, names, rules
from ..sources.sinks import settled
from . import spatial
from .candidates import RADIUS_M, WEAK, WEAK_M, strong_enough


def _looked_up(listings: DataFrame, researched: DataFrame) -> DataFrame:
    keys = researched.select(coerce.url_key(F.col("url")).alias("__k"), F.lit(True).alias("__r")).distinct()
    out = listings.withColumn("__k", coerce.url_key(F.col("url"))).join(keys, "__k", "left").drop("__k")
    return out.withColumn("researched", F.col("__r").isNotNull()).drop("__r")


def match_hosts(listings: DataFrame, licenses: DataFrame, researched: DataFrame | None = None, radius: float = RADIUS_M) -> DataFrame:
    """Each listing with its licence candidates within ``radius``, best first, and what the best one says.

    listings: url, host_name, lon, lat. licenses: license_number, business_name, r_lon, r_lat. researched: urls that
    were found unlicensed; those get no match. Each pair of names is classified once; weak matches count only nearby.
    """
    pairs = spatial.within_radius(listings.select("url", "host_name", "lon", "lat"), licenses, radius)
    said = pairs.select("host_name", "business_name").distinct()
    said = said.withColumns({"a": names.normal_name(F.col("host_name")), "b": names.normal_name(F.col("business_name"))})
    said = said.withColumns({"at": names.meaningful(F.col("a")), "bt": names.meaningful(F.col("b"))})
    said = said.select("host_name", "business_name", names.classify(F.col("a"), F.col("b"), F.col("at"), F.col("bt")).alias("m")).where("m is not null")
    found = pairs.join(said, ["host_name", "business_name"]).where(strong_enough(F.col("m.match_type"), F.col("distance_m")))
    order = F.struct((-F.col("m.score")).alias("s"), "distance_m", "license_number", "business_name", "m")
    ranked = found.groupBy("url").agg(F.array_sort(F.collect_list(order)).alias("c"))
    ranked = ranked.withColumn("candidates", F.transform("c", lambda x: F.struct(x.license_number.alias("license_number"), x.business_name.alias("business_name"), x.m.match_type.alias("match_type"), x.m.confidence.alias("confidence"), x.m.score.alias("score"), F.round(x.distance_m, 1).alias("distance_m"), (x.distance_m <= 1000).alias("within_1km"))))
    best = F.col("candidates")[0]
    out = listings.join(ranked.drop("c"), "url", "left")
    if researched is not None:
        out = _looked_up(out, researched)
        out = out.withColumn("candidates", F.when(~F.col("researched"), F.col("candidates")))
    return out.select("*", best["match_type"].alias("match_type"), best["score"].alias("score"), best["distance_m"].alias("distance_m"), rules.distance_band(best["distance_m"]).alias("distance_band"), F.coalesce(F.size("candidates"), F.lit(0)).alias("candidate_count"))


def best_matches(listings: DataFrame, licenses: DataFrame, researched: DataFrame | None = None, radius: float = RADIUS_M) -> DataFrame:
    """match_hosts() without the lists: the best candidate's match_type, score, distance_m and band, and how many there are.

    Pairs are counted in the task that finds them, by listing and business name, so none is shuffled or held. Between
    equal scores and distances of one listing the least business name counts.
    """
    def counted(a, b, i, j, d):
        codes = b["business_name"].combine_chunks().dictionary_encode()
        code = pc.fill_null(codes.indices, len(codes.dictionary)).to_numpy(zero_copy_only=False)
        both, at, inverse, n = np.unique(i * (len(codes.dictionary) + 1) + code[j], return_index=True, return_inverse=True, return_counts=True)
        least = np.full(len(both), np.inf)
        np.minimum.at(least, inverse, d)
        near = np.bincount(inverse, d <= WEAK_M, len(both)).astype(np.int64)
        return {"url": a["url"].take(i[at]).combine_chunks(), "host_name": a["host_name"].take(i[at]).combine_chunks(), "business_name": b["business_name"].take(j[at]).combine_chunks(), "n": n, "n_near": near, "d": least}

    seen = spatial.folded(listings.select("url", "host_name", "lon", "lat"), licenses.select("business_name", "r_lon", "r_lat"), radius, counted, "url string, host_name string, business_name string, n long, n_near long, d double")
    seen = settled(seen.groupBy("url", "host_name", "business_name").agg(F.sum("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("d").alias("d")))
    said = seen.select("host_name", "business_name").distinct()
    said = said.withColumns({"a": names.normal_name(F.col("host_name")), "b": names.normal_name(F.col("business_name"))})
    said = said.withColumns({"at": names.meaningful(F.col("a")), "bt": names.meaningful(F.col("b"))})
    said = said.select("host_name", "business_name", names.classify(F.col("a"), F.col("b"), F.col("at"), F.col("bt")).alias("m")).where("m is not null")
    # The nearest of a name lies within WEAK_M if any does.
    count = F.when(F.col("m.match_type").isin(*WEAK), F.col("n_near")).otherwise(F.col("n"))
    found = seen.join(said, ["host_name", "business_name"]).withColumn("k", count).where("k > 0")
    best = F.min(F.struct((-F.col("m.score")).alias("s"), "d", "business_name", "m")).alias("best")
    out = listings.join(found.groupBy("url").agg(best, F.sum("k").cast("int").alias("candidate_count")), "url", "left")
    shown = F.col("best").isNotNull()
    if researched is not None:
        out, shown = _looked_up(out, researched), shown & ~F.col("researched")
    distance = F.when(shown, F.round("best.d", 1))
    return out.select(
        *listings.columns, *(["researched"] if researched is not None else []), F.when(shown, F.col("best.m.match_type")).alias("match_type"), F.when(shown, F.col("best.m.score")).alias("score"),
        distance.alias("distance_m"), rules.distance_band(distance).alias("distance_band"), F.when(shown, F.col("candidate_count")).otherwise(0).alias("candidate_count"),
    )


def match_histogram(matched: DataFrame) -> DataFrame:
    return matched.groupBy(F.coalesce("match_type", F.lit("none")).alias("match_type")).agg(F.count("*").alias("n"))


def matched_names(left: DataFrame, right: DataFrame, host: str, business: str) -> DataFrame:
    """(host, business, match_type, confidence, score) of the distinct normal names that names.classify() matches.

    Names meet by the keys of their tokens, and pairs are judged once; names without a meaningful token match nothing.
    """
    keyed = lambda df, c, is_host: df.select(F.col(c).alias("name")).distinct().withColumn("tokens", names.meaningful(F.col("name"))).withColumn("key", F.explode(names.pair_keys(F.col("tokens"), is_host)))
    a, b = keyed(left, host, True), keyed(right, business, False)
    a, b = (df.select("key", F.col("name").alias(c)) for df, c in ((a, "h"), (b, "b")))
    pairs = a.join(b, "key").select("h", "b").distinct()
    found = names.classify(F.col("h"), F.col("b"), names.meaningful(F.col("h")), names.meaningful(F.col("b")))
    return pairs.withColumn("__m", found).where("__m is not null").select(F.col("h").alias(host), F.col("b").alias(business), "__m.*")
