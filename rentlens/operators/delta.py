"""Spatial joins that are kept up as points and polygons change.

Results are kept by point and polygon, polygons by a hash of their rings. New points meet all polygons, old points meet
new and changed polygons only, and what a removed or changed polygon gave goes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import versions
from ..sources.sinks import settled
from . import spatial

PAIR = "x double, y double, id string, distance_m double"


@dataclass
class State:
    """Points (x, y), polygons (id, hash) and results (x, y, id, distance_m) of the last update; results need a point and a polygon."""

    points: DataFrame
    polygons: DataFrame
    results: DataFrame

    @staticmethod
    def read(spark, path: str) -> State | None:
        at = [versions.table(spark, path, n) for n in ("points", "polygons", "results")]
        return State(*at) if all(t is not None for t in at) else None

    def write(self, spark, path: str) -> State:
        versions.commit(spark, path, {"points": self.points, "polygons": self.polygons, "results": self.results})
        return State.read(spark, path)


@dataclass
class Changes:
    """What differs from the last update: points that are new, points that stay, polygons that are new, ids that are gone or changed."""

    spots: DataFrame
    hashes: DataFrame
    new: DataFrame
    old: DataFrame
    added: DataFrame
    gone: DataFrame


def changes(state: State | None, points: DataFrame, polygons: DataFrame, rings: str) -> Changes:
    spots = settled(points.where("x is not null and y is not null").select("x", "y").distinct())
    whole = polygons.select(F.col("id").cast("string").alias("id"), F.col(rings).alias("rings")).withColumn("hash", F.xxhash64("rings"))
    hashes = settled(whole.select("id", "hash"))
    if state is None:
        return Changes(spots, hashes, spots, spots.limit(0), whole.drop("hash"), hashes.select("id").limit(0))
    added = settled(whole.join(state.polygons, ["id", "hash"], "left_anti").drop("hash"))
    gone = settled(state.polygons.join(hashes, ["id", "hash"], "left_anti").select("id"))
    return Changes(spots, hashes, settled(spots.join(state.points, ["x", "y"], "left_anti")), settled(spots.join(state.points, ["x", "y"], "left_semi")), added, gone)


def _measured(points: DataFrame, polygons: DataFrame, reach: float) -> DataFrame:
    return spatial.polygons_within(points, polygons, "x", "y", "rings", reach).select("x", "y", "id", "distance_m")


def within(state: State | None, points: DataFrame, polygons: DataFrame, reach: float, rings: str = "rings") -> State:
    """The pairs of a point and a polygon no farther than ``reach`` apart, brought up to date.

    points: x, y; polygons: id and rings. Null points have no pairs; ids have to differ.
    """
    c = changes(state, points, polygons, rings)
    whole = polygons.select(F.col("id").cast("string").alias("id"), F.col(rings).alias("rings"))
    found = _measured(c.new, whole, reach)
    if state is not None:
        kept = state.results.join(c.old, ["x", "y"], "left_semi").join(c.gone, "id", "left_anti")
        found = found.unionByName(_measured(c.old, c.added, reach)).unionByName(kept)
    return State(c.spots, c.hashes, settled(found))


def _nearest(points: DataFrame, polygons: DataFrame, reach: float) -> DataFrame:
    named = points.withColumn("spot", F.struct("x", "y"))
    got = spatial.nearest_polygon(named, polygons, "spot", "id", "x", "y", "rings", reach)
    return got.select("spot.x", "spot.y", F.col("nearest").alias("id"), "distance_m")


def nearest(state: State | None, points: DataFrame, polygons: DataFrame, reach: float, rings: str = "rings") -> State:
    """The nearest polygon of each point, ties to the least id, brought up to date. No polygons, no results.

    A point whose nearest polygon is gone or changed is new again; others compare theirs with the added ones.
    """
    c = changes(state, points, polygons, rings)
    whole = polygons.select(F.col("id").cast("string").alias("id"), F.col(rings).alias("rings"))
    if state is None:
        return State(c.spots, c.hashes, settled(_nearest(c.new, whole, reach)))
    valid = settled(state.results.join(c.old, ["x", "y"], "left_semi").join(c.gone, "id", "left_anti"))
    fresh = _nearest(c.spots.join(valid.select("x", "y"), ["x", "y"], "left_anti"), whole, reach)
    closer = _nearest(valid.select("x", "y"), c.added, reach)
    best = valid.unionByName(closer).groupBy("x", "y").agg(F.min(F.struct("distance_m", "id")).alias("b")).select("x", "y", "b.id", "b.distance_m")
    return State(c.spots, c.hashes, settled(fresh.unionByName(best)))


def kept_up(spark, path: str | None, make, *args) -> DataFrame:
    """The results of ``make`` (within or nearest), from the state under ``path``, which becomes its next version."""
    state = make(State.read(spark, path) if path else None, *args)
    return (state.write(spark, path) if path else state).results
