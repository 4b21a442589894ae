"""Outlines of unions, depths of overlaps, and inner points, distributed by edge and by pair.

A union's outline is what is left of its polygons' edges once those that two neighbours share have cancelled: a sum by
edge. The rest is chained to rings by pointer jumping, so a long outline takes rounds of joins, not one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..sources.sinks import settled

YARD_M = 0.9144
#: Pairs of shapes whose depths a task remembers, about.
KNOWN = 50_000


def _signed_area(ring: Column) -> Column:
    at = F.sequence(F.lit(0), F.size(ring) - 2)
    return F.aggregate(at, F.lit(0.0), lambda s, i: s + ring[i][0] * ring[i + 1][1] - ring[i + 1][0] * ring[i][1]) / 2


def edges(polygons: DataFrame, group: str, rings: str) -> DataFrame:
    """(group, ax, ay, bx, by): the outline of each group's union, as edges that have the inside on their left.

    The polygons of a group may share edges and corners, corner to corner, and otherwise not overlap; rings repeat
    their first point at the end, the first of a polygon is its outside, the others are holes. Which way they turn
    does not matter. Edges without length go, and null polygons have none.
    """
    ring = polygons.select(F.col(group).alias("group"), F.posexplode(rings).alias("n", "ring")).where("size(ring) > 3").withColumn("area", _signed_area(F.col("ring")))
    turned = F.when((F.col("area") > 0) == (F.col("n") == 0), F.col("ring")).otherwise(F.reverse("ring"))
    pairs = ring.select("group", turned.alias("r")).select("group", "r", F.explode(F.sequence(F.lit(0), F.size("r") - 2)).alias("i"))
    e = pairs.select("group", F.struct(F.col("r")[F.col("i")][0].alias("x"), F.col("r")[F.col("i")][1].alias("y")).alias("a"), F.struct(F.col("r")[F.col("i") + 1][0].alias("x"), F.col("r")[F.col("i") + 1][1].alias("y")).alias("b")).where("a <> b")
    # Both ways along an edge are one key; neighbours go it in opposite ways, which cancel.
    summed = e.groupBy("group", F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q")).agg(F.sum(F.when(F.col("a") < F.col("b"), 1).otherwise(-1)).alias("way")).where("way <> 0")
    a, b = F.when(F.col("way") > 0, F.col("p")).otherwise(F.col("q")), F.when(F.col("way") > 0, F.col("q")).otherwise(F.col("p"))
    return summed.select("group", a.alias("a"), b.alias("b")).select("group", F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by")).withColumnRenamed("group", group)


def measures(outline: DataFrame, group: str) -> DataFrame:
    """(group, area, length) of edges(): no ring has to be known for them."""
    return outline.groupBy(group).agg((F.sum(F.expr("ax * by - bx * ay")) / 2).alias("area"), F.sum(F.expr("hypot(bx - ax, by - ay)")).alias("length"))


def dissolved(polygons: DataFrame, group: str, rings: str) -> DataFrame:
    """(group, ring, area): the rings of each group's union, closed; outsides have a positive area, holes a negative one.

    See edges() for what the polygons have to be. Where rings touch in a corner the way goes to the left, so a ring
    does not meet itself. Each round doubles the edges that a chain spans; a ring begins at its least corner.
    """
    e = edges(polygons, group, rings).select(F.col(group).alias("group"), F.struct("ax", "ay").alias("a"), F.struct("bx", "by").alias("b"))
    e = settled(e.withColumn("id", F.struct("a", "b")))
    out = e.select(F.col("group").alias("g"), F.col("a").alias("at"), F.col("id").alias("next"), F.col("b").alias("to"))
    met = e.join(out, e["group"].eqNullSafe(F.col("g")) & (F.col("b") == F.col("at")))
    dx, dy = F.col("b.bx") - F.col("a.ax"), F.col("b.by") - F.col("a.ay")
    ex, ey = F.col("to.bx") - F.col("b.bx"), F.col("to.by") - F.col("b.by")
    turn = F.atan2(dx * ey - dy * ex, dx * ex + dy * ey)
    step = met.groupBy("group", "id").agg(F.max_by("next", turn).alias("next"))
    step = settled(step.withColumns({"least": F.least("id", "next"), "span": F.lit(1)}))
    while True:  # the least edge of each ring: what a chain of span edges has seen
        far = step.select(F.col("group").alias("g"), F.col("id").alias("via"), F.col("next").alias("on"), F.col("least").alias("seen"))
        wide = step.join(far, step["group"].eqNullSafe(F.col("g")) & (F.col("next") == F.col("via")))
        new = settled(wide.select("group", "id", F.col("on").alias("next"), F.least("least", "seen").alias("least"), (F.col("span") * 2).alias("span")))
        if new.join(step.select(F.col("group").alias("g"), F.col("id").alias("o"), F.col("least").alias("was")), new["group"].eqNullSafe(F.col("g")) & (F.col("id") == F.col("o"))).where("least <> was").isEmpty():
            break
        step = new
    # Places in the ring: the way from each edge on to the ring's least one, which ends there.
    first = met.groupBy("group", "id").agg(F.max_by("next", turn).alias("next"))
    named = new.select("group", "id", F.col("least").alias("ring"))
    both = first["group"].eqNullSafe(named["group"]) & (first["id"] == named["id"])
    rank = first.join(named, both).select(first["group"], first["id"], "next", "ring")
    rank = settled(rank.withColumns({"next": F.when(F.col("next") != F.col("ring"), F.col("next")), "left": F.lit(1)}))
    while not rank.where("next is not null").isEmpty():
        far = rank.select(F.col("group").alias("g"), F.col("id").alias("via"), F.col("next").alias("on"), F.col("left").alias("more"))
        wide = rank.join(far, rank["group"].eqNullSafe(F.col("g")) & (F.col("next") == F.col("via")), "left")
        rank = settled(wide.select("group", "id", F.col("on").alias("next"), "ring", (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")))
    point = lambda c: F.array(f"{c}.ax", f"{c}.ay")
    corners = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("left")).alias("k"), point("id.a").alias("p")))), lambda x: x.p)
    made = rank.groupBy("group", "ring").agg(corners.alias("points")).select("group", F.concat("points", F.slice("points", 1, 1)).alias("ring"))
    return made.select(F.col("group").alias(group), "ring", _signed_area(F.col("ring")).alias("area"))


def _distances(x: np.ndarray, y: np.ndarray, rings: list[np.ndarray]) -> np.ndarray:
    """Distances to the nearest edge, positive inside (even-odd)."""
    best, inside = np.full(len(x), np.inf), np.zeros(len(x), bool)
    for r in rings:
        for (ax, ay), (bx, by) in zip(r[:-1], r[1:], strict=True):
            dx, dy = bx - ax, by - ay
            size = dx * dx + dy * dy
            t = np.clip(((x - ax) * dx + (y - ay) * dy) / size, 0, 1) if size else 0.0
            best = np.minimum(best, np.hypot(x - ax - t * dx, y - ay - t * dy))
            if ay != by:
                inside ^= ((ay > y) != (by > y)) & (x < dx * (y - ay) / dy + ax)
    return np.where(inside, best, -best)


def deepest(a: list, b: list, within: float) -> tuple[float, float, float] | None:
    """(depth, x, y): the point of polygon ``a`` that lies deepest in polygon ``b``, to ``within``; None if they do not meet.

    Best-first refinement: squares over the boxes' overlap are cut in four while one may hold a point of ``a`` that is
    deeper than the best so far; a distance changes by no more than the way to a square's corner.
    """
    a, b = ([np.array([tuple(p) for p in r], float) for r in ([] if rings is None else rings) if len(r) > 3] for rings in (a, b))
    if not a or not b:
        return None
    lo, hi = np.maximum(a[0].min(0), b[0].min(0)), np.minimum(a[0].max(0), b[0].max(0))
    if (lo > hi).any():
        return None
    corners = np.concatenate(a)
    own = _distances(corners[:, 0], corners[:, 1], b)
    best, at = float(own.max()), corners[int(own.argmax())]
    half = max(float((hi - lo).max()) / 2, within / 4)
    x, y = np.array([(lo[0] + hi[0]) / 2]), np.array([(lo[1] + hi[1]) / 2])
    while len(x):
        mine, depth, reach = _distances(x, y, a), _distances(x, y, b), half * 2**0.5
        inner = np.flatnonzero(mine >= 0)
        if len(inner) and depth[inner].max() > best:
            k = inner[int(depth[inner].argmax())]
            best, at = float(depth[k]), np.array([x[k], y[k]])
        stay = (mine >= -reach) & (depth + reach > max(best + within, 0.0))
        if half < within / 4:
            break
        half /= 2
        x, y = (np.concatenate([c[stay] + s * half for s in signs]) for c, signs in ((x, (-1, 1, -1, 1)), (y, (-1, -1, 1, 1))))
    return (best, float(at[0]), float(at[1])) if best >= 0 else None


def _shapes(polygons: pa.Array) -> list[bytes | None]:
    """Of each polygon, what tells equal ones: the numbers of its rings and points, and the coordinates."""
    rings = polygons.flatten()
    points = rings.flatten()
    sized = [pc.fill_null(pc.list_value_length(a), -1).to_numpy(zero_copy_only=False).astype(np.int32) for a in (polygons, rings, points)]
    xy = pc.fill_null(points.flatten(), float("nan")).to_numpy(zero_copy_only=False)
    ends = [np.concatenate([[0], np.cumsum(np.maximum(n, 0))]) for n in sized]
    out: list[bytes | None] = []
    for i, n in enumerate(sized[0]):
        r0, r1 = ends[0][i], ends[0][i + 1]
        p0, p1 = ends[1][r0], ends[1][r1]
        out.append(None if n < 0 else b"".join((sized[0][i : i + 1].tobytes(), sized[1][r0:r1].tobytes(), sized[2][p0:p1].tobytes(), xy[ends[2][p0] : ends[2][p1]].tobytes())))
    return out


def _measured(batches: Iterable[pa.RecordBatch], rings: str, other: str, within: float) -> Iterator[pa.RecordBatch]:
    known: dict[tuple, tuple] = {}
    for batch in batches:
        if len(known) > KNOWN:
            known.clear()
        found = []
        for i, pair in enumerate(zip(*(_shapes(batch.column(c)) for c in (rings, other)), strict=True)):
            if pair not in known:
                known[pair] = deepest(*(batch.column(c)[i].as_py() for c in (rings, other)), within) or (None, None, None)
            found.append(known[pair])
        deep, x, y = zip(*found, strict=True) if found else ((), (), ())
        made = ([None if v is None else v / YARD_M for v in deep], x, y)
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, pa.float64()) for v in made)], names=[*batch.schema.names, "depth_yards", "deep_x", "deep_y"])


def depths(pairs: DataFrame, rings: str, other: str, within: float = YARD_M / 4) -> DataFrame:
    """``pairs`` with depth_yards, deep_x, deep_y: how far polygon ``rings`` reaches into ``other`` at its deepest; null where they do not meet.

    One pair is one row, wherever it lies; polygons are in metres. The depth is right to ``within`` metres. Equal pairs
    of shapes are measured once a task, as long as it remembers them.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema) + ", depth_yards double, deep_x double, deep_y double"

    return pairs.mapInArrow(lambda batches: _measured(batches, rings, other, within), schema)


def inner_point(rings: Column) -> Column:
    """struct(x, y): the middle of the widest stretch that lies inside, on the line half-way between the corners' heights.

    Null for polygons without area. The line avoids all corners, so it crosses edges only.
    """

    # Each step is bound to a name by a lambda: written out in place of it, the heights would be sorted anew at each use.
    let = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))

    def of(r: Column) -> Column:
        heights = F.array_sort(F.array_distinct(F.transform(F.flatten(r), lambda p: p[1])))
        return let(heights, lambda hs: let((F.element_at(hs, 1) + F.element_at(hs, -1)) / 2, lambda middle: at_height(r, hs, middle)))

    def at_height(r: Column, heights: Column, middle: Column) -> Column:
        low = F.array_max(F.filter(heights, lambda h: h <= middle))
        high = F.array_min(F.filter(heights, lambda h: h > middle))
        return let((low + high) / 2, lambda y: let(crossed(r, y), lambda spans: let(F.array_max(spans), lambda widest: F.when(widest.wide > 0, F.struct(widest.x.alias("x"), y.alias("y"))))))

    def crossed(r: Column, y: Column) -> Column:
        cross = lambda s: F.when((s.a[1] > y) != (s.b[1] > y), s.a[0] + (y - s.a[1]) * (s.b[0] - s.a[0]) / (s.b[1] - s.a[1]))
        crosses = F.array_sort(F.filter(F.transform(F.flatten(F.transform(r, geo._segments)), cross), lambda x: x.isNotNull()))
        pair = lambda xs, i: F.struct((F.get(xs, i + 1) - F.get(xs, i)).alias("wide"), ((F.get(xs, i) + F.get(xs, i + 1)) / 2).alias("x"))
        return let(crosses, lambda xs: F.transform(F.sequence(F.lit(0), F.greatest(F.size(xs) - 2, F.lit(0)), F.lit(2)), lambda i: pair(xs, i)))

    return let(rings, of)
