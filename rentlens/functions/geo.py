"""Geometry as column expressions: distances, projection, polygons as arrays of rings of [x, y], grids."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371008.8
#: UTM zone 16 on GRS80: central meridian, scale, false easting, semi-major axis, flattening.
UTM16 = (-87.0, 0.9996, 500000.0, 6378137.0, 1 / 298.257222101)


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres on a sphere."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def utm_series(zone=UTM16) -> tuple[float, float, tuple[float, ...]]:
    """Radius of the rectifying sphere, eccentricity, and coefficients, to the fourth order in the third flattening."""
    *_, a, f = zone
    n = f / (2 - f)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    return a / (1 + n) * (1 + n**2 / 4 + n**4 / 64), 2 * math.sqrt(n) / (1 + n), alpha


def utm(lon: Column, lat: Column, zone=UTM16) -> tuple[Column, Column]:
    """Easting and northing by the fourth-order series in the third flattening."""
    lon0, k0, e0, *_ = zone
    radius, e, alpha = utm_series(zone)
    phi, lam = F.radians(lat), F.radians(lon - lon0)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, c in enumerate(alpha, 1):
        east = east + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return e0 + k0 * radius * east, k0 * radius * north


def inverse_utm(x: Column, y: Column, zone=UTM16) -> tuple[Column, Column]:
    """Longitude and latitude of easting and northing, by the inverse series."""
    lon0, k0, e0, a, f = zone
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630)
    xi, eta = y / (k0 * radius), (x - e0) / (k0 * radius)
    p, q = xi, eta
    for j, c in enumerate(beta, 1):
        p = p - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        q = q - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(p) / F.cosh(q))
    phi = chi
    for j, c in enumerate(delta, 1):
        phi = phi + c * F.sin(2 * j * chi)
    return lon0 + F.degrees(F.atan2(F.sinh(q), F.cos(p))), F.degrees(phi)


def _segments(ring: Column) -> Column:
    """Pairs of points that follow each other; a ring repeats its first point at its end."""
    return F.transform(F.sequence(F.lit(0), F.size(ring) - 2), lambda i: F.struct(ring[i].alias("a"), ring[i + 1].alias("b")))


def edge_distance(x: Column, y: Column, rings: Column) -> Column:
    """Distance from a point to the nearest edge of any ring."""

    def one(s: Column) -> Column:
        ax, ay, dx, dy = s.a[0], s.a[1], s.b[0] - s.a[0], s.b[1] - s.a[1]
        size = dx * dx + dy * dy
        t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - ax) * dx + (y - ay) * dy) / size))).otherwise(0.0)
        return F.hypot(x - ax - t * dx, y - ay - t * dy)

    return F.array_min(F.transform(F.flatten(F.transform(rings, _segments)), one))


def inside(x: Column, y: Column, rings: Column) -> Column:
    """Even-odd rule over all rings, so holes are outside; points on an edge may fall either way."""

    def crosses(s: Column) -> Column:
        ax, ay, bx, by = s.a[0], s.a[1], s.b[0], s.b[1]
        return F.when((ay > y) != (by > y), (x < (bx - ax) * (y - ay) / (by - ay) + ax)).otherwise(False)

    return F.size(F.filter(F.flatten(F.transform(rings, _segments)), crosses)) % 2 == 1


def covers(x: Column, y: Column, rings: Column) -> Column:
    """Inside or on an edge."""
    return inside(x, y, rings) | (edge_distance(x, y, rings) == 0)


def intersects(a: Column, b: Column) -> Column:
    """Whether two polygons share a point: edges that meet, or one that holds the other."""
    side = lambda p, q, r: F.signum((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))

    def meet(s: Column, t: Column) -> Column:
        apart = lambda i: (F.least(s.a[i], s.b[i]) > F.greatest(t.a[i], t.b[i])) | (F.least(t.a[i], t.b[i]) > F.greatest(s.a[i], s.b[i]))
        return ~apart(0) & ~apart(1) & (side(s.a, s.b, t.a) * side(s.a, s.b, t.b) <= 0) & (side(t.a, t.b, s.a) * side(t.a, t.b, s.b) <= 0)

    edges = lambda rings: F.flatten(F.transform(rings, _segments))
    held = lambda p, rings: covers(p[0][0][0], p[0][0][1], rings)
    return F.exists(edges(a), lambda s: F.exists(edges(b), lambda t: meet(s, t))) | held(a, b) | held(b, a)


def polygon_distance(x: Column, y: Column, rings: Column) -> Column:
    """0 inside, else the distance to the nearest edge."""
    return F.when(inside(x, y, rings), F.lit(0.0)).otherwise(edge_distance(x, y, rings))


def signed_edge_distance(x: Column, y: Column, rings: Column) -> Column:
    """Positive inside, negative outside."""
    d = edge_distance(x, y, rings)
    return F.when(inside(x, y, rings), d).otherwise(-d)


def area(rings: Column) -> Column:
    """Of the first ring less the others."""
    def ring_area(r: Column) -> Column:
        return F.abs(F.aggregate(_segments(r), F.lit(0.0), lambda s, e: s + e.a[0] * e.b[1] - e.b[0] * e.a[1])) / 2

    areas = F.transform(rings, ring_area)
    return 2 * areas[0] - F.aggregate(areas, F.lit(0.0), lambda s, v: s + v)


def bbox(rings: Column) -> Column:
    points = F.flatten(rings)
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def box(x0, y0, x1, y1) -> Column:
    """A rectangle as rings."""
    c = lambda v: v.cast("double") if isinstance(v, Column) else F.lit(float(v))
    x0, y0, x1, y1 = c(x0), c(y0), c(x1), c(y1)
    return F.array(F.array(F.array(x0, y0), F.array(x1, y0), F.array(x1, y1), F.array(x0, y1), F.array(x0, y0)))


def cell(x: Column, y: Column, size: float = 500.0) -> Column:
    """The grid cell of a projected point, as ix_iy."""
    return F.concat_ws("_", F.floor(x / size), F.floor(y / size))


def tile_key(lon: Column, lat: Column, per_degree: int = 100, shifted: bool = False) -> Column:
    """The degree tile of a point; shifted counts from -180 and -90."""
    return F.concat_ws("_", F.floor((lon + (180 if shifted else 0)) * per_degree), F.floor((lat + (90 if shifted else 0)) * per_degree))


def geodesic_ring(lon: Column, lat: Column, radius: Column, vertices: int = 40) -> Column:
    """A circle's outline on the sphere; the last point repeats the first."""
    d, phi = radius / EARTH_M, F.radians(lat)

    def at(i: Column) -> Column:
        b = i * (2 * math.pi / vertices)
        p = F.asin(F.sin(phi) * F.cos(d) + F.cos(phi) * F.sin(d) * F.cos(b))
        q = F.radians(lon) + F.atan2(F.sin(b) * F.sin(d) * F.cos(phi), F.cos(d) - F.sin(phi) * F.sin(p))
        return F.array(F.degrees(q), F.degrees(p))

    return F.transform(F.sequence(F.lit(0), F.lit(vertices)), at)


def fan_out(lon: Column, lat: Column, place: Column, count: Column, step: float = 0.00008) -> tuple[Column, Column]:
    """Points of a stack of ``count`` moved to a circle by their place (from 0); a single point stays."""
    turn = 2 * math.pi * place / count
    one = count == 1
    return F.when(one, lon).otherwise(lon + step * F.cos(turn)), F.when(one, lat).otherwise(lat + step * F.sin(turn))


def buffers(spark, wkt: str, distances: list[float]) -> list[tuple[float, str, float]]:
    """(distance, WKT, area) of a polygon's buffers; for one boundary, on the driver, with the JTS that Spark ships."""
    jts = spark._jvm.org.locationtech.jts
    shape = jts.io.WKTReader().read(wkt)
    shape = jts.geom.util.GeometryFixer.fix(shape)
    made = [(d, shape.buffer(float(d))) for d in distances]
    return [(d, g.toText(), g.getArea()) for d, g in made]


def bands(spark, wkt: str, distances: list[float]) -> list[tuple[float, float, float]]:
    """(from, to, area) between the buffers of neighbouring distances."""
    reader = spark._jvm.org.locationtech.jts.io.WKTReader()
    made = [(d, reader.read(w)) for d, w, _ in buffers(spark, wkt, sorted(distances))]
    return [(a, b, g.symDifference(h).getArea()) for (a, g), (b, h) in zip(made, made[1:], strict=False)]


def penetration_yards(spark, wkt: str, other: str, steps: int = 18) -> float:
    """How deep one polygon reaches into another: the widest inner buffer that still meets it, by bisection."""
    reader = spark._jvm.org.locationtech.jts.io.WKTReader()
    a, b = reader.read(wkt), reader.read(other)
    if not a.intersects(b):
        return 0.0
    lo, hi = 0.0, 50_000.0
    for _ in range(steps):
        middle = (lo + hi) / 2
        lo, hi = (middle, hi) if a.intersects(b.buffer(-middle)) and not b.buffer(-middle).isEmpty() else (lo, middle)
    return round(lo / 0.9144, 1)


def dissolved(spark, wkts: list[str]) -> str:
    """WKT of the union of some polygons, invalid ones mended; for boundaries, on the driver."""
    jts = spark._jvm.org.locationtech.jts
    reader, shapes = jts.io.WKTReader(), spark._jvm.java.util.ArrayList()
    for wkt in wkts:
        shapes.add(jts.geom.util.GeometryFixer.fix(reader.read(wkt)))
    return jts.geom.GeometryFactory().buildGeometry(shapes).union().toText()


def interior_point(spark, wkt: str) -> tuple[float, float]:
    """A point that lies inside a shape, where its middle may not."""
    p = spark._jvm.org.locationtech.jts.io.WKTReader().read(wkt).getInteriorPoint()
    return p.getX(), p.getY()


def depths_near(spark, areas: dict[str, str], places: dict[str, str], reach: float) -> dict[str, dict[str, float]]:
    """For each area (WKT, in metres) no farther than ``reach`` from the union of the places: how deep it goes into each
    place that it meets, in yards. In order of the areas' names; for tables of boundaries, on the driver."""
    reader = spark._jvm.org.locationtech.jts.io.WKTReader()
    edge = reader.read(dissolved(spark, list(places.values()))).buffer(float(reach))
    out = {}
    for name, wkt in sorted(areas.items()):
        area = reader.read(wkt)
        if area.intersects(edge):
            out[name] = {p: penetration_yards(spark, wkt, w) for p, w in places.items() if area.intersects(reader.read(w))}
    return out
