"""Unions by edge cancellation, depths and inner points, against JTS and closed forms."""

import random

import pytest
from pyspark.sql import functions as F

from rentlens.functions import geo
from rentlens.operators import outlines


def square(x, y, w=1.0, h=None):
    h = w if h is None else h
    return [[[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]]]


def wkt(rings):
    return "POLYGON(" + ", ".join("(" + ", ".join(f"{x} {y}" for x, y in r) + ")" for r in rings) + ")"


POLYGONS = "g string, rings array<array<array<double>>>"


def test_union_of_cells_equals_jts(spark):
    rng = random.Random(2)
    cells = {"a": {(i, j) for i in range(9) for j in range(9) if rng.random() < 0.6}, "b": {(0, 0), (1, 1)}, "ring": {(i, j) for i in range(3) for j in range(3)} - {(1, 1)}, None: {(5, 5)}}
    rows = [(g, square(float(i), float(j)) if rng.random() < 0.5 else [square(float(i), float(j))[0][::-1]]) for g, own in cells.items() for i, j in own]
    df = spark.createDataFrame([*rows, ("empty", None), ("flat", [[[0.0, 0.0], [1.0, 0.0], [0.0, 0.0]]])], POLYGONS).repartition(5)
    found = {r.g: (r.area, r.length) for r in outlines.measures(outlines.edges(df, "g", "rings"), "g").collect()}
    rings = {}
    for r in outlines.dissolved(df, "g", "rings").collect():
        rings.setdefault(r.g, []).append((r.ring, r.area))
    reader = spark._jvm.org.locationtech.jts.io.WKTReader()
    for g, own in cells.items():
        union = reader.read(geo.dissolved(spark, [wkt(square(i, j)) for i, j in own]))
        assert found[g] == pytest.approx((union.getArea(), union.getLength())) and found[g][0] == len(own)
        assert sum(a for _, a in rings[g]) == pytest.approx(len(own))
        for ring, area in rings[g]:
            assert ring[0] == ring[-1] and len({tuple(p) for p in ring}) >= 4
            assert reader.read(wkt([ring])).isValid() and abs(reader.read(wkt([ring])).getArea()) == pytest.approx(abs(area))
    assert sorted(a for _, a in rings["ring"]) == [-1.0, 9.0] and sorted(a for _, a in rings["b"]) == [1.0, 1.0]
    assert set(found) == set(cells)


def test_depths_of_boxes(spark):
    rng = random.Random(3)
    box = lambda: [rng.uniform(0, 900), rng.uniform(0, 900), rng.uniform(20, 800), rng.uniform(20, 800)]
    rows = [(i, *a, *b) for i in range(60) for a, b in [(box(), box())]]
    df = spark.createDataFrame([(i, square(*r[:4]), square(*r[4:])) for i, *r in rows] + [(99, None, square(0.0, 0.0)), (98, square(5.0, 5.0), square(0.0, 0.0))], "i int, a array<array<array<double>>>, b array<array<array<double>>>")
    got = {r.i: r.depth_yards for r in outlines.depths(df, "a", "b").collect()}
    for i, ax, ay, aw, ah, bx, by, bw, bh in rows:
        x0, x1, y0, y1 = max(ax, bx), min(ax + aw, bx + bw), max(ay, by), min(ay + ah, by + bh)
        if x0 > x1 or y0 > y1:
            assert got[i] is None or got[i] != got[i]
            continue
        clamp = lambda lo, hi, m: min(max(m, lo), hi)
        px, py = clamp(x0, x1, bx + bw / 2), clamp(y0, y1, by + bh / 2)
        want = min(px - bx, bx + bw - px, py - by, by + bh - py)
        assert abs(got[i] - want / outlines.YARD_M) < 1
    assert all(got[i] is None or got[i] != got[i] for i in (98, 99))


def test_depth_in_a_shape_with_a_hole(spark):
    ring = [square(0.0, 0.0, 100.0)[0], square(20.0, 20.0, 60.0)[0]]  # 20 m wide all around
    depth, x, y = outlines.deepest(square(-5.0, 40.0, 200.0, 10.0), ring, 0.1)
    assert abs(depth - 10) < 0.1 and 39 < y < 51
    other = geo.penetration_yards(spark, wkt(square(-5.0, 40.0, 200.0, 10.0)), wkt(ring))
    assert abs(depth / outlines.YARD_M - other) < 1


def test_inner_points_lie_inside(spark):
    u = [[[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [8.0, 10.0], [8.0, 1.0], [2.0, 1.0], [2.0, 10.0], [0.0, 10.0], [0.0, 0.0]]]
    ring = [square(0.0, 0.0, 9.0)[0], square(1.0, 1.0, 7.0)[0]]
    df = spark.createDataFrame([("u", u), ("ring", ring), ("box", square(3.0, 4.0, 2.0)), ("flat", [[[0.0, 0.0], [1.0, 0.0], [2.0, 0.0], [0.0, 0.0]]]), ("none", None)], POLYGONS)
    p = outlines.inner_point(F.col("rings"))
    got = {r.g: (r.p, r.ok) for r in df.select("g", p.alias("p"), geo.inside(p["x"], p["y"], F.col("rings")).alias("ok")).collect()}
    assert all(got[g][1] for g in ("u", "ring", "box")) and tuple(got["box"][0]) == (4.0, 5.0)
    assert got["flat"][0] is None and got["none"][0] is None


def test_equal_pairs_of_shapes_are_measured_once(monkeypatch):
    import pyarrow as pa

    calls, real = [], outlines.deepest
    monkeypatch.setattr(outlines, "deepest", lambda a, b, within: calls.append(1) or real(a, b, within))
    box = lambda x, w: [[[x, 0.0], [x + w, 0.0], [x + w, 9.0], [x, 9.0], [x, 0.0]]]
    shapes = [(box(0, 5), box(2, 9)), (box(0, 5), box(3, 9)), (None, box(2, 9)), ([], box(2, 9)), ([[]], box(2, 9)), (box(0, 5)[0:1] * 2, box(2, 9))]
    rows = [(i, *shapes[i % 6]) for i in range(600)]
    kind = pa.list_(pa.list_(pa.list_(pa.float64())))
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array([r[0] for r in part]), *(pa.array([r[k] for r in part], kind) for k in (1, 2))], names=["i", "a", "b"])
    out = [r for b in outlines._measured([batch(rows[:300]), batch(rows[300:]).slice(0, 300)], "a", "b", 0.1) for r in b.to_pylist()]
    assert len(calls) == 6
    for r in out:
        want = real(r["a"], r["b"], 0.1)
        assert (r["depth_yards"] is None) == (want is None)
        assert want is None or r["depth_yards"] == want[0] / outlines.YARD_M and (r["deep_x"], r["deep_y"]) == want[1:]


def test_inner_point_sorts_its_heights_once(spark):
    ring = F.array(*(F.array(F.col("id") + float(x), F.lit(float(y))) for x, y in ((0, 0), (3, 0), (3, 1), (1, 1), (1, 3), (0, 3), (0, 0))))
    plan = spark.range(1).select(outlines.inner_point(F.array(ring)).alias("p"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct") == 1
