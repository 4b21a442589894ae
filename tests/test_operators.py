"""Joins against brute force; merges, nicknames, screening, sources, sinks, incremental runs."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from rentlens.functions import geo
from rentlens.operators import candidates, merge, nicknames, screening, spatial
from rentlens.sources import sinks, tables
from rentlens.streaming import watch


def haversine(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * 6371008.8 * math.asin(math.sqrt(h))


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(4)
    spot = lambda: (-86.78 + rng.gauss(0, 0.02), 36.16 + rng.gauss(0, 0.02))
    a, b = [(i, *spot()) for i in range(80)], [(i, *spot()) for i in range(60)]
    left = spark.createDataFrame([*a, (99, None, 36.0)], "id int, lon double, lat double")
    return a, b, left, spark.createDataFrame([*b, (98, None, None)], "r_id int, r_lon double, r_lat double")


def test_radius_and_nearest(sides):
    a, b, left, right = sides
    want = {(x[0], y[0]) for x in a for y in b if haversine(x[1:], y[1:]) <= 550}
    assert {(r.id, r.r_id) for r in spatial.within_radius(left, right, 550).collect()} == want
    got = {r.id: r.nearest for r in spatial.nearest(left, right, "id", "r_id", 200).collect()}
    assert got == {x[0]: min(b, key=lambda y: haversine(x[1:], y[1:]))[0] for x in a}
    alone = {r.id for r in spatial.without_neighbor(left.where("lon is not null"), right, 550).collect()}
    assert alone == {x[0] for x in a} - {i for i, _ in want}


def test_polygons(spark):
    rng = random.Random(5)
    boxes = [(i, x, y, rng.uniform(50, 400)) for i in range(25) for x, y in [(rng.uniform(0, 3000), rng.uniform(0, 3000))]]
    spots = [(i, rng.uniform(-200, 3400), rng.uniform(-200, 3400)) for i in range(120)]
    polygons = spark.createDataFrame(boxes, "pid int, bx double, by double, w double").select("pid", geo.box(F.col("bx"), F.col("by"), F.col("bx") + F.col("w"), F.col("by") + F.col("w")).alias("rings"))
    points = spark.createDataFrame(spots, "id int, x double, y double")

    def distance(p, q):
        return math.hypot(max(q[1] - p[1], 0, p[1] - q[1] - q[3]), max(q[2] - p[2], 0, p[2] - q[2] - q[3]))

    got = {(r.id, r.pid) for r in spatial.polygons_within(points, polygons, "x", "y", "rings", 300.0).collect()}
    assert got == {(p[0], q[0]) for p in spots for q in boxes if distance(p, q) <= 300}
    smallest = {r.id: r.pid for r in spatial.containing(points, polygons, "id", "x", "y", "rings", ["pid"], 200.0).collect()}
    assert smallest == {p[0]: min(inner, key=lambda q: q[3])[0] for p in spots if (inner := [q for q in boxes if distance(p, q) == 0])}
    near = {r.id: round(r.distance_m, 6) for r in spatial.nearest_polygon(points, polygons, "id", "pid", "x", "y", "rings", 100.0).collect()}
    assert near == {p[0]: round(min(distance(p, q) for q in boxes), 6) for p in spots}


def test_balance(spark):
    a = spark.createDataFrame([("l1", 0, 0), ("l1", 0, 0), ("l2", 0, 1), ("l3", 5, 5)], "listing_id string, cx long, cy long")
    b = spark.createDataFrame([("p1", 0, 0), ("p1", 9, 9), ("p2", 1, 0)], "parcel string, cx long, cy long")
    assert {tuple(r) for r in spatial.balance(a, b).collect()} == {(0, 0, 1, 1, 0), (0, 1, 1, 0, 1), (5, 5, 1, 0, 1), (1, 0, 0, 1, -1)}
    wide = {(r.cx, r.cy): (r.listings, r.permits) for r in spatial.balance(a, b, reach=500).collect()}
    assert wide[(0, 0)] == (2, 2) and wide[(1, 1)] == (1, 1) and wide[(5, 6)] == (1, 0)


def test_merges(spark):
    one = spark.createDataFrame([("1", "a", "x"), ("2", "b", "y")], "id string, title string, beds string")
    two = spark.createDataFrame([("2", "null", "4"), ("3", "c", " ")], "id string, title string, beds string")
    merged = merge.merge_sources([one, two], "id", ["title", "beds"])
    assert {tuple(r) for r in merged.collect()} == {("1", "a", "x"), ("2", "b", "4"), ("3", "c", None)}
    assert {tuple(r) for r in merge.repairs(one, merged, "id", ["title", "beds"]).collect()} == {("2", "beds", "y", "4"), ("3", "title", None, "c")}
    sized = spark.createDataFrame([("g", i, n) for i, n in enumerate([4, 4, 4, 20, 1])], "g string, i int, n int")
    assert [r.chunk for r in merge.size_chunks(sized, "g", "i", "n", 10).orderBy("i").collect()] == [0, 0, 1, 2, 3]
    keep, rest = merge.same_partition(spark.createDataFrame([(1,), (None,), (-1,)], "d int"), F.col("d") > 0)
    assert keep.count() == 2 and rest.count() == 1
    assert merge.parcel_status(spark.createDataFrame([("p", "expired"), ("p", "revoked"), ("q", "odd")], "parcel string, status string"), ("current", "revoked", "suspended", "expired")).collect() == [("p", "revoked")]


def test_nicknames(spark):
    n = nicknames.NickNamer.from_triplets(spark, [(" Robert ", "has_nickname", "Bob"), ("robert", "has_nickname", "rob"), ("bob", "has_nickname", "bobby"), ("x", "other", "y")])
    assert n.nicknames_of("ROBERT ") == {"bob", "rob"} and n.canonicals_of("bob") == {"robert"} and n.nicknames_of("nobody") == set()
    m = nicknames.NickNamer.from_lookup(spark, canonicals={"bob": {"robert"}})
    assert m.nicknames_of("robert") == {"bob"}
    with pytest.raises(TypeError):
        n.nicknames_of(3)
    lines = spark.createDataFrame([("name1,relationship,name2",), ("A,has_nickname, b",), ("a,has_nickname,b",), ("a,b",), ("a,has_nickname,a",)], "line string")
    good, bad = nicknames.check_triples(lines)
    assert good.collect() == [("a", "has_nickname", "b")] and bad.count() == 2
    assert nicknames.insert_statements(spark.createDataFrame([("o'b", None)], "a string, b string"), "t").first()[0] == "INSERT INTO t (a, b) VALUES ('o''b', NULL);"
    assert nicknames.wide(n.edges, 2).where("canonical_name = 'robert'").first() == ("robert", "bob", "rob")


def test_screening(spark):
    schema = "listing_id string, ordinal int, likely_hotel boolean, bedrooms double, licenses int, over_capacity double"
    rows = [("a", 0, True, 1.0, 0, 0.0), ("a", 1, False, 1.0, 0, 3.0), ("b", 0, True, None, 0, None), ("c", 0, None, 6.0, 0, 0.0), ("d", 0, False, 2.0, 2, 0.0), ("e", 0, False, None, 0, 1.0), ("f", 0, False, 2.0, 1, 0.0)]
    got = screening.funnel(spark.createDataFrame(rows, schema)).first()
    assert tuple(got) == (6, 1, 1, 1, 0, 3, 2, 66.666667)
    assert screening.funnel(spark.createDataFrame([], schema)).first()["percent_over"] is None
    assert tuple(screening.funnel(spark.createDataFrame(rows, schema), exclude_large=False, exclude_multiple=False).first()) == (6, 1, 0, 0, 0, 5, 2, 40.0)
    listed = spark.createDataFrame([("h", True, True, 1.0), ("l", False, None, None), ("n", None, True, None), ("m", False, None, 9.144), ("u", False, False, 9.2), ("b", False, None, None), ("x", False, None, None)], "listing_id string, likely_hotel boolean, overlap boolean, nearest_licensed_parcel_m double")
    found = spark.createDataFrame([("l", "owner_name", "0-1"), ("u", "owner_nickname", "2"), ("b", "owner_name", "01"), ("b", "permit_owner_name", "2"), ("x", "distance", "01"), ("x", "owner_name", ""), ("h", "owner_name", "01")], "listing_id string, type string, parcel string")
    got = candidates.auto_match(listed, found, spark.createDataFrame([("0 1",), (None,)], "parcel string"))
    assert {r.listing_id: r.auto_status for r in got.collect()} == {"h": "hotel", "l": "licensed", "n": "nearby", "m": "nearby", "u": "unlicensed", "b": "unknown", "x": "unknown"}
    assert screening.spatial_rate(spark.createDataFrame([], "likely_hotel boolean, in_scope boolean, overlap boolean")).first() == (0, 0, 0, 0, None)
    few = screening.first_rows(spark.range(5), ["id"], 3)
    assert [tuple(r) for r in few.collect()] == [(0, True), (1, True), (2, True)] and not screening.first_rows(spark.range(3), ["id"], 3).first().more
    assert not screening.Facets().active and screening.Facets(party=True).active


def test_candidates_keep_ambiguity(spark):
    near = spark.createDataFrame([("l", 1, 5.0, ["bob"]), ("l", 2, None, ["bob"]), ("l", 3, 1.0, ["bob"]), ("l", 9, 1.0, ["bob"])], "listing_id string, id int, distance_m double, host_tokens array<string>")
    properties = spark.createDataFrame([(1, "P1", ["bob", "x"]), (2, "P2", ["robert", "y"]), (3, "P3", ["zed"])], "id int, parcel string, owner_tokens array<string>")
    permit = spark.createDataFrame([("P3", ["robert"], 7, 1), ("P3", ["bob"], 8, 0)], "parcel string, owner_tokens array<string>, permit_id int, ordinal int")
    m = F.create_map(F.lit("bob"), F.array(F.lit("robert")))
    got = candidates.typed_matches(near, properties, permit, m)
    assert {(r.parcel, r.type) for r in got.collect()} == {("P1", "owner_first_name"), ("P2", "owner_nickname"), ("P3", "permit_owner_name")}
    assert [x.parcel for x in candidates.listing_lists(got).first()["matches"]] == ["P2", "P3", "P1"]
    assert candidates.reverse_index(got).count() == 3


def test_sources(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert tables.csv_table(spark, f"{root}/none.csv", ["a", "b"]).columns == ["a", "b"]
    (tmp_path / "x.csv").write_bytes("﻿url,notes\n\"https://x.example/rooms/12 and /rooms/13\",\"two\nlines, \"\"q\"\"\"\n".encode())
    rows = tables.csv_table(spark, f"{root}/x.csv", ["url", "address"])
    assert rows.first().notes == 'two\nlines, "q"'
    assert [r.listing_id for r in tables.registry(rows, "manual").collect()] == ["12", "13"]
    for folder, files in {"100000000000000001": {"metadata.json": json.dumps({"bedrooms": "3", "description": "Permit 2023000001. A bar."}), "details.txt": "bedrooms: 2\nhost name: Bob\n----------\n12 guests · 3 bedrooms, a BAR", "description.txt": "pool"}, "7": {"metadata.json": "[1"}, "name": {"metadata.json": "{}"}}.items():
        (tmp_path / "r" / folder).mkdir(parents=True)
        for name, text in files.items():
            (tmp_path / "r" / folder / name).write_text(text)
    files = tables.listing_folders(spark, f"{root}/r")
    found, bad = tables.scanned_listings(files)
    r = {x.listing_id: x for x in found.collect()}["100000000000000001"]
    assert r.attrs["bedrooms"] == "3" and r.attrs["host_name"] == "Bob" and r.occupancy == (12, 3)
    assert [p.number for p in r.permits] == ["2023000001"] and set(r.amenities) == {"bar", "pool"} and "BAR" in r.amenities["bar"]
    assert [x.listing_id for x in bad.collect()] == ["7"]
    square = [[[0, 0], [1, 0], [1, 1], [0, 0]]]
    (tmp_path / "p.geojson").write_text(json.dumps({"features": [{"properties": {"PIN": "0 1", "GEOID": "47037"}, "geometry": {"type": "Polygon", "coordinates": square}}, {"properties": {"PIN": "02"}, "geometry": {"type": "MultiPolygon", "coordinates": [square, square]}}, {"properties": {"PIN": "3"}, "geometry": None}]}))
    g = tables.geojson(spark, f"{root}/p.geojson", ["PIN"]).collect()
    assert [len(x.rings or []) for x in g] == [1, 2, 0] and g[0].PIN == "0 1"
    with pytest.raises(ValueError, match="one feature"):
        tables.boundary(spark, f"{root}/p.geojson", "47037")
    licensed = tables.licensed_parcels(tables.geojson(spark, f"{root}/p.geojson", ["PIN"]), spark.createDataFrame([("01",), (" ",)], "Parcel_PIN string"))
    assert [x.PIN for x in licensed.collect()] == ["0 1"]
    (tmp_path / "a.js").write_text('var locations = [{"url": "u", "n": 1}];')
    assert tables.js_array(spark, f"{root}/a.js", "url:string,n:int").collect() == [("u", 1)]
    with pytest.raises(ValueError, match="both"):
        tables.renamed(rows, {"url": "notes"})


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("k1", [1, 2], {"a": "b"}), ("k2", None, None)], "k string, l array<int>, m map<string,string>")
    sinks.write_csv(df, f"file://{tmp_path}/c")
    back = {r.k: r.l for r in spark.read.csv(f"file://{tmp_path}/c", header=True, escape='"').collect()}
    assert back == {"k1": "[1,2]", "k2": None}
    sinks.write_sharded(df, f"file://{tmp_path}/s", "k")
    assert spark.read.json(f"file://{tmp_path}/s").where("k = 'k1'").count() == 1
    sinks.replace_text(spark, f"file://{tmp_path}/t.json", "{}")
    sinks.replace_text(spark, f"file://{tmp_path}/t.json", "[]")
    assert (tmp_path / "t.json").read_text() == "[]"
    sinks.publish({"a": df}, df.select("k"), f"file://{tmp_path}/out")
    assert (tmp_path / "out" / "report" / "_SUCCESS").exists()
    f = json.loads(sinks.feature_collection(spark.createDataFrame([("p", [[[0.0, 1.0]]])], "id string, g array<array<array<double>>>"), "g").first()[0])
    assert f["properties"] == {"id": "p"} and f["geometry"]["type"] == "Polygon"


def test_incremental(spark, tmp_path):
    schema = "path string, size long, mtime timestamp"
    a = spark.createDataFrame([("x", 1, None), ("y", 2, None)], schema)
    assert watch.signature(a).first() == watch.signature(a.orderBy(F.desc("path"))).first() != watch.signature(a.limit(1)).first()
    stamp = __import__("datetime").datetime(2024, 1, 1)
    files = spark.createDataFrame([("x", 1, stamp), ("y", 2, stamp)], schema)
    cache = spark.createDataFrame([("x", 1, stamp, 1), ("y", 1, stamp, 1)], schema + ", version int")
    assert [r.path for r in watch.to_scan(files, cache).collect()] == ["y"]
    new = watch.refreshed(cache, cache.limit(0), files.where("path = 'x'").select("path"))
    assert {r.path: r.version for r in new.collect()} == {"x": -1, "y": 1}
    assert watch.due(None, 10) and not watch.due(1, 10) and watch.due(1, 301)
    df = spark.createDataFrame([(1,), (2,)], "i int")
    df.write.parquet(f"file://{tmp_path}/in")
    seen = []
    for _ in range(2):
        query = watch.watch(watch.file_stream(spark, f"file://{tmp_path}/in", df.schema), lambda batch, n: seen.append(batch.count()), f"file://{tmp_path}/state", once=True)
        query.awaitTermination()
    assert sum(seen) == 2
    with pytest.raises(ValueError, match="interval"):
        watch.watch(df, print, "x", interval=1)


def test_every_typed_match_has_a_row(spark):
    from rentlens.plans import spatial as plans
    from rentlens.plans.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    part = {r.p_partkey: r.p_name.split() for r in spark.read.parquet(f"{sf}/part.parquet").collect()}
    given, nick = plans._GIVEN, plans.nickname_map()
    assert "robert" in nick["bob"] and "bob" in nick["robert"]
    spots = [(r.vec_id, (r.lon, r.lat)) for r in plans.points(spark, sf).collect()]
    kinds, want = set(), set()
    for i, x in spots:
        g, w = given[i % len(given)], part[i % len(part)]
        host = ([g, *w], [g], [g, *w[1:]])[i % 3]
        for j, y in spots:
            if haversine(x, (y[0] + 0.0013, y[1])) > 550:
                continue
            owner = [given[j % len(given)], *part[j % len(part)]]
            if host == owner or (len(host) > 1 and set(host) <= set(owner)):
                kind = "owner_name"
            elif len(host) == 1 and host[0] in owner:
                kind = "owner_first_name"
            elif any(set(nick.get(h, ())) & set(owner) for h in host) and (len(host) == 1 or set(host) & set(owner)):
                kind = "owner_nickname"
            else:
                kind = None
            kind = "distance" if kind is None else f"permit_{kind}" if j % 3 == 0 else kind
            kinds.add(kind)
            want.add((i, f"P{j}", kind))
    rows = QUERIES["typed_candidate_matches_whole"](spark, sf).collect()
    assert len(rows) == len(want) and {(r.listing_id, r.parcel, r.type) for r in rows} == want
    assert {"distance", "owner_first_name", "owner_nickname", "permit_owner_nickname"} <= kinds


@pytest.mark.parametrize(("lon", "lat"), [(-86.78, 36.16), (10.0, 75.0), (179.9999, 10.0), (-179.9999, -60.0), (5.0, 89.9), (0.0, 90.0), (120.0, -89.9999)])
def test_radius_at_any_latitude_and_across_the_seam(spark, lon, lat):
    import math
    import random

    rng = random.Random(7)
    spread = lambda: ((lon + rng.uniform(-0.02, 0.02) / max(math.cos(math.radians(lat)), 0.001) + 540) % 360 - 180, max(-90.0, min(90.0, lat + rng.uniform(-0.012, 0.012))))
    a, b = ([(i, *spread()) for i in range(40)] for _ in range(2))
    far = lambda p, q: 2 * spatial.EARTH_M * math.asin(min(1, math.sqrt(math.sin(math.radians(q[2] - p[2]) / 2) ** 2 + math.cos(math.radians(p[2])) * math.cos(math.radians(q[2])) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2)))
    left, right = spark.createDataFrame(a, "id int, lon double, lat double"), spark.createDataFrame(b, "r_id int, r_lon double, r_lat double")
    want = {(p[0], q[0]) for p in a for q in b if far(p, q) <= 550}
    assert want and {(r.id, r.r_id) for r in spatial.within_radius(left, right, 550).collect()} == want
    assert {r.id for r in spatial.without_neighbor(left, right, 550).collect()} == {p[0] for p in a} - {x for x, _ in want}


def test_nearest_has_no_end_of_its_radius(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0), (2, 170.0, -80.0), (3, None, 1.0)], "id int, lon double, lat double")
    right = spark.createDataFrame([(7, 179.0, 1.0), (8, -179.5, 0.5)], "r_id int, r_lon double, r_lat double")
    got = {r.id: (r.nearest, round(r.distance_m)) for r in spatial.nearest(left, right, "id", "r_id", 1.0).collect()}
    assert set(got) == {1, 2} and got[1][0] == 7 and got[1][1] > 19_000_000
    assert spatial.nearest(left, right.limit(0), "id", "r_id", 1.0).count() == 0
    square = spark.createDataFrame([(5, [[[1e6, 1e6], [1e6 + 1, 1e6], [1e6 + 1, 1e6 + 1], [1e6, 1e6]]])], "pid int, rings array<array<array<double>>>")
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 0.0)], "id int, x double, y double")
    assert [(r.id, r.nearest, round(r.distance_m)) for r in spatial.nearest_polygon(points, square, "id", "pid", "x", "y", "rings", 0.5).collect()] == [(1, 5, 1414214)]
    assert spatial.nearest_polygon(points, square.limit(0), "id", "pid", "x", "y", "rings", 0.5).count() == 0


def test_writers_and_memory(spark, tmp_path):
    from rentlens.operators import lookups
    from rentlens.sources import sinks, tables

    df = spark.createDataFrame([("b", "x", 1.0), ("A", "y", 2.0), ("é", "x", 3.0), ("f", "y", 4.0)], "name string, bucket string, n double")
    assert [r.name for r in lookups.collated(df, "name").collect()] == ["A", "b", "é", "f"]
    sinks.write_sharded(df, f"file://{tmp_path}/shards", "bucket")
    one = tables.shard(spark, f"file://{tmp_path}/shards", "bucket", "y")
    assert {r.name for r in one.collect()} == {"A", "f"} and "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().toString()
    with pytest.raises(Exception, match="n is not finite"):
        sinks.without_nan(df.withColumn("n", F.lit(float("nan")))).collect()
    out, report = f"file://{tmp_path}/out", spark.createDataFrame([(1,)], "rows int")
    for n in (1, 2):
        sinks.publish({"t": df.limit(n)}, report, out)
        assert spark.read.parquet(f"{out}/t").count() == n and spark.read.json(f"{out}/report").count() == 1
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["report", "t"]
    made = []
    for key in (1, 1, 2):
        assert sinks.memoised(spark, f"file://{tmp_path}/cache", "x", key, lambda: made.append(1) or df).count() == 4
    assert len(made) == 2


def test_unions_interior_points_and_depths(spark):
    box = lambda x, y, w, h: f"POLYGON (({x} {y}, {x + w} {y}, {x + w} {y + h}, {x} {y + h}, {x} {y}))"
    both = geo.dissolved(spark, [box(0, 0, 100, 100), box(100, 0, 100, 100)])
    assert geo.buffers(spark, both, [0])[0][2] == 20_000 and both.startswith("POLYGON")
    ring = "POLYGON ((0 0, 100 0, 100 100, 0 100, 0 0), (10 10, 90 10, 90 90, 10 90, 10 10))"
    x, y = geo.interior_point(spark, ring)
    assert not (10 < x < 90 and 10 < y < 90) and 0 < x < 100 and 0 < y < 100
    got = geo.depths_near(spark, {"b": box(150, 0, 200, 100), "a": box(-20, 0, 30, 100), "far": box(5000, 0, 10, 10)}, {"west": box(0, 0, 100, 100), "east": box(100, 0, 100, 100)}, 1609.344)
    assert list(got) == ["a", "b"] and set(got["a"]) == {"west"} and abs(got["a"]["west"] - 10 / 0.9144) < 0.2 and abs(got["b"]["east"] - 50 / 0.9144) < 0.2


def test_names_made_alike_in_another_way(spark):
    class Plain(nicknames.NickNamer):
        normal = staticmethod(lambda c: F.upper(F.replace(c, F.lit("-"))))

    names = Plain.from_triplets(spark, [("jo-anne", nicknames.RELATION, "jo")])
    assert names.nicknames_of("Joanne") == {"JO"} and names.canonicals_of("j-o") == {"JOANNE"}


def test_archive_and_preview(spark, tmp_path):
    import urllib.request

    from rentlens import cli

    (tmp_path / "x.txt").write_text("here")
    server = cli.serve(f"file://{tmp_path}", 0)
    assert urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/x.txt").read() == b"here"
    server.shutdown()


def test_names_meet_as_all_pairs_do(spark):
    """Matched names by their keys equal those of all pairs, without a cartesian product; every rule is hit."""
    import random

    from rentlens.functions import names
    from rentlens.operators import hosts

    rng = random.Random(3)
    words = ["STANDARD", "ECONOMY", "ADMINISTRATION", "ROD", "WIDGET", "BILL", "WILLIAM", "SUSIE", "SUSANNE", "POE", "ANN", "CHRISTOPHERSON", "INTERNATIONALISATION", "RINGO", "LLC", "OF", "AB"]

    def typo(w):
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + "Q" + w[i + 1 :], w[:i] + w[i + 1 :] or "Z", w[:i] + "K" + w[i:]])
        return w

    made = lambda n: sorted({" ".join(typo(rng.choice(words)) for _ in range(rng.choice([1, 1, 2, 3]))) for _ in range(n)} | {""})
    a, b = (spark.createDataFrame([(x,) for x in made(220)], f"{c} string") for c in ("h", "b"))
    got = hosts.matched_names(a, b, "h", "b")
    judged = a.crossJoin(b).withColumn("m", names.classify(F.col("h"), F.col("b"), names.meaningful(F.col("h")), names.meaningful(F.col("b")))).where("m is not null").select("h", "b", "m.*")
    want = {tuple(r) for r in judged.collect()}
    assert {tuple(r) for r in got.collect()} == want
    assert {r[2] for r in want} >= {"one_name_prefix_match", "one_name_variant_match", "fuzzy_name_match", "fuzzy_one_name_match", "partial_name_match", "exact_full_name"}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_facet_counts_at_once_equal_each(spark):
    from rentlens.operators import screening

    df = spark.createDataFrame([(["a", "b", None][i % 3], f"h{i % 5}", i % 4 == 0, float(i % 9)) for i in range(300)], "rental_type string, host_key string, party boolean, overage double")
    f = screening.Facets(rental_type="a", host="h2", party=False, least_overage=4.0)
    columns = {"rental_type": "rental_type", "host": "host_key", "party": "party", "least_overage": "overage"}
    got = {(r.facet, r.value): r.n for r in f.all_counts(df, columns).collect()}
    want = {(facet, str(r[0]).lower() if facet == "party" else str(r[0])): r.n for facet, c in columns.items() for r in f.counts(df.withColumn(c, F.col(c).cast("string")) if facet != "party" and facet != "least_overage" else df.withColumn("as_text", F.col(c).cast("string")), facet, c if facet not in ("party", "least_overage") else "as_text").collect()}
    assert got == want
    plan = f.all_counts(df.repartition(2), columns)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1
