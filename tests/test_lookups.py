"""Lookups and labels on invented rows, with nulls, blanks, ties and empty tables."""

import json

import pytest
from pyspark.sql import functions as F

from rentlens import tools
from rentlens.functions import geo, labels
from rentlens.operators import candidates, lookups, spatial
from rentlens.sources import remote


def test_labels(spark):
    kinds = spark.createDataFrame([(True, "current", True), (False, "current", True), (False, "unknown", True), (None, "other", False), (False, None, None)], "h boolean, s string, o boolean")
    assert [r[0] for r in kinds.select(labels.marker_kind(F.col("h"), F.col("s"), F.col("o"))).collect()] == ["hotel", "current", "over", "other", "none"]
    text = spark.createDataFrame([(None, None, False), (12.0, 2.0, True)], "g double, v double, o boolean")
    assert [r[0] for r in text.select(labels.marker_label(F.col("g"), F.col("v"), F.col("o"))).collect()] == ["?", "12\n+2"]
    row = spark.range(1).select(
        labels.permit_values(F.array(F.create_map(F.lit("id"), F.lit(" 7 ")), F.create_map(F.lit("permit_number"), F.lit(" ")), F.create_map(F.lit("permit"), F.lit("b"), F.lit("number"), F.lit("c")))).alias("a"),
        labels.permit_values(F.lit(None).cast("array<map<string,string>>")).alias("b"),
        labels.without_blanks(F.create_map(F.lit("x"), F.lit(" "), F.lit("y"), F.lit("1"), F.lit("z"), F.lit(None).cast("string"))).alias("c"),
        labels.ring_radius(F.lit(0.0), F.lit(True)).alias("d"),
        labels.ring_radius(F.lit(None).cast("double"), F.lit(False)).alias("e"),
        labels.community_status(F.lit(None).cast("string")).alias("f"),
        labels.parcel_badge(F.lit(None).cast("boolean"), F.lit(True)).alias("g"),
        labels.match_label(F.lit("else")).alias("h"),
        labels.status_label(F.lit("in_review")).alias("i"),
        labels.first_of(F.create_map(F.lit("lon"), F.lit("1")), "airbnb_longitude", "lon").alias("j"),
    ).first()
    assert tuple(row) == (["7", "b"], [], {"y": "1"}, 15.0, None, "undetermined", "expired permit", "else", "In Review", "1")


def test_tiles_and_addresses(spark):
    views = spark.createDataFrame([("a", -0.005, 0.0, 0.0, 0.005), ("b", 5.0, 5.0, 5.0, 5.0)], "view string, west double, south double, east double, north double")
    tiles = spark.createDataFrame([("-1_0",), ("0_0",), ("1_0",)], "tile string")
    assert sorted(tuple(r) for r in lookups.view_tiles(views, tiles).select("view", "tile").collect()) == [("a", "-1_0"), ("a", "0_0")]
    assert spark.range(1).select(lookups.bounds_meet(*map(F.lit, (0, 0, 1, 1, 1, 1, 2, 2)))).first()[0]
    records = spark.createDataFrame([("t", 1.0, 2.0, "1 Oak  st, X"), ("t", 1.0, 2.0, "1 oak st, Y"), ("u", 3.0, 4.0, "1 OAK ST"), ("u", None, 4.0, "1 oak st"), ("v", 1.0, 1.0, None), ("v", 1.0, 1.0, " ")], "tile string, lon double, lat double, address string")
    shards, options = candidates.address_index(records)
    keys = spark.createDataFrame([("1 oak st",), ("none",), (None,)], "key string")
    assert [(r.lon, r.lat) for r in lookups.address_points(keys, shards, records).collect()] == [(3.0, 4.0)]
    assert lookups.address_options(options, "1 OAK ST,").count() == 2 and lookups.address_options(options, "").count() == 0


def test_records_and_places(spark):
    properties = spark.createDataFrame([("x", "0-1"), ("9", ""), ("y", "7"), (None, None)], "id string, parcel string")
    permits = spark.createDataFrame([("1", "0 1", "expired", 0), ("2", "01", "current", 2), ("3", "01", "current", 1), ("9", None, "expired", 0)], "id string, parcel string, status string, ordinal int")
    got = {r.id: (r.records, r.primary) for r in lookups.property_records(properties, permits).collect()}
    assert got == {"x": (["1", "3", "2"], "3"), "9": (["9"], "9")}
    assert lookups.property_records(properties.limit(0), permits).count() == 0
    near = lookups.permit_distances(spark.createDataFrame([("a", "1", "", 0.0, 0.0), ("b", "2", "B", 0.0, 0.001), ("c", "3", None, None, None), ("d", "4", "D", 0.0, 0.01)], "id string, parcel string, owner string, lon double, lat double"), spark.createDataFrame([("1", "P", 540.0), ("1", "Q", 500.0)], "parcel string, owner string, distance_m double"), F.lit(0.0), F.lit(0.0))
    assert sorted((r.id, r.owner, r.distance_basis) for r in near.collect()) == [("a", "Q", "parcel boundary"), ("b", "B", "permit point")]
    rows = spark.createDataFrame(
        [("equal", 0.1, 0.1, None, 0.1, 0.1, None), ("street", 0.1, 0.1, "1 Oak St., X", 9.0, 9.0, "1 OAK ST"), ("held", 0.1, 0.1, "", 0.9, 0.9, ""), ("apart", 0.1, 0.1, None, 2.0, 2.0, None), ("none", 0.1, 0.1, "a", None, None, "a"), ("lost", None, None, None, 1.0, 1.0, None)],
        "listing_id string, lon double, lat double, address string, actual_lon double, actual_lat double, actual_address string",
    )
    parcels = spark.range(1).select(geo.box(0.0, 0.0, 1.0, 1.0).alias("rings"))
    said = lookups.same_parcel(rows, parcels, 0.5)
    assert {r.listing_id for r in said.where("same_parcel").collect()} == {"equal", "street", "held"} and said.count() == 6
    drawn = lookups.location_features(said).collect()
    assert [(r.listing_id, r.location_kind, len(r.points)) for r in drawn] == [("apart", "approximate", 1), ("apart", "actual", 1), ("apart", "connection", 2)]
    features = spark.createDataFrame([(1, "u", 0.0, 0.0), (2, "", 1.0, 1.0), (3, None, 7.0, 7.0), (4, "w", 1.0, 1.0)], "feature_id int, url string, lon double, lat double")
    listed = spark.createDataFrame([("a", "u", 1.0, 1.0, 0), ("b", "v", 1.0, 1.0, 1)], "listing_id string, url string, lon double, lat double, ordinal int")
    assert {r.feature_id: r.listing_id for r in lookups.license_connections(features, listed).collect()} == {1: "a", 2: "b", 3: None, 4: None}
    points = spark.createDataFrame([("n", 0.0, 0.0), ("f", 1.0, 1.0), ("x", None, None)], "id string, lon double, lat double")
    assert [r.id for r in lookups.with_neighbor(points, spark.createDataFrame([(0.0, 0.004)], "r_lon double, r_lat double")).collect()] == ["n"]
    g = spark.createDataFrame([("a", 2), ("a", 1), ("b", 1)], "g string, o int")
    assert sorted(tuple(r) for r in lookups.sized_groups(g, "g", "o").collect()) == [("a", 1, 2, 0), ("a", 2, 2, 1), ("b", 1, 1, 0)]
    assert sorted(tuple(r) for r in lookups.grouped_status(g, "g", "o").collect()) == [("a", 2, 2), ("b", 1, 1)]


def test_polygon_pairs(spark):
    square = lambda x, y, w: [[[x, y], [x + w, y], [x + w, y + w], [x, y + w], [x, y]]]
    slope = [[[0.0, 1.5], [1.5, 0.0], [2.0, 2.0], [0.0, 1.5]]]
    shapes = [("big", square(0.0, 0.0, 4.0)), ("within", square(1.0, 1.0, 1.0)), ("touches", square(4.0, 0.0, 1.0)), ("corner", square(4.0, 4.0, 1.0)), ("far", square(9.0, 9.0, 1.0)), ("near slope", square(0.0, 0.0, 0.7)), ("slope", slope)]
    a = spark.createDataFrame(shapes, "a string, rings array<array<array<double>>>")
    for size in (0.3, 2.5, 50.0):
        got = spatial.polygon_pairs(a, a.toDF("b", "b_rings"), "rings", "b_rings", size).where("a < b").select("a", "b").collect()
        assert sorted(map(tuple, got)) == [("big", "corner"), ("big", "near slope"), ("big", "slope"), ("big", "touches"), ("big", "within"), ("slope", "within")]
    assert spatial.polygon_pairs(a.limit(0), a.toDF("b", "b_rings"), "rings", "b_rings", 1.0).count() == 0


def test_remote(spark, tmp_path):
    cache, asked = f"file://{tmp_path}/cache.json", []

    def giving(raw):
        def fetch(n):
            asked.append(n)
            if isinstance(raw, Exception):
                raise raw
            return raw[:n]

        return fetch

    get = lambda raw, now, **k: [r.asDict() for r in remote.refresh(spark, cache, giving(raw), "url", now, **k).collect()]
    assert get(OSError("down"), 0.0) == []
    first = [{"url": "a", "note": "x\ny"}, {"url": "b", "note": None}]
    assert get("\ufeffurl,note\na,\"x\ny\"\n\nb\n".encode(), 300.0) == first and len(asked) == 2
    assert get(b"url\nc\n", 400.0) == first and len(asked) == 2
    for raw in (OSError("down"), b"other\n1\n", b"", b"url\n" + b"x" * 50, b"url\n\xff"):
        assert get(raw, 900.0, force=True, most=20) == first
    assert json.loads((tmp_path / "cache.json").read_text())["error"]
    assert get(b"url\nc\n", 901.0) == first and get(b"url\nc\n", 1200.0) == [{"url": "c"}]


def test_names_tool(spark, tmp_path):
    (tmp_path / "n.csv").write_text("name1,relationship,name2\nRobert ,has_nickname,Bob\nrobert,has_nickname,bob\nann,has_nickname,o'ann\n")
    run = lambda *a: tools.main([*a, "-i", f"file://{tmp_path}/n.csv", "-o", f"file://{tmp_path}/out"], spark)
    lines = lambda: [r[0] for r in spark.read.text(f"file://{tmp_path}/out").collect()]
    run("normalize")
    assert lines() == ["name1,relationship,name2", "ann,has_nickname,o'ann", "robert,has_nickname,bob"]
    run("sql", "--type", "wide")
    assert lines()[0].startswith("CREATE TABLE nicknames (canonical_name") and "INSERT INTO nicknames (canonical_name, nickname_1) VALUES ('ann', 'o''ann');" in lines()
    run("sql")
    assert lines()[0].startswith("CREATE TABLE name_relationships") and len(lines()) == 4
    run("constant")
    assert len(json.loads(lines()[0])) == 3
    (tmp_path / "n.csv").write_text("a,b\n")
    with pytest.raises(SystemExit):
        run("normalize")


def test_only_tiles_of_the_views_are_opened(spark, tmp_path):
    from rentlens.functions import geo
    from rentlens.operators import lookups
    from rentlens.sources import sinks

    path = f"file://{tmp_path}/tiles"
    rows = spark.range(400).selectExpr("id", "-86 + (id % 20) * 0.01 + 0.005 as lon", "36 + floor(id / 20) * 0.01 + 0.005 as lat").coalesce(1)
    sinks.write_tiles(rows.withColumn("tile", geo.tile_key(F.col("lon"), F.col("lat"))), path)
    views = spark.createDataFrame([(1, -85.978, 36.012, -85.962, 36.028), (2, 5.0, 5.0, 4.0, 6.0), (3, None, 0.0, 1.0, 1.0)], "view int, west double, south double, east double, north double")
    found = lookups.in_views(views, path)
    got = {r.id for r in found.collect()}
    assert got == {r.id for r in rows.collect() if -85.978 <= r.lon <= -85.962 and 36.012 <= r.lat <= 36.028} and got
    plan = found._jdf.queryExecution()
    assert "dynamicpruning" in plan.toString().lower()
    leaves = plan.executedPlan().toString()
    assert "FileScan parquet" in leaves
    scans = [n for n in _nodes(plan.executedPlan()) if n.nodeName().startswith("Scan parquet")]
    opened = [n.metrics().apply("numFiles").value() for n in scans]
    assert sum(opened) <= 9 < len(list((tmp_path / "tiles").glob("tile=*")))


def _nodes(plan):
    """A physical plan's nodes, those of its final adaptive stages too."""
    out, todo = [], [plan]
    while todo:
        p = todo.pop()
        out.append(p)
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
        elif "QueryStage" in name:
            todo.append(p.plan())
        else:
            todo += [p.children().apply(i) for i in range(p.children().size())]
    return out
