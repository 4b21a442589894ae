"""Work on pairs of near points in the task that finds them, against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rentlens.operators import candidates, cells, hosts, spatial

EARTH = 6371008.8


def metres(a, b):
    x1, y1, x2, y2 = map(math.radians, (*a, *b))
    return 2 * EARTH * math.asin(math.sqrt(min(1.0, math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2)))


@pytest.fixture(scope="module")
def points(spark):
    r = random.Random(5)
    spots = [(r.gauss(-86.78, 0.006), r.gauss(36.16, 0.006)) for _ in range(120)] + [(179.9999, 12.0), (-179.9999, 12.0), (10.0, 89.9999), (-170.0, 89.9999)]
    left = [(None if i in (3, 4) else i - 1 if i in (8, 9) else i, *spots[i % 124]) for i in range(240)] + [(999, None, 1.0), (998, 1.0, 95.0)]
    right = [(f"P{i}", i % 3, *spots[i % 124 - 1]) for i in range(300)] + [("none", 0, None, None)]
    return left, right, spark.createDataFrame(left, "k long, lon double, lat double"), spark.createDataFrame(right, "item string, rank int, r_lon double, r_lat double")


def lists(left, right, reach):
    out = {}
    for k, *at in left:
        if at[0] is not None and abs(at[1]) <= 90:
            near = [(rank, round(metres(at, xy), 3), item) for item, rank, *xy in right if xy[0] is not None and metres(at, xy) <= reach]
            if near:
                out.setdefault(k, []).extend(near)
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("rows", [20_000, 15])
def test_lists_and_best_of_near_points(spark, points, monkeypatch, rows):
    monkeypatch.setattr(cells, "ROWS", rows)  # crowded cells are split, and dealt
    monkeypatch.setattr(spatial, "PAIRS", 500)
    left, right, a, b = points
    want = lists(left, right, 550.0)
    got = candidates.lists_near(a, b, "k", "item", 550.0, "rank").collect()
    assert len(got) == len(want) and {r.k: r["items"] for r in got} == {k: [x[2] for x in v] for k, v in want.items()}
    best = candidates.best_near(a, b.withColumn("s", -F.col("rank").cast("double")), "k", 550.0, "s", ("item",)).collect()
    assert len(best) == len(want) and {r.k: (-r.s, r.distance_m, r["item"], r.candidate_count) for r in best} == {k: (*v[0], len(v)) for k, v in want.items()}


def test_near_points_are_not_shuffled_as_pairs(spark, points):
    _, _, a, b = points
    best = candidates.best_near(a, b.withColumn("s", F.lit(1.0)), "k", 550.0, "s", ("item",))
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan


def test_equal_scores_and_distances_go_to_the_least_column(spark):
    for items in ("ab", "ba"):
        df = spark.createDataFrame([(1, 0.5, 2.0, x) for x in items], "k int, score double, distance_m double, parcel string").coalesce(1)
        assert candidates.best_of(df, "k", columns=("parcel",)).first().parcel == "a"


def test_best_matches_are_the_first_of_the_lists(spark):
    r = random.Random(6)
    names = ["JOHN SMITH", "JOHNNY SMITH", "SMITH", "MARY MILLER", "MILLER LLC", "", None, "JON SMITH", "OAK HOUSE", "JOHN OAKS"]
    at = lambda: (r.gauss(-86.78, 0.006), r.gauss(36.16, 0.006))
    listings = spark.createDataFrame([(f"https://x.example/rooms/{i}", names[i % 10], *at()) for i in range(90)] + [("https://x.example/rooms/1", "SMITH", *at()), ("https://x.example/rooms/far", "SMITH", 0.0, 0.0)], "url string, host_name string, lon double, lat double")
    licences = spark.createDataFrame([(str(i), names[i * 7 % 10], *at()) for i in range(80)], "license_number string, business_name string, r_lon double, r_lat double")
    looked = spark.createDataFrame([("https://x.example/rooms/2/",)], "url string")
    columns = ["url", "host_name", "lon", "lat", "researched", "match_type", "score", "distance_m", "distance_band", "candidate_count"]
    for done in (looked, None):
        c = columns if done is not None else [x for x in columns if x != "researched"]
        want, got = (sorted(map(tuple, f(listings, licences, done).select(c).collect()), key=repr) for f in (hosts.match_hosts, hosts.best_matches))
        assert got == want and any(x[-1] > 1 for x in got)


@pytest.mark.parametrize("pairs", [1 << 19, 40])
def test_types_of_near_points_are_those_of_candidates(spark, monkeypatch, pairs):
    monkeypatch.setattr(spatial, "PAIRS", pairs)
    r = random.Random(8)
    words = ["bob", "robert", "rob", "oak", "ash", "llc", None]
    some = lambda most: None if r.random() < 0.05 else r.choices(words, [4, 4, 2, 4, 4, 1, 1], k=r.randint(0, most))
    at = lambda: (r.gauss(-86.78, 0.004), r.gauss(36.16, 0.004))
    listings = spark.createDataFrame([(f"l{i}", some(3), *at()) for i in range(90)] + [("none", ["bob"], None, 36.16), ("far", ["bob"], 0.0, 0.0)], "listing_id string, host_tokens array<string>, lon double, lat double")
    parcels = [None if i == 7 else f"P-{i}" for i in range(80)]
    properties = spark.createDataFrame([(i, parcels[i], some(3), *at()) for i in range(80)], "id int, parcel string, owner_tokens array<string>, r_lon double, r_lat double")
    owned = [(f"P{i % 60}", some(3), i, None if i % 11 == 0 else 500 - i) for i in range(200)] + [("P 5", ["bob", "oak"], None, 900)]
    permits = spark.createDataFrame(owned, "parcel string, owner_tokens array<string>, permit_id int, ordinal int")
    nick = {"bob": ["robert"], "robert": ["bob", "rob"], "rob": ["robert"]}
    near = spatial.within_radius(listings, properties.select("id", "r_lon", "r_lat"), 550.0).select("listing_id", "id", F.round("distance_m", 3).alias("distance_m"), "host_tokens")
    want = candidates.typed_matches(near, properties, permits, F.create_map(*(v for k, ns in nick.items() for v in (F.lit(k), F.array(*map(F.lit, ns))))))
    counts = candidates.typed_near(listings, properties, permits, nick, 550.0, ("id", "parcel"))
    rows = sorted(map(tuple, want.select("listing_id", "parcel", "type", "distance_m").collect()), key=repr)
    assert sorted(map(tuple, counts.select("listing_id", "parcel", "type", "distance_m").collect()), key=repr) == rows
    assert {x[2] for x in rows} == {p + k for p in ("", "permit_") for k in ("owner_name", "owner_first_name", "owner_nickname")} | {"distance"}
    ids = candidates.typed_near(listings, properties, permits, nick, 550.0, ("parcel", "permit_ids"))
    assert sorted(map(tuple, ids.select(*want.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


@pytest.mark.parametrize("name", ["typed_candidate_matches_whole", "haversine_radius_join"])
def test_queries_return_pairs_as_they_are_found(spark, name):
    from rentlens.plans.registry import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and not any(x in plan[: plan.index("MapInArrow")] for x in ("Join", "Exchange", "Sort ", "Aggregate"))


@pytest.mark.parametrize("parts", [1, 16])
def test_pairs_near_are_those_of_the_join(spark, points, monkeypatch, parts):
    monkeypatch.setattr(spatial, "PARTS", parts)
    monkeypatch.setattr(cells, "FEW", 10)
    _, _, a, b = points
    want = spatial.within_radius(a, b, 550.0).select("k", "item", "rank", F.round("distance_m", 3).alias("distance_m"))
    got = spatial.pairs_near(a, b, 550.0, ("k",), ("item", "rank"))
    assert got.count() > 1000 and sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert spatial.rounded(np.array([0.0005, 549.9994999, 12.0]), 3).tolist() == [0.001, 549.999, 12.0]


def test_files_of_pairs_are_small_where_points_are_copies(spark, tmp_path):
    r = random.Random(9)
    spots = [(r.gauss(-86.78, 0.001), r.gauss(36.16, 0.001)) for _ in range(100)]
    a = spark.createDataFrame([(i, *spots[i % 100]) for i in range(2000)], "k long, lon double, lat double")
    b = a.selectExpr("k AS item", "lon AS r_lon", "lat AS r_lat")
    spatial.pairs_near(a, b, 550.0, ("k",), ("item",)).write.parquet(str(tmp_path / "pairs"))
    rows = spark.read.parquet(str(tmp_path / "pairs")).count()
    assert rows > 3_900_000 and sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.4 * rows


def test_pieces_have_slices_of_both_sides(spark, monkeypatch):
    r = random.Random(10)
    near = [(i, r.gauss(-86.78, 0.003), r.gauss(36.16, 0.003)) for i in range(600)]
    b = spark.createDataFrame(near, "item long, r_lon double, r_lat double")
    monkeypatch.setattr(cells, "FEW", 10)
    monkeypatch.setattr(spatial, "SLICE", 50)
    for rows in (near, [(i, -86.78, 36.16) for i in range(600)]):  # many in one place, too
        a = spark.createDataFrame(rows, "k long, lon double, lat double")
        both, pieces = spatial._sliced(a, b, 550.0, ("k",), ("item",), ("lon", "lat"), ("r_lon", "r_lat"))
        held = both.groupBy(*cells.KEY).agg(F.count("__a").alias("a"), F.count("__b").alias("b")).collect()
        assert pieces > 100 and max(x.a for x in held) <= 100 and max(x.b for x in held) <= 100
        assert spatial.pairs_near(a, b, 550.0, ("k",), ("item",)).count() == sum(metres(x[1:], y[1:]) <= 550 for x in rows for y in near)


def test_pairs_of_a_tile_come_by_distance(spark, points, monkeypatch):
    _, _, a, b = points
    want = spatial.within_radius(a, b, 550.0).select("k", "item", F.round("distance_m", 3))
    both, _ = spatial._sliced(a, b, 550.0, ("k",), ("item",), ("lon", "lat"), ("r_lon", "r_lat"))
    batches = both.coalesce(1).sortWithinPartitions(*cells.KEY).toArrow().to_batches(9)
    whole = [x.to_pydict() for x in spatial._pair_cells(batches, 550.0, 3, "d")]
    assert all(x["d"] == sorted(x["d"]) for x in whole)
    monkeypatch.setattr(spatial, "TILE", 7)
    monkeypatch.setattr(spatial, "PAIRS", 20)
    parts = [x.to_pydict() for x in spatial._pair_cells(batches, 550.0, 3, "d")]
    assert max(len(x["d"]) for x in parts) == 20
    rows = sorted(map(tuple, want.collect()), key=repr)
    for got in (whole, parts):
        assert sorted((t for x in got for t in zip(x["k"], x["item"], x["d"], strict=True)), key=repr) == rows
    with pytest.raises(ValueError, match="digits"):
        spatial._near(*np.zeros((4, 3)), 550.0, 17)
