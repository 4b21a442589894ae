"""Versions, keyed memory of scans, and spatial joins that are kept up."""

import json
import random

import pytest
from pyspark.sql import functions as F

from rentlens import cli
from rentlens.functions import geo
from rentlens.operators import delta, spatial
from rentlens.plans import build
from rentlens.sources import tables, versions
from rentlens.streaming import keyed


def test_a_reader_sees_one_whole_version(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}"
    made = lambda n: {t: spark.createDataFrame([(n,)], "n int") for t in ("a", "b")}
    seen = lambda: tuple(versions.table(spark, path, t).first()[0] for t in ("a", "b"))
    assert versions.current(spark, path) is None and versions.table(spark, path, "a") is None
    versions.commit(spark, path, made(1))
    point = versions._point

    def between(*args):
        assert seen() == (1, 1)  # the new tables are written, the old ones are current
        point(*args)
        assert seen() == (2, 2)

    monkeypatch.setattr(versions, "_point", between)
    held = versions.table(spark, path, "a")
    versions.commit(spark, path, made(2), keep=2)
    assert held.first()[0] == 1  # a reader of the old version goes on
    monkeypatch.setattr(versions, "_point", point)
    broken = {"a": made(3)["a"], "b": spark.range(1).select(F.raise_error(F.lit("lost")).alias("n"))}
    with pytest.raises(Exception, match="lost"):
        versions.commit(spark, path, broken)
    assert seen() == (2, 2)
    for n in (4, 5, 6):
        versions.commit(spark, path, made(n), keep=2)
    assert seen() == (6, 6) and len([p for p in tmp_path.iterdir() if p.name.startswith("v-")]) == 2


def test_keyed_updates(spark):
    scans = []

    def scan(asked):
        rows = [(r.key, r.signature * 10, r.signature == 13) for r in asked.collect()]
        scans.append(sorted(r[0] for r in rows))
        return spark.createDataFrame(rows, "key string, value long, failed boolean")

    def go(state, run, **now):
        df = spark.createDataFrame(list(now.items()), "key string, signature long")
        new = keyed.update(df, state, "key", scan, run)
        return spark.createDataFrame(new.collect(), new.schema)

    one = go(None, 1, a=1, b=2, c=13)
    assert {r.key: (r.value, r.signature, r.run) for r in one.collect()} == {"a": (10, 1, 1), "b": (20, 2, 1), "c": (130, None, 1)}
    two = go(one, 2, a=1, b=13, c=13)  # one changes and fails, one fails again
    assert {r.key: (r.value, r.signature, r.run) for r in two.collect()} == {"a": (10, 1, 1), "b": (20, None, 1), "c": (130, None, 1)}
    three = go(two, 3, b=4, c=3, d=5)  # one is gone, two recover, one is new
    assert {r.key: (r.value, r.signature, r.run) for r in three.collect()} == {"b": (40, 4, 3), "c": (30, 3, 3), "d": (50, 5, 3)}
    assert go(three, 4, b=4, c=3, d=5).count() == 3
    assert scans == [["a", "b", "c"], ["b", "c"], ["b", "c", "d"], []]


def _folder(root, name, meta):
    (root / "listing_results" / name).mkdir(parents=True, exist_ok=True)
    (root / "listing_results" / name / "metadata.json").write_text(meta)


def test_one_changed_folder_is_one_scan(spark, tmp_path, monkeypatch):
    for i in range(5):
        _folder(tmp_path, str(i), json.dumps({"title": f"Flat {i}"}))
    opened, real = [], tables.whole_files
    monkeypatch.setattr(tables, "whole_files", lambda spark, *globs: (opened.append(sorted(g.split("/")[-2] for g in globs)), real(spark, *globs))[1])
    folders, cache = f"file://{tmp_path}/listing_results", f"file://{tmp_path}/cache"
    titles = lambda found: {r.listing_id: r.attrs["title"] for r in found.collect()}
    first, bad = build.scanned(spark, folders, cache)
    assert titles(first) == {str(i): f"Flat {i}" for i in range(5)} and bad.count() == 0
    _folder(tmp_path, "3", json.dumps({"title": "Another flat"}))
    _folder(tmp_path, "4", "{no JSON, but longer than before}")
    second, bad = build.scanned(spark, folders, cache)
    assert titles(second) == {"0": "Flat 0", "1": "Flat 1", "2": "Flat 2", "3": "Another flat", "4": "Flat 4"}
    assert [r.listing_id for r in bad.collect()] == ["4"]
    third, _ = build.scanned(spark, folders, cache)
    _folder(tmp_path, "4", json.dumps({"title": "Mended"}))
    last, bad = build.scanned(spark, folders, cache)
    assert titles(last)["4"] == "Mended" and bad.count() == 0
    assert opened == [["0", "1", "2", "3", "4"], ["3", "4"], ["4"], ["4"]]
    assert {r.listing_id: r.run for r in last.collect()} == {"0": 1, "1": 1, "2": 1, "3": 2, "4": 3}


def _tables(spark, spots, boxes):
    points = spark.createDataFrame(spots, "n int, x double, y double")
    polygons = spark.createDataFrame(boxes, "id string, x0 double, y0 double, x1 double, y1 double")
    return points, polygons.select("id", geo.box(*map(F.col, ("x0", "y0", "x1", "y1"))).alias("rings"))


def test_kept_up_joins_equal_whole_ones_after_random_edits(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    spot = lambda i: (i, round(rng.uniform(0, 100), 1), round(rng.uniform(0, 100), 1))
    box = lambda i: (f"p{i}", x := rng.uniform(0, 100), y := rng.uniform(0, 100), x + rng.uniform(0, 9), y + rng.uniform(0, 9))
    spots, boxes = [spot(i) for i in range(50)] + [(99, None, 1.0)], [box(i) for i in range(12)]
    measured, real = [], spatial.polygons_within
    path = f"file://{tmp_path}"
    for step in range(4):
        points, polygons = _tables(spark, spots, boxes)
        monkeypatch.setattr(spatial, "polygons_within", lambda p, q, *a, **k: (measured.append((p.count(), q.count())), real(p, q, *a, **k))[1])
        measured.clear()
        close = delta.kept_up(spark, f"{path}/close", delta.within, points, polygons, 20.0)
        if step == 2:  # nothing has changed
            assert measured == [(0, 12), (50, 0)]
        near = delta.kept_up(spark, f"{path}/near", delta.nearest, points, polygons, 20.0)
        monkeypatch.setattr(spatial, "polygons_within", real)
        key = lambda df: sorted((r.x, r.y, r.id, round(r.distance_m, 9)) for r in df.collect())
        assert key(close) == key(delta.within(None, points, polygons, 20.0).results)
        assert key(near) == key(delta.nearest(None, points, polygons, 20.0).results)
        if step != 1:
            spots = [spot(i) if rng.random() < 0.1 else s for i, s in enumerate(spots)]
            boxes = [box(i) if rng.random() < 0.2 else b for i, b in enumerate(boxes) if rng.random() > 0.1] + [box(100 + step)]
            boxes = (boxes + [box(200 + step * 20 + i) for i in range(12)])[:12]
    points, polygons = _tables(spark, spots, [])
    assert delta.kept_up(spark, f"{path}/near", delta.nearest, points, polygons, 20.0).count() == 0


def test_watch_stops_and_publishes_versions(spark, tmp_path):
    (tmp_path / "listing_urls.csv").write_text("url\nhttps://x.example/rooms/7\n")
    (tmp_path / "STOP").write_text("")
    out = f"file://{tmp_path}/out"
    cli.main([f"file://{tmp_path}", "--output", out, "--as-of", "2024-05-01", "--watch", "--versions", "--interval", "5"], spark)
    assert [r.listing_id for r in versions.table(spark, out, "listings").collect()] == ["7"]
    assert versions.table(spark, out, "report").first().listings == 1
    assert json.loads((tmp_path / "out" / "scanner_status.json").read_text())["state"] == "stopped"


def test_written_tables_are_cleared(spark, tmp_path, monkeypatch):
    from rentlens.sources import sinks

    monkeypatch.setattr(sinks, "shared_dir", lambda spark: f"file://{tmp_path}")
    monkeypatch.setattr(sinks, "_written", [])
    assert [sinks.settled(spark.range(3)).count(), sinks.settled(spark.range(4)).count()] == [3, 4]
    assert len(list(tmp_path.iterdir())) == 2 and sinks.clear(spark) == 2
    assert not list(tmp_path.iterdir()) and sinks.clear(spark) == 0
