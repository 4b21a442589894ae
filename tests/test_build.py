"""The whole build on an invented snapshot, hosts against licences, and the command line."""

import json

import pytest

from rentlens import cli
from rentlens.operators import hosts
from rentlens.plans import build

LON, LAT = -86.78, 36.16


def square(lon, lat, size):
    return {"type": "Polygon", "coordinates": [[[lon, lat], [lon + size, lat], [lon + size, lat + size], [lon, lat + size], [lon, lat]]]}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    r = tmp_path_factory.mktemp("snapshot")
    ids = ["100000000000000001", "100000000000000002", "100000000000000003", "4"]
    (r / "listing_urls.csv").write_text("url\n" + "\n".join(f"https://x.example/rooms/{i}" for i in ids) + "\n")
    (r / "listing_details.csv").write_text("listing_id,url,title,bedrooms,occupancy\n1.0E17,https://x.example/rooms/100000000000000001,Cottage,2,12\n,https://x.example/rooms/100000000000000002, ,3,4\n")
    for i, lon, more in ((ids[0], LON + 0.0005, {"bedrooms": 3, "host_name": "Bob", "description": "License 2023000001. Bachelorette parties"}), (ids[1], LON + 0.01, {"title": "Old Inn"}), (ids[2], LON + 0.5, {})):
        (r / "listing_results" / i).mkdir(parents=True)
        (r / "listing_results" / i / "metadata.json").write_text(json.dumps({"longitude": lon, "latitude": LAT + 0.0005, "privacy_radius_meters": 100, **more}))
    (r / "permits.csv").write_text("ObjectId,Permit #,Address,Parcel,Permit Owner Name,Permit Subtype Description,Permit Status,Expiration Date,Date Issued,Longitude,Latitude\n1,12 Oak St,12 Oak St,00000000001,EXAMPLE ROBERT,x,ISSUED,01/01/2030,,,\n2,2022000009,,00000000002,,x,ISSUED,2020-01-01,,,\n")
    (r / "permit_number_crosswalk.csv").write_text("object_id,permit_number,source_url\n1,2023000001,https://x.example\n2,2023000777, \n")
    (r / "names.csv").write_text("name1,relationship,name2\nrobert,has_nickname,bob\n")
    (r / "geography").mkdir()
    (r / "geography" / "county.geojson").write_text(json.dumps({"features": [{"properties": {"GEOID": "1"}, "geometry": square(LON - 0.05, LAT - 0.05, 0.1)}]}))
    parcels = [("1", "00000000001", "12 Oak St", "EXAMPLE ROBERT", LON), ("2", "00000000002", "14 Oak St", "ZED", LON + 0.0012)]
    (r / "Parcels.geojson").write_text(json.dumps({"features": [{"properties": {"OBJECTID": o, "STANPAR": p, "PropAddr": a, "Owner": w}, "geometry": square(lon, LAT, 0.001)} for o, p, a, w, lon in parcels]}))
    return r


def test_build(spark, root):
    made = build.build(spark, f"file://{root}", "2024-05-01")
    rows = {r.listing_id: r for r in made["listings"].collect()}
    assert set(rows) == {"100000000000000001", "100000000000000002", "4"}  # the third is far outside
    assert [r.listing_id for r in made["out_of_scope"].collect()] == ["100000000000000003"]
    a, b, c = rows["100000000000000001"], rows["100000000000000002"], rows["4"]
    assert (a.title, a.bedrooms, a.over_capacity, a.status, a.party) == ("Cottage", 3.0, 2.0, "current", True)
    assert (a.own_address, a.nearest_licensed_parcel_m, a.circle_overlaps_parcel, a.likely_unlicensed) == ("12 Oak St", 0.0, True, False)
    assert b.hotel.rule == "inn_default" and b.status == "unknown" and b.circle_overlaps_parcel is False and not b.likely_unlicensed
    assert c.point is None and c.circle_overlaps_parcel is None and c.boundary_distance_m is None
    assert {(m.parcel, m.type) for m in a.matches} == {("00000000001", "license_number"), ("00000000001", "permit_owner_nickname"), ("00000000002", "distance")}
    assert [m.type for m in a.preliminary_matches] == ["license_number", "permit_owner_nickname"] and a.auto_status == "licensed"
    assert {(r.field, r.before, r.after) for r in made["repairs"].collect()} >= {("bedrooms", "2.0", "3.0"), ("title", None, "Old Inn")}
    assert {r.id: (r.permit_number, r.status) for r in made["permits"].collect()} == {"1": ("2023000001", "current"), "2": ("2022000009", "expired")}
    report = made["report"].first()
    assert (report.listings, report.mapped, report.hotels, report.with_permits) == (3, 2, 1, 1) and report.listing_statuses == {"current": 1, "unknown": 2}
    assert {r.parcel: r.status for r in made["parcels"].collect()} == {"00000000001": "current", "00000000002": "expired"}


def test_what_is_scanned(spark, tmp_path):
    """Metadata by its keys, files up to the host's details; the hotel text has all of the files."""
    from rentlens.sources import tables

    folder = tmp_path / "listing_results" / "7"
    folder.mkdir(parents=True)
    meta = {"license_number": "2023000001", "house_rules": "no karaoke", "summary": "license 2023000009, pool", "Title": "Flat"}
    (folder / "metadata.json").write_text(json.dumps(meta))
    (folder / "details.txt").write_text("guest_count: 5\n----------------------------------------\nPermit 2023000002. 5 guests · 2 bedrooms\n=== HOST DETAILS ===\nlicense 2023000003, hot tub")
    rows, bad = tables.scanned_listings(tables.listing_folders(spark, f"file://{tmp_path}/listing_results"))
    r = rows.first()
    assert {p.number for p in r.permits} == {"2023000001", "2023000002"} and set(r.amenities) == {"karaoke"}
    assert tuple(r.occupancy) == (5, 2) and "HOST DETAILS" in r.hotel_text and r.attrs["summary"].endswith("pool") and bad.count() == 0


def test_command_line(spark, root, tmp_path):
    cli.main([f"file://{root}", "--output", f"file://{tmp_path}/out", "--as-of", "2024-05-01"], spark)
    assert spark.read.parquet(f"file://{tmp_path}/out/listings").count() == 3
    assert json.loads((tmp_path / "out" / "scanner_status.json").read_text())["state"] == "built"
    with pytest.raises(SystemExit):
        cli.main(["x", "--interval", "1"], spark)


def test_hosts(spark):
    listings = spark.createDataFrame([("https://x.example/rooms/1", "Bill Poe", LON, LAT), ("https://x.example/rooms/2", "Ann", LON, LAT), ("https://x.example/rooms/3", "Marta Quill", LON, LAT + 0.007), ("https://x.example/rooms/4", None, None, None)], "url string, host_name string, lon double, lat double")
    licenses = spark.createDataFrame([("L1", "William Poe", LON, LAT + 0.001), ("L2", "Bill Poe", LON, LAT + 0.002), ("L3", "Quill Press", LON, LAT), ("L4", "Bill Poe", LON + 1, LAT)], "license_number string, business_name string, r_lon double, r_lat double")
    researched = spark.createDataFrame([("https://www.x.example/rooms/2",)], "url string")
    got = {r.url[-1]: r for r in hosts.match_hosts(listings, licenses, researched).collect()}
    assert [c.license_number for c in got["1"].candidates] == ["L2", "L1"] and got["1"].match_type == "exact_full_name" and got["1"].distance_band == "within_1km"
    assert got["2"].researched and got["2"].candidate_count == 0
    assert got["3"].candidate_count == 0  # a partial name over 500 m away
    assert got["4"].match_type is None
    assert {r.match_type: r.n for r in hosts.match_histogram(hosts.match_hosts(listings, licenses)).collect()} == {"exact_full_name": 1, "none": 3}
