"""File sources, route assembly and normalisers on small fixtures."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from wayline import schemas as S
from wayline.operators import normalise as N
from wayline.operators.regions import assign_regions, edges_from_features, edges_from_rings
from wayline.operators.routes import assemble_routes, station_features
from wayline.sources import files as L
from wayline.sources import messages as M

TABLES = {
    "routes": "route_id,agency_id,route_short_name,route_long_name,route_type\nr1,a1,1,Shore Line,3\nr2,a1,,Harbor Ferry,4\nr9,a1,9,Tram,0\nrx,a1,X,Bad,x\n",
    "trips": "trip_id,route_id,shape_id,direction_id\nt1,r1,s1,0\nt2,r1,s1,1\nt3,r2,,0\nt4,r2,,0\n",
    "shapes": "shape_id,shape_pt_lat,shape_pt_lon,shape_pt_sequence\ns1,41.5,-72.0,2\ns1,41.5,-72.1,1\ns1,oops,-72.0,3\ns1,41.5,-71.95,4\ns1,41.5,-71.2,5\ns1,41.5,-71.19,6\n",
    "stops": "stop_id,stop_name,stop_code,stop_lat,stop_lon\nA,Alpha,AL,41.4,-72.0\nB,,,41.6,-71.9\nC,Far,,10.0,10.0\n",
    "stop_times": "trip_id,stop_id,stop_sequence\nt3,B,2\nt3,A,1\nt3,C,3\nt4,A,1\nt1,A,1\nt2,B,1\n",
}


@pytest.fixture(scope="module")
def zips(tmp_path_factory):
    folder = tmp_path_factory.mktemp("gtfs")
    with zipfile.ZipFile(folder / "feed1.zip", "w") as z:
        for name, text in TABLES.items():
            z.writestr(f"inner/{name.upper()}.TXT", "﻿" + text)
    return str(folder)


@pytest.fixture(scope="module")
def feed(spark):
    row = {"id": "feed1", "agency": "Shore Transit", "url": "u", "states": ["ct", "ny"], "include_stations": True, "record_feed_info": True, "agency_names": {"a1": "Shore & Co"}}
    text = spark.createDataFrame([(json.dumps(row),)], "v string")
    return text.select(F.from_json("v", S.STATIC_FEED).alias("r")).select("r.*").withColumnRenamed("id", "feed")


@pytest.fixture(scope="module")
def edges(spark):
    return edges_from_rings(spark, [("ct", 0, 0, [(-72.5, 41.0), (-71.5, 41.0), (-71.5, 42.0), (-72.5, 42.0)])])


def test_archives_read_members_by_name(spark, zips):
    routes = L.gtfs_archives(spark, zips, "routes").orderBy("row_ix").collect()
    assert [(r.feed, r.row_ix, r.route_id) for r in routes] == [("feed1", 0, "r1"), ("feed1", 1, "r2"), ("feed1", 2, "r9"), ("feed1", 3, "rx")]
    assert routes[0].route_url is None
    assert L.gtfs_archives(spark, zips, "feed_info").count() == 0


def test_route_assembly_end_to_end(spark, zips, feed, edges):
    gtfs = {t: L.gtfs_archives(spark, zips, t) for t in TABLES}
    none = spark.createDataFrame([], "segment string, points array<struct<lng:double,lat:double>>")
    out = assemble_routes(gtfs, feed, edges, none)
    features = {r.route: r for r in out["features"].collect()}
    assert set(features) == {"feed1:r1", "feed1:r2"}
    bus, ferry = features["feed1:r1"], features["feed1:r2"]
    assert (bus.grp, bus.name, bus.agency, bus.color, bus.regions) == ("bus", "1 · Shore Line", "Shore & Co", "#f2b84b", ["ct"])
    assert (ferry.grp, ferry.name, ferry.geometry_accuracy) == ("ferry", "Harbor Ferry", None)
    paths = {}
    for r in out["paths"].orderBy("route_id", "path", "ix").collect():
        paths.setdefault((r.route_id, r.path), []).append((r.lng, r.lat))
    # the 62 km gap has no road geometry: the bus path is cut there, and both sides are simplified
    assert sorted(p for (route, _), p in paths.items() if route == "r1") == [[(-72.1, 41.5), (-71.95, 41.5)], [(-71.2, 41.5), (-71.19, 41.5)]]
    # the shapeless ferry follows the stops of its first trip, and the far stop falls outside the box
    assert [p for (route, _), p in paths.items() if route == "r2"] == [[(-72.0, 41.4), (-71.9, 41.6)]]
    assert [(r.from_token, r.to_token) for r in out["missing"].collect()] == [("-71.95000,41.50000", "-71.20000,41.50000")]


def test_stations(spark, zips, feed, edges):
    gtfs = {t: L.gtfs_archives(spark, zips, t) for t in TABLES}
    included = spark.createDataFrame([("feed1", "r1"), ("feed1", "r2")], "feed string, route_id string")
    rows = {r.station_code: r for r in station_features(gtfs, feed.withColumn("group_override", F.lit("amtrak")), included, edges).collect()}
    assert set(rows) == {"AL", "B"}
    assert rows["AL"].details == "Routes: 1 · Shore Line, Harbor Ferry"
    assert rows["B"].title == "Shore Transit station" and rows["B"].regions == ["ct"]
    assert rows["AL"].color == "#5b9bd5" and rows["AL"].route_ids == ["feed1:r1", "feed1:r2"]


def test_gtfs_folder_and_station_map(spark, tmp_path):
    for f, text in (("f1", "stop_id,stop_name,stop_lat,stop_lon\nA,Alpha,41.1234567,-72\nA,Again,41.2,-72\nB,,x,1\n"), ("f2", "stop_id,stop_name,stop_lat,stop_lon\nZ,,41,-71\n")):
        (tmp_path / f"feed={f}").mkdir()
        (tmp_path / f"feed={f}" / "stops.txt").write_text(text)
    got = {tuple(r) for r in L.station_map(L.gtfs_folder(spark, str(tmp_path), "stops")).select("feed", "stop", "name", "lat").collect()}
    assert got == {("f1", "A", "Again", 41.2), ("f2", "Z", "Z", 41.0)}


def test_boundary_file(spark, tmp_path):
    square = [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]
    other = [[[[5, 5], [6, 5], [6, 6], [5, 5]]], square]
    doc = {"features": [{"properties": {"key": "a"}, "geometry": {"type": "Polygon", "coordinates": square}}, {"properties": {"key": "b"}, "geometry": {"type": "MultiPolygon", "coordinates": other}}]}
    (tmp_path / "r.geojson").write_text(json.dumps(doc))
    edges = edges_from_features(L.region_features(spark, str(tmp_path / "r.geojson")))
    pts = spark.createDataFrame([(1.0, 1.0), (5.9, 5.5), (9.0, 9.0)], "lng double, lat double")
    assert [r.regions for r in assign_regions(pts, edges).orderBy("lng").collect()] == [["a", "b"], ["b"], []]


def test_feature_writers(spark, tmp_path):
    df = spark.createDataFrame([("x", "bus", 1.0, 2.0), ("y", "ferry", 3.0, 4.0)], "id string, grp string, lng double, lat double")
    L.write_features(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("grp = 'bus'").count() == 1
    assert json.loads(L.geojson_lines(df).first()[0])["geometry"] == {"type": "Point", "coordinates": [1.0, 2.0]}
    fp = spark.createDataFrame([("x", "1"), ("x", "2")], "id string, sha string")
    with pytest.raises(ValueError):
        L.write_manifest(fp, "id", str(tmp_path / "m"))


def test_line_pages_and_csv(spark, tmp_path):
    for i in (1, 2):
        page = {"features": [{"geometry": {"type": "LineString", "coordinates": [[i, 0], [i, 1]]}, "properties": {"NAME": f"R{i}", "RTTYP": "I"}}]}
        (tmp_path / f"p{i}.json").write_text(json.dumps(page))
    lines = L.line_features(spark, str(tmp_path / "*.json"), "NAME:string,RTTYP:string")
    assert {(r.file, r.routes) for r in L.source_counts(lines).collect()} == {("p1.json", 1), ("p2.json", 1)}
    assert L.explode_paths(lines, "NAME").count() == 4
    (tmp_path / "b.csv").write_bytes("Office Name,US port,Physical Address Province,Services,Travellers Hours Monday,Travellers Hours Saturday,Travellers Hours Seasonal,Travellers Hours Notes\nSt-Ren\xe9 \u2013 A,Derby VT,QC,HWY/B,,,,\n".encode("cp1252"))
    assert L.border_offices_csv(spark, str(tmp_path / "b.csv")).first().office_name == "St-René – A"


# the five train cases: freshness, dropped rows, predeparture, re-ageing, delay bands
BASE = dict(
    trainID="56-10", trainNum="56", routeName="Vermonter", trainState="Active", lat="42.3", lon="-72.6", heading="NW", velocity="58.2", origName="Washington",
    destName="St. Albans", updatedAt="2026-08-09T12:00:00Z", lastValTS="2026-08-09T11:59:00Z",
)
STATIONS = [("Springfield", "Departed", None, None), ("Holyoke", "Enroute", "2026-08-09T12:10:00Z", "2026-08-09T12:17:00Z"), ("St. Albans", "Enroute", None, None)]


def train(spark, **changes):
    row = {**BASE, "stations": STATIONS, **changes}
    names = [c.split()[0] for c in S.TRAIN.split("stations")[0].rstrip(", ").split(", ")] + ["stations"]
    return spark.createDataFrame([tuple(row[n] for n in names)], S.TRAIN)


def at(text):
    return F.lit(text).cast("timestamp")


def test_train_cases(spark):
    noon = at("2026-08-09 12:00:00")
    old = N.trains(train(spark, lastValTS="2026-08-09T11:52:00Z"), noon).first()
    assert (old.data_status, old.stale, old.bearing, old.has_bearing) == ("live", True, 315.0, True)
    assert old.status == "Next stop Holyoke · 7 min late" and old.meta == "train 56 · 58 mph" and old.dest == "Washington → St. Albans"
    assert N.trains(train(spark, trainState="Completed"), noon).count() == 0
    assert N.trains(train(spark, lat="39"), noon).count() == 0
    pre = N.trains(train(spark, trainState="Predeparture", lastValTS=None, updatedAt=None), noon).first()
    assert (pre.data_status, pre.stale, pre.status) == ("estimated", False, "Scheduled to depart Washington")
    fresh = N.trains(train(spark), noon)
    assert fresh.first().stale is False
    assert N.age_rows(fresh, at("2026-08-09 12:06:00")).first().stale is True
    assert N.trains(train(spark, lastValTS="never", updatedAt=None), noon).first().stale is True


def test_malformed_payload_is_kept_apart(spark):
    df = spark.createDataFrame([("{\"ac\":[{\"hex\":\"a\"}]}",), ("{broken",), (None,)], "payload string")
    parsed = M.parse(df, S.AIRCRAFT_MESSAGE)
    assert M.good(parsed).where("m is not null").count() == 1
    assert [r.payload for r in M.dead_letters(parsed).collect()] == ["{broken"]


def test_missing_roads_draw_nothing_and_legs_are_cut_once(spark, monkeypatch):
    from wayline.operators import routes
    from wayline.plans.base import REGISTRY

    made, legs = [], routes.route_legs
    monkeypatch.setattr(routes, "route_legs", lambda *a: made.append(1) or legs(*a), raising=False)
    REGISTRY["assembled_repaired_routes"].run(spark, "/root/testdata/sf0.001")
    assert len(made) == 1
    monkeypatch.setattr(routes, "simplify", None)
    assert REGISTRY["assembled_missing"].run(spark, "/root/testdata/sf0.001").count() > 0
