"""Geometry jobs against independent definitions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline import fixed_values as V
from wayline.functions.geo import haversine_km
from wayline.operators import paths as P
from wayline.operators import repair as G
from wayline.operators.polyline import decode_polyline, encode_polyline
from wayline.operators.regions import assign_regions, broadcast_bound, edges_from_rings, near_edges, within_radius
from wayline.operators.simplify import simplify
from wayline.operators.water import dry_runs


def km(a, b):
    (x1, y1), (x2, y2) = a, b
    h = math.sin(math.radians(y2 - y1) / 2) ** 2 + math.cos(math.radians(y1)) * math.cos(math.radians(y2)) * math.sin(math.radians(x2 - x1) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(h))


def walk(rng, n, step=0.01):
    x, y = -71.0, 42.0
    out = []
    for _ in range(n):
        x, y = x + rng.uniform(-step, step * 1.5), y + rng.uniform(-step, step)
        out.append((round(x, 5), round(y, 5)))
    return out


def long_form(spark, paths):
    rows = [(name, i, x, y) for name, pts in paths.items() for i, (x, y) in enumerate(pts)]
    return spark.createDataFrame(rows, "path string, ix bigint, lng double, lat double")


def off(p, a, b):
    (x, y), (ax, ay), (bx, by) = p, a, b
    d2 = (bx - ax) ** 2 + (by - ay) ** 2
    t = 0 if d2 == 0 else max(0, min(1, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / d2))
    return math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay))


def kept_by_definition(pts, tol, chord):
    kept, todo = {0, len(pts) - 1}, [(0, len(pts) - 1)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 2:
            continue
        far = max(range(lo + 1, hi), key=lambda i: (off(pts[i], pts[lo], pts[hi]), -i))
        if off(pts[far], pts[lo], pts[hi]) > tol:
            cut = far
        elif chord and km(pts[lo], pts[hi]) > chord:
            cut = lo + (hi - lo + 1) // 2
        else:
            continue
        kept.add(cut)
        todo += [(lo, cut), (cut, hi)]
    return kept


@pytest.mark.parametrize("local_points", [20_000, 40])
@pytest.mark.parametrize("chord", [None, 3.0])
def test_simplify_matches_definition(spark, local_points, chord):
    rng = random.Random(1)
    paths = {"long": walk(rng, 300), "short": walk(rng, 12), "pair": walk(rng, 2), "loop": [(-71.0, 42.0), (-71.1, 42.1), (-71.0, 42.0)]}
    got = simplify(long_form(spark, paths), ["path"], tolerance=0.004, chord_km=chord, local_points=local_points).collect()
    for name, pts in paths.items():
        ixs = [r.ix for r in got if r.path == name]
        assert len(ixs) == len(set(ixs))
        assert set(ixs) == kept_by_definition(pts, 0.004, chord)


def test_polyline_round_trip(spark):
    known = spark.createDataFrame([("_p~iF~ps|U_ulLnnqC_mqNvxq`@",), ("",), (None,)], "s string")
    rows = [r[0] for r in known.select(decode_polyline("s")).collect()]
    assert [(p.lng, p.lat) for p in rows[0]] == [(-120.2, 38.5), (-120.95, 40.7), (-126.453, 43.252)]
    assert rows[1] == [] and rows[2] is None
    rng = random.Random(2)
    paths = [[(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(n)] for n in (1, 2, 50)]
    df = spark.createDataFrame([([{"lng": x, "lat": y} for x, y in p],) for p in paths], "pts array<struct<lng:double,lat:double>>")
    back = [r[0] for r in df.select(decode_polyline(encode_polyline(F.col("pts")))).collect()]
    for pts, out in zip(paths, back):
        assert [(p.lng, p.lat) for p in out] == [(math.floor(x * 1e5 + 0.5) / 1e5, math.floor(y * 1e5 + 0.5) / 1e5) for x, y in pts]


def winding(p, ring):
    x, y = p
    w = 0
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        side = (x2 - x1) * (y - y1) - (x - x1) * (y2 - y1)
        if y1 <= y < y2 and side > 0:
            w += 1
        elif y2 <= y < y1 and side < 0:
            w -= 1
    return w != 0


@pytest.mark.parametrize("bound", [1000, 0])
def test_regions_match_winding_rule(spark, bound):
    rng = random.Random(3)
    star = [(-71 + (0.5 + 0.4 * (i % 2)) * math.cos(i * math.pi / 7), 42 + (0.5 + 0.4 * (i % 2)) * math.sin(i * math.pi / 7)) for i in range(14)]
    hole = [(-71.2, 41.9), (-70.8, 41.9), (-70.8, 42.2), (-71.2, 42.2)]
    island = [(-71.05, 41.95), (-70.95, 41.95), (-70.95, 42.05), (-71.05, 42.05)]
    edges = edges_from_rings(spark, [("a", 0, 0, star), ("a", 0, 1, hole), ("a", 1, 0, island), ("b", 0, 0, hole)])
    pts = [(i, rng.uniform(-72, -70), rng.uniform(41, 43)) for i in range(800)]
    df = spark.createDataFrame(pts, "id int, lng double, lat double")
    with broadcast_bound(bound):
        rows = assign_regions(df, edges)
    for r in rows.collect():
        p = (r.lng, r.lat)
        want = {"b"} if winding(p, hole) else set()
        if (winding(p, star) and not winding(p, hole)) or winding(p, island):
            want.add("a")
        assert set(r.regions) == want


def test_near_edges_and_radius_use_both_join_paths(spark):
    rng = random.Random(4)
    ring = [(-71.5, 41.5), (-70.5, 41.5), (-70.7, 42.5)]
    edges = edges_from_rings(spark, [("a", 0, 0, ring)])
    df = spark.createDataFrame([(i, rng.uniform(-72, -70), rng.uniform(41, 43)) for i in range(400)], "id int, lng double, lat double")
    circles = spark.createDataFrame([(c, rng.uniform(41, 43), rng.uniform(-72, -70), rng.uniform(5, 60)) for c in range(20)], "c int, lat0 double, lng0 double, radius_km double")
    want_circles = circles.collect()
    for bound in (1000, 0):
        with broadcast_bound(bound):
            near, within = near_edges(df, edges, 0.1, "near", ["id"]), within_radius(df, circles)
        for r in near.collect():
            assert r.near == any(off((r.lng, r.lat), a, b) <= 0.1 for a, b in zip(ring, ring[1:] + ring[:1]))
        pairs = {(r.id, r.c) for r in within.collect()}
        assert pairs == {(r.id, c.c) for r in df.collect() for c in want_circles if km((c.lng0, c.lat0), (r.lng, r.lat)) <= c.radius_km}


def test_dry_runs_match_fine_sampling(spark):
    """Lengths on land by dense sampling of the path against the shoreline levels and the water buffer."""
    rings = {
        "L1": [(-72.0, 41.0), (-70.0, 41.0), (-70.0, 43.0), (-71.0, 42.2), (-72.0, 43.0)], "L2": [(-71.7, 41.3), (-70.6, 41.3), (-70.6, 41.9), (-71.7, 41.9)],
        "L3": [(-71.4, 41.5), (-71.0, 41.5), (-71.0, 41.8), (-71.4, 41.8)], "water": [(-71.95, 42.0), (-71.5, 42.0), (-71.5, 42.4), (-71.95, 42.4)],
    }
    edges = edges_from_rings(spark, [(k, 0, 0, r) for k, r in rings.items()])
    rng = random.Random(6)
    paths = {f"p{i}": [(rng.uniform(-72.4, -69.6), rng.uniform(40.8, 43.2)) for _ in range(5)] for i in range(6)}
    buffer = 0.02

    def dry(p):
        inside = {k for k, r in rings.items() if winding(p, r)}
        land = ("L1" in inside and "L2" not in inside) or "L3" in inside
        w = rings["water"]
        return land and "water" not in inside and min(off(p, a, b) for a, b in zip(w, w[1:] + w[:1])) > buffer

    got = dry_runs(long_form(spark, paths), edges, ["path"], buffer=buffer).collect()
    for name, pts in paths.items():
        runs, current, was = [], 0.0, False
        for (x1, y1), (x2, y2) in zip(pts, pts[1:]):
            n = 4000
            step = math.hypot(x2 - x1, y2 - y1) / n
            for i in range(n):
                t = (i + 0.5) / n
                now = dry((x1 + (x2 - x1) * t, y1 + (y2 - y1) * t))
                if now:
                    current += step
                if was and not now:
                    runs.append(current)
                    current = 0.0
                was = now
        if was:
            runs.append(current)
        mine = sorted(r.length_deg for r in got if r.path == name)
        assert len(mine) == len(runs)
        assert np.allclose(mine, sorted(runs), atol=3e-3)


def test_gap_repair_orients_cuts_and_reports(spark):
    a, b, c, d, e = (-71.0, 42.0), (-71.01, 42.0), (-71.5, 42.0), (-71.51, 42.0), (-72.1, 42.0)
    pts = long_form(spark, {"r": [a, b, c, d, e], "s": [c, b]})
    scan = P.path_scan(pts, chunk=F.floor(F.col("ix") / 2))
    key = G.find_gaps(scan).where("path = 'r' and ix = 2").first().segment
    road = [c, (-71.3, 42.01), (-71.2, 42.01), b]  # stored from the far end
    cache = spark.createDataFrame([(key, [{"lng": x, "lat": y} for x, y in road])], "segment string, points array<struct<lng:double,lat:double>>")
    rows = G.repair_gaps(scan, cache).orderBy("path", "ix", "sub").collect()
    r = [(x.lng, x.lat) for x in rows if x.path == "r"]
    assert r == [a, b, (-71.2, 42.01), (-71.3, 42.01), c, d]
    assert [(x.lng, x.lat) for x in rows if x.path == "s"] == [c, (-71.3, 42.01), (-71.2, 42.01), b]
    gaps = G.find_gaps(scan)
    assert {(x.path, x.ix) for x in G.missing_gaps(gaps, cache).collect()} == {("r", 4)}
    assert G.stale_segments(cache, gaps).count() == 0


def test_haversine_null_stays_null(spark):
    row = spark.range(1).select(haversine_km(F.lit(None).cast("double"), F.lit(1.0), F.lit(2.0), F.lit(3.0))).first()
    assert row[0] is None


def test_box_runs_number_only_kept_runs(spark):
    box = V.BUILD_BOX
    out, inn = (-80.0, 42.0), (-71.0, 42.0)
    pts = long_form(spark, {"p": [inn, out, inn, inn, out, inn, inn, inn]})
    rows = P.runs_in_box(P.path_scan(pts, chunk=F.floor(F.col("ix") / 3)), box).orderBy("ix").collect()
    assert [(r.ix, r.run) for r in rows] == [(2, 1), (3, 1), (5, 2), (6, 2), (7, 2)]


def test_polylines_are_decoded_in_slices():
    """No pass over a batch holds the digits of all its texts; a text beyond the code is null beside its neighbours."""
    import pyarrow as pa

    from wayline.operators import polyline

    seen, whole = [], polyline._decode_texts
    texts = ["_p~iF~ps|U_ulLnnqC_mqNvxq`@", None, "", "_p~iF一~ps|U", "_p~iF"] * 20_000
    polyline._decode_texts = lambda part: seen.append(sum(len(t or "") for t in part)) or whole(part)
    try:
        got = polyline._decode_batch(pa.array(texts))
    finally:
        polyline._decode_texts = whole
    line = [{"lng": -120.2, "lat": 38.5}, {"lng": -120.95, "lat": 40.7}, {"lng": -126.453, "lat": 43.252}]
    assert got.slice(0, 5).to_pylist() == [line, None, [], None, None] and got.slice(99_995).to_pylist() == got.slice(0, 5).to_pylist()
    assert len(got) == len(texts) and max(seen) <= polyline.SLICE_BYTES
