"""Path measurement, splitting, simplification and repair queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayline import fixed_values as V
from wayline.functions.geo import array_path_km, geometry_sha256, segment_distance, text_sha256, token
from wayline.operators import paths as P
from wayline.operators import repair as G
from wayline.operators.polyline import decode_polyline, distinct_shapes, encode_polyline
from wayline.operators.simplify import simplify
from wayline.operators.water import dry_runs, failing_routes, inland_controls
from wayline.operators.regions import edges_from_rings
from wayline.session import cut_lineage
from wayline.plans.base import (
    FIX, FIXPATH, SHAPE, SHAPEPT, TRACK, WPATH, edge_values, fix_scan, fixes, inside_cte, km, query, r6, shapes, table, track,
    track_scan, with_ctes,
)

LEGS = f"""legs AS (SELECT *, {km('pl', 'pa', 'lng', 'lat')} AS leg_km FROM (SELECT *, lag(lng) OVER w AS pl, lag(lat) OVER w AS pa,
  row_number() OVER w - 1 AS ix FROM track WINDOW w AS ({WPATH})))"""
TOK = "printf('%.5f,%.5f', lng, lat)"
PTOK = "printf('%.5f,%.5f', pl, pa)"


@query("WN01 FN01", with_ctes(TRACK, LEGS, "SELECT path, id, round(leg_km, 6) AS leg_km FROM legs WHERE leg_km IS NOT NULL"))
def chord_lengths(spark, sf):
    rows = P.with_legs(track_scan(spark, sf)).df
    return rows.where(F.col("leg_km").isNotNull()).select("path", "id", r6(F.col("leg_km")).alias("leg_km"))


@query("AG16", with_ctes(TRACK, LEGS, "SELECT path, count(*) AS points, round(coalesce(sum(leg_km), 0), 6) AS length_km FROM legs GROUP BY path"))
def path_length(spark, sf):
    return P.path_lengths(track_scan(spark, sf)).withColumn("length_km", r6(F.col("length_km")))


@query("AG16", with_ctes(SHAPE, SHAPEPT, f"""
SELECT vec_id, round(coalesce(sum({km('pl', 'pa', 'lng', 'lat')}), 0), 6) AS length_km FROM (SELECT *, lag(lng) OVER w AS pl, lag(lat) OVER w AS pa
FROM shapept WINDOW w AS (PARTITION BY vec_id ORDER BY ix)) GROUP BY vec_id"""))
def row_path_length(spark, sf):
    return shapes(spark, sf).select("vec_id", r6(array_path_km(F.col("points"))).alias("length_km"))


@query("QC01", with_ctes(TRACK, LEGS, """
SELECT 'max_chord' AS check_id, CAST(path AS VARCHAR) AS key, printf('%.1f', floor(leg_km * 10 + 0.5) / 10) || ' km' AS detail FROM legs WHERE leg_km > 20.05"""))
def long_chords(spark, sf):
    from wayline.operators.quality import long_chords as check

    return check(track_scan(spark, sf), F.col("path"))


@query("WN04 WN03 FN04", with_ctes(TRACK, LEGS, f"""ends AS (SELECT path, arg_min(lng, (ts_us, id)) AS x0, arg_min(lat, (ts_us, id)) AS y0, arg_max(lng, (ts_us, id)) AS x1,
  arg_max(lat, (ts_us, id)) AS y1 FROM track GROUP BY path),
sc AS (SELECT *, 111.32 * cos(radians((y0 + y1) / 2)) AS kx FROM ends),
pr AS (SELECT l.*, ((lng - x0) * kx * (x1 - x0) * kx + (lat - y0) * 110.57 * (y1 - y0) * 110.57)
  / coalesce(nullif(sqrt(pow((x1 - x0) * kx, 2) + pow((y1 - y0) * 110.57, 2)), 0), 1) AS p FROM legs l JOIN sc USING (path))""", f"""
SELECT path, id, round(coalesce(sum(leg_km) OVER w, 0), 6) AS cum_km, round(p, 6) AS progress_km, round(max(p) OVER w, 6) AS peak_km FROM pr WINDOW w AS ({WPATH})"""))
def path_progress(spark, sf):
    rows = P.with_progress(P.with_cumulative(track_scan(spark, sf))).df
    return rows.select("path", "id", *[r6(F.col(c)).alias(c) for c in ("cum_km", "progress_km", "peak_km")])


@query("AG17 WN03 WN05", with_ctes(TRACK, LEGS, f"""ends AS (SELECT path, arg_min(lng, (ts_us, id)) AS x0, arg_min(lat, (ts_us, id)) AS y0, arg_max(lng, (ts_us, id)) AS x1,
  arg_max(lat, (ts_us, id)) AS y1 FROM track GROUP BY path),
sc AS (SELECT *, 111.32 * cos(radians((y0 + y1) / 2)) AS kx FROM ends),
pr AS (SELECT l.*, ((lng - x0) * kx * (x1 - x0) * kx + (lat - y0) * 110.57 * (y1 - y0) * 110.57)
  / coalesce(nullif(sqrt(pow((x1 - x0) * kx, 2) + pow((y1 - y0) * 110.57, 2)), 0), 1) AS p FROM legs l JOIN sc USING (path)),
w AS (SELECT *, lag(p) OVER (PARTITION BY path ORDER BY ix) AS pp, max(p) OVER (PARTITION BY path ORDER BY ix) AS peak,
  coalesce(sum(leg_km) OVER (PARTITION BY path ORDER BY ix), 0) AS cum FROM pr),
f AS (SELECT *, min(ix) OVER (PARTITION BY path, {TOK}) AS fix0, min(cum) OVER (PARTITION BY path, {TOK}) AS cum0 FROM w)""", """
SELECT path, round(coalesce(sum(greatest(0, pp - p)) FILTER (WHERE pp IS NOT NULL), 0), 6) AS backtracking_km, round(max(peak - p), 6) AS max_drawdown_km,
  round(coalesce(max(cum - cum0) FILTER (WHERE ix - fix0 > 2), 0), 6) AS max_repeat_km FROM f GROUP BY path"""))
def loop_metrics(spark, sf):
    m = P.loop_metrics(track_scan(spark, sf))
    return m.select("path", *[r6(F.col(c)).alias(c) for c in ("backtracking_km", "max_drawdown_km", "max_repeat_km")])


RUN_BOX = (-72.0, 42.0, -69.0, 45.0)
RUNS = f"""flag AS (SELECT *, lng BETWEEN -72.0 AND -69.0 AND lat BETWEEN 42.0 AND 45.0 AS inside FROM fixpath),
grp AS (SELECT *, sum(CASE WHEN inside THEN 0 ELSE 1 END) OVER ({WPATH}) AS brk FROM flag),
big AS (SELECT path, brk, min(ts_us) AS t0 FROM grp WHERE inside GROUP BY path, brk HAVING count(*) >= 2)"""


@query("WN06", with_ctes(FIX, FIXPATH, RUNS, """
SELECT path, id, run FROM (SELECT path, brk, dense_rank() OVER (PARTITION BY path ORDER BY brk) AS run FROM big) JOIN grp USING (path, brk) WHERE inside"""))
def runs_in_box(spark, sf):
    rows = P.runs_in_box(fix_scan(spark, sf), RUN_BOX)
    return rows.select("path", "id", F.col("run").cast("bigint").alias("run"))


GAPS = f"""pc AS (SELECT *, sum(CASE WHEN leg_km > 20 THEN 1 ELSE 0 END) OVER ({WPATH}) AS brk FROM legs),
keep AS (SELECT path, brk, dense_rank() OVER (PARTITION BY path ORDER BY brk) AS piece FROM (SELECT path, brk FROM pc GROUP BY path, brk HAVING count(*) >= 2))"""


@query("WN07", with_ctes(TRACK, LEGS, GAPS, "SELECT path, id, piece FROM pc JOIN keep USING (path, brk)"))
def gap_split(spark, sf):
    rows = P.split_at_gaps(track_scan(spark, sf))
    return rows.select("path", "id", F.col("piece").cast("bigint").alias("piece"))


@query("WN02 FN05", with_ctes(TRACK, LEGS, f"SELECT path, id FROM legs WHERE pl IS NULL OR {TOK} != {PTOK}"))
def dedupe_consecutive(spark, sf):
    return P.dedupe_consecutive(track_scan(spark, sf)).select("path", "id")


@query("AG15", with_ctes(TRACK, "SELECT path, min(lng) AS west, min(lat) AS south, max(lng) AS east, max(lat) AS north FROM track GROUP BY path"))
def path_bbox(spark, sf):
    return P.bounding_boxes(track(spark, sf), ["path"])


SEG = f"'driving:' || least({PTOK}, {TOK}) || '|' || greatest({PTOK}, {TOK})"


@query("FN05 JN18", with_ctes(TRACK, LEGS, f"SELECT {SEG} AS segment, count(*) AS n FROM legs WHERE pl IS NOT NULL GROUP BY 1"))
def canonical_segments(spark, sf):
    rows = P.segments(track_scan(spark, sf)).df.where(F.col("prev_lng").isNotNull())
    return rows.groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


@query("AG11", with_ctes(TRACK, f"""pt AS (SELECT path, ts_us // 900000000 AS seq, ts_us // 900000000 // 4 AS part, lng, lat FROM track)""", """
SELECT path, part, count(*) AS points, string_agg(printf('%.2f %.2f', lng, lat), ',' ORDER BY seq, lng, lat) AS line FROM pt GROUP BY path, part"""))
def stops_in_order(spark, sf):
    """Point lists per hour; quarter hours tie, and ties go by position."""
    pts = track(spark, sf).withColumn("seq", F.floor(F.col("ts_us") / 900_000_000).cast("bigint"))
    parts = P.ordered_points(pts, ["path"], "seq", block=4)
    line = F.array_join(F.transform("points", lambda p: F.format_string("%.2f %.2f", p["lng"], p["lat"])), ",")
    return parts.select("path", "part", F.size("points").cast("bigint").alias("points"), line.alias("line"))


@query("AG12", with_ctes(SHAPE, "p2 AS (SELECT vec_id % 50 AS route, vec_id AS path, points FROM shape UNION ALL SELECT vec_id % 50, -1 - vec_id, points FROM shape WHERE vec_id % 3 = 0)", """
SELECT route, min(path) AS path, CAST(len(points) AS BIGINT) AS n FROM p2 GROUP BY route, points"""))
def distinct_paths(spark, sf):
    """A third of the paths occurs twice under another id, point for point."""
    s = shapes(spark, sf).select((F.col("vec_id") % 50).alias("route"), F.col("vec_id").alias("path"), "points")
    twice = s.unionByName(s.where(F.col("path") % 3 == 0).withColumn("path", F.lit(-1) - F.col("path")))
    return P.distinct_paths(twice.select("route", "path", F.posexplode("points").alias("ix", "p")).select("route", "path", "ix", "p.lng", "p.lat"), "route", "path")


@query("AG13", with_ctes(SHAPE, "s AS (SELECT label, points FROM shape UNION ALL SELECT label, points FROM shape WHERE vec_id % 4 = 0)", "SELECT label AS route, count(DISTINCT points) AS shapes FROM s GROUP BY label"))
def distinct_polylines(spark, sf):
    s = shapes(spark, sf)
    coded = s.unionByName(s.where(F.col("vec_id") % 4 == 0)).select(F.col("label").alias("route"), encode_polyline(F.col("points")).alias("polyline"))
    return distinct_shapes(coded).groupBy("route").agg(F.count(F.lit(1)).alias("shapes"))


@query("GEO01", with_ctes(SHAPE, SHAPEPT, "SELECT vec_id, CAST(ix AS INTEGER) AS ix, floor(lng * 1e5 + 0.5) / 1e5 AS lng, floor(lat * 1e5 + 0.5) / 1e5 AS lat FROM shapept"))
def decode_shapes(spark, sf):
    coded = shapes(spark, sf).select("vec_id", encode_polyline(F.col("points")).alias("polyline"))
    points = coded.select("vec_id", F.posexplode(decode_polyline("polyline")).alias("ix", "p"))
    return points.select("vec_id", "ix", "p.lng", "p.lat")


@query("GEO01", with_ctes(SHAPE, SHAPEPT, """SELECT vec_id, CAST(ix AS INTEGER) AS ix, floor(lng * 1e5 + 0.5) / 1e5 AS lng, floor(lat * 1e5 + 0.5) / 1e5 AS lat FROM shapept WHERE vec_id % 3 != 1
UNION ALL SELECT vec_id, NULL, NULL, NULL FROM embeddings WHERE vec_id % 3 = 1"""))
def decode_damaged_shapes(spark, sf):
    """Every third polyline ends inside a number: it is rejected, its neighbours decode."""
    coded = shapes(spark, sf).select("vec_id", encode_polyline(F.col("points")).alias("polyline"))
    cut = F.when(F.col("vec_id") % 3 == 1, F.concat("polyline", F.lit("_"))).otherwise(F.col("polyline"))
    points = coded.select("vec_id", F.posexplode_outer(decode_polyline(cut)).alias("ix", "p"))
    return points.select("vec_id", "ix", "p.lng", "p.lat")


@query("FN06", with_ctes(SHAPE, SHAPEPT, """
SELECT vec_id, sha256('[' || string_agg(printf('%.6f,%.6f', lng, lat), '|' ORDER BY ix) || ']') AS sha FROM shapept GROUP BY vec_id"""))
def fingerprints(spark, sf):
    return shapes(spark, sf).select("vec_id", geometry_sha256(F.col("points")).alias("sha"))


@query("FN06", "SELECT doc_id, sha256(replace(text, chr(13) || chr(10), chr(10))) AS sha FROM documents")
def text_fingerprints(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text_sha256(F.col("text")).alias("sha"))


@query("GEO09 SNK03", with_ctes(SHAPE, """fp AS (SELECT vec_id, sha256('[' || array_to_string([printf('%.6f,%.6f', p.lng, p.lat) for p in points], '|') || ']') AS sha FROM shape),
m AS (SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN 'old' ELSE sha END AS sha FROM fp WHERE vec_id % 7 != 0 UNION ALL SELECT -1 - vec_id, sha FROM fp WHERE vec_id % 50 = 0)""", """
SELECT 'fingerprint' AS check_id, CAST(coalesce(a.vec_id, m.vec_id) AS VARCHAR) AS key, CASE WHEN a.sha IS NULL THEN 'missing' WHEN m.sha IS NULL THEN 'extra' ELSE 'changed' END AS detail
FROM fp a FULL OUTER JOIN m ON a.vec_id = m.vec_id WHERE a.sha IS NULL OR m.sha IS NULL OR a.sha != m.sha"""))
def fingerprint_diff(spark, sf):
    from wayline.operators.quality import fingerprint_changes

    fp = shapes(spark, sf).select("vec_id", geometry_sha256(F.col("points")).alias("sha"))
    reviewed = fp.where(F.col("vec_id") % 7 != 0).withColumn("sha", F.when(F.col("vec_id") % 10 == 0, "old").otherwise(F.col("sha")))
    gone = fp.where(F.col("vec_id") % 50 == 0).withColumn("vec_id", -1 - F.col("vec_id"))
    return fingerprint_changes(fp, reviewed.unionByName(gone), "vec_id")


def _split_sql(tolerance: float, chord: float | None) -> str:
    """Recursive definition: cut every span at its farthest point while it is beyond the tolerance."""
    middle = f"WHEN {km('ax', 'ay', 'ex', 'ey')} > {chord} THEN lo + (hi - lo + 1) // 2" if chord else ""
    dist = "sqrt(pow(lng - (ax + t * (ex - ax)), 2) + pow(lat - (ay + t * (ey - ay)), 2))"
    return f"""span AS (SELECT path, CAST(0 AS BIGINT) AS lo, max(ix) AS hi FROM pt GROUP BY path
 UNION ALL
 SELECT path, unnest([lo, cut]), unnest([cut, hi]) FROM (
  SELECT path, lo, hi, CASE WHEN far > {tolerance} THEN at_ix {middle} END AS cut FROM (
   SELECT path, lo, hi, any_value(ax) AS ax, any_value(ay) AS ay, any_value(ex) AS ex, any_value(ey) AS ey, max({dist}) AS far, arg_max(ix, ({dist}, -ix)) AS at_ix FROM (
    SELECT *, CASE WHEN ax = ex AND ay = ey THEN 0 ELSE least(1, greatest(0, ((lng - ax) * (ex - ax) + (lat - ay) * (ey - ay)) / (pow(ex - ax, 2) + pow(ey - ay, 2)))) END AS t FROM (
     SELECT s.path, s.lo, s.hi, a.lng AS ax, a.lat AS ay, b.lng AS ex, b.lat AS ey, p.ix, p.lng, p.lat
     FROM span s JOIN pt p ON p.path = s.path AND p.ix > s.lo AND p.ix < s.hi JOIN pt a ON a.path = s.path AND a.ix = s.lo JOIN pt b ON b.path = s.path AND b.ix = s.hi))
   GROUP BY path, lo, hi))
 WHERE cut IS NOT NULL)"""


def _simplify_sql(tolerance: float, chord: float | None = None) -> str:
    pt = f"pt AS MATERIALIZED (SELECT path, row_number() OVER ({WPATH}) - 1 AS ix, lng, lat FROM track)"
    body = "SELECT path, ix, lng, lat FROM pt WHERE EXISTS (SELECT 1 FROM span s WHERE s.path = pt.path AND (s.lo = pt.ix OR s.hi = pt.ix))"
    return with_ctes(TRACK, pt, _split_sql(tolerance, chord), body, recursive=True)


def _track_ix(spark, sf):
    scan = track_scan(spark, sf).extend(position="ix")
    return scan.df.select("path", F.col("ix").cast("bigint").alias("ix"), "lng", "lat")


@query("GEO02 FN02", _simplify_sql(0.02))
def simplified(spark, sf):
    return simplify(_track_ix(spark, sf), ["path"], tolerance=0.02, dense=True)


@query("GEO03", _simplify_sql(0.05, 40.0))
def simplified_bus(spark, sf):
    return simplify(_track_ix(spark, sf), ["path"], tolerance=0.05, chord_km=40.0, dense=True)


@query("FN02", with_ctes(TRACK, f"""e AS (SELECT path, arg_min(lng, (ts_us, id)) AS ax, arg_min(lat, (ts_us, id)) AS ay, arg_max(lng, (ts_us, id)) AS ex, arg_max(lat, (ts_us, id)) AS ey
 FROM track GROUP BY path), j AS (SELECT path, id, lng, lat, ax, ay, ex, ey, CASE WHEN ax = ex AND ay = ey THEN 0 ELSE least(1, greatest(0, ((lng - ax) * (ex - ax) + (lat - ay) * (ey - ay))
 / (pow(ex - ax, 2) + pow(ey - ay, 2)))) END AS t FROM track JOIN e USING (path))""", """
SELECT path, id, round(sqrt(pow(lng - (ax + t * (ex - ax)), 2) + pow(lat - (ay + t * (ey - ay)), 2)), 6) AS off_axis FROM j"""))
def off_axis_distance(spark, sf):
    x, y = F.col("lng"), F.col("lat")
    rows = track_scan(spark, sf).extend(first={"ax": x, "ay": y}, last={"bx": x, "by": y}).df
    return rows.select("path", "id", r6(segment_distance(x, y, *[F.col(c) for c in ("ax", "ay", "bx", "by")])).alias("off_axis"))


# cached geometry of three in four gaps: a straight line with two inner points
ROADS = f"""gap AS (SELECT *, {SEG} AS segment FROM legs WHERE leg_km > 20),
road AS (SELECT DISTINCT segment, CASE WHEN {PTOK} < {TOK} THEN pl ELSE lng END AS ax, CASE WHEN {PTOK} < {TOK} THEN pa ELSE lat END AS ay,
  CASE WHEN {PTOK} < {TOK} THEN lng ELSE pl END AS ex, CASE WHEN {PTOK} < {TOK} THEN lat ELSE pa END AS ey FROM gap WHERE CAST(round(abs(lng + pl) * 100) AS BIGINT) % 4 != 0)"""


def _road_cache(spark, sf):
    gaps = G.find_gaps(track_scan(spark, sf)).where(F.round(F.abs(F.col("lng") + F.col("prev_lng")) * 100).cast("bigint") % 4 != 0)
    forward = F.col("from_token") < F.col("to_token")
    a = [F.when(forward, F.col(p)).otherwise(F.col(q)).alias(n) for n, p, q in (("ax", "prev_lng", "lng"), ("ay", "prev_lat", "lat"), ("bx", "lng", "prev_lng"), ("by", "lat", "prev_lat"))]
    ends = gaps.select("segment", *a).distinct()

    def at(k: int):
        t = k / 3
        return F.struct((F.col("ax") + (F.col("bx") - F.col("ax")) * t).alias("lng"), (F.col("ay") + (F.col("by") - F.col("ay")) * t).alias("lat"))

    return ends.select("segment", F.array(*[at(k) for k in range(4)]).alias("points"), F.lit(None).cast("string").alias("signature"), F.lit(V.ROAD_AUDIT_VERSION).alias("audit_version"))


@query("GEO04 JN18 WN07", with_ctes(TRACK, LEGS, ROADS, f"""m AS (SELECT l.path, l.ix, l.leg_km, r.segment IS NOT NULL AS fixed FROM legs l LEFT JOIN gap g ON g.path = l.path AND g.ix = l.ix
 LEFT JOIN road r ON r.segment = g.segment),
pc AS (SELECT *, sum(CASE WHEN leg_km > 20 AND NOT fixed THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY ix) AS brk, CASE WHEN fixed THEN 3 ELSE 1 END AS pts FROM m),
keep AS (SELECT path, brk, sum(pts) AS points, sum(CASE WHEN fixed THEN 1 ELSE 0 END) AS repairs FROM pc GROUP BY path, brk HAVING sum(pts) >= 2)""", """
SELECT path, dense_rank() OVER (PARTITION BY path ORDER BY brk) AS piece, CAST(points AS BIGINT) AS points, CAST(repairs AS BIGINT) AS repairs FROM keep"""))
def gap_repair(spark, sf):
    cache = cut_lineage(G.validate_roads(cut_lineage(_road_cache(spark, sf))).where(F.size("errors") == 0))
    rows = G.repair_gaps(track_scan(spark, sf).extend(position="ix").select("path", "ts_us", "id", "ix", "lng", "lat"), cache)
    return rows.groupBy("path", "piece").agg(
        F.count(F.lit(1)).alias("points"), F.count_if(F.col("repaired") & (F.col("sub") == 2)).alias("repairs")
    ).withColumn("piece", F.col("piece").cast("bigint"))


@query("JN20 SO03", with_ctes(TRACK, LEGS, ROADS, """used AS (SELECT DISTINCT segment FROM gap)""", """
SELECT segment, 'missing' AS kind FROM used WHERE segment NOT IN (SELECT segment FROM road)
UNION ALL SELECT 'x' || segment, 'stale' FROM road WHERE ax < -71.0"""))
def stale_keys(spark, sf):
    gaps = G.find_gaps(track_scan(spark, sf))
    cache = _road_cache(spark, sf)
    unused = cache.where(F.col("points")[0]["lng"] < -71.0).withColumn("segment", F.concat(F.lit("x"), "segment"))
    missing = G.missing_gaps(gaps, cache).select("segment", F.lit("missing").alias("kind")).distinct()
    return missing.unionByName(G.stale_segments(cache.unionByName(unused), gaps).select("segment", F.lit("stale").alias("kind")))


@query("GEO05 QC02 FN24", with_ctes(SHAPE, SHAPEPT, f"""tok AS (SELECT *, {TOK} AS tk, lag(lng) OVER w AS pl, lag(lat) OVER w AS pa, lag({TOK}) OVER w AS ptk FROM shapept
 WINDOW w AS (PARTITION BY vec_id ORDER BY ix)),
agg AS (SELECT vec_id, count(*) AS n, coalesce(sum({km('pl', 'pa', 'lng', 'lat')}), 0) AS routed, arg_min(lng, ix) AS x0, arg_min(lat, ix) AS y0, arg_max(lng, ix) AS x1, arg_max(lat, ix) AS y1,
 bool_or(tk = ptk) AS dup FROM tok GROUP BY vec_id),
d AS (SELECT *, CASE WHEN vec_id % 9 = 0 THEN x1 + 0.5 ELSE x1 END AS kx1 FROM agg),
e AS (SELECT *, {km('round(x0, 5)', 'round(y0, 5)', 'round(kx1, 5)', 'round(y1, 5)')} AS direct,
 least({km('round(x0, 5)', 'round(y0, 5)', 'x0', 'y0')} + {km('round(kx1, 5)', 'round(y1, 5)', 'x1', 'y1')}, {km('round(x0, 5)', 'round(y0, 5)', 'x1', 'y1')} + {km('round(kx1, 5)', 'round(y1, 5)', 'x0', 'y0')}) AS ends FROM d)""", """
SELECT vec_id, round(routed, 6) AS routed_km, round(direct, 6) AS direct_km, ends > 0.2 AS bad_ends, routed < direct * 0.9 AS short, routed > direct * 1.6 + 5 AS detour, coalesce(dup, FALSE) AS repeats FROM e"""))
def road_validation(spark, sf):
    def key_token(p, shift):
        return token(p["lng"] + shift, p["lat"])

    shift = F.when(F.col("vec_id") % 9 == 0, 0.5).otherwise(0.0)
    cache = shapes(spark, sf).select(
        "vec_id", "points",
        F.concat(F.lit("driving:"), key_token(F.col("points")[0], F.lit(0.0)), F.lit("|"), key_token(F.element_at("points", -1), shift)).alias("segment"),
        F.lit("").alias("signature"), F.lit(V.ROAD_AUDIT_VERSION).alias("audit_version"),
    )
    has = lambda name: F.array_contains("errors", name)
    return G.validate_roads(cache).select(
        "vec_id", r6(F.col("routed_km")).alias("routed_km"), r6(F.col("direct_km")).alias("direct_km"), has("endpoints do not match").alias("bad_ends"),
        has("shorter than the gap").alias("short"), has("detour").alias("detour"), has("consecutive duplicates").alias("repeats"),
    )


# land with a lake on it, an island in the lake, a pond on the island, and mapped water; no edge lies on the grid of the tracks
SHORE_RINGS = [
    ("L1", 0, 0, [(-73.0043, 41.0037), (-69.0043, 41.0037), (-69.0043, 45.0037), (-71.0043, 43.0037), (-73.0043, 45.0037)]),
    ("L2", 0, 0, [(-71.5137, 41.5137), (-70.5137, 41.5137), (-70.5137, 42.5137), (-71.5137, 42.5137)]),
    ("L3", 0, 0, [(-71.2131, 41.8131), (-70.8131, 41.8131), (-70.8131, 42.2131), (-71.2131, 42.2131)]),
    ("L4", 0, 0, [(-71.1173, 41.9173), (-70.9173, 41.9173), (-70.9173, 42.1173), (-71.1173, 42.1173)]),
    ("water", 0, 0, [(-72.5037, 42.0037), (-71.9037, 42.0037), (-71.9037, 43.5037), (-72.5037, 43.5037)]),
]


def _land_sql(body: str, buffer: float = V.WATER_BUFFER_DEG) -> str:
    """Every segment against every edge, cut at crossings and at the outline of the water buffer."""
    dx, dy, ux, uy = "(ex - sx)", "(ey - sy)", "(x2 - x1)", "(y2 - y1)"
    cross = f"({dx} * {uy} - {dy} * {ux})"
    offset = f"((x1 - sx) * {uy} - (y1 - sy) * {ux})"
    on_edge = f"(((x1 - sx) * {dy} - (y1 - sy) * {dx}) / {cross})"
    crossing = f"CASE WHEN {cross} != 0 AND {on_edge} BETWEEN 0 AND 1 THEN {offset} / {cross} END"
    outline = []
    for cx, cy in (("x1", "y1"), ("x2", "y2")):
        a, b = f"({dx} * {dx} + {dy} * {dy})", f"((sx - {cx}) * {dx} + (sy - {cy}) * {dy})"
        c = f"((sx - {cx}) * (sx - {cx}) + (sy - {cy}) * (sy - {cy}) - {buffer * buffer!r}::DOUBLE)"
        for sign in ("+", "-"):
            outline.append(f"CASE WHEN {a} > 0 AND {b} * {b} - {a} * {c} >= 0 THEN (-{b} {sign} sqrt({b} * {b} - {a} * {c})) / {a} END")
    for sign in ("+", "-"):
        outline.append(f"CASE WHEN {cross} != 0 THEN ({offset} {sign} {buffer!r}::DOUBLE * sqrt({ux} * {ux} + {uy} * {uy})) / {cross} END")
    near = "least(1, greatest(0, ((lng - e.x1) * (e.x2 - e.x1) + (lat - e.y1) * (e.y2 - e.y1)) / (pow(e.x2 - e.x1, 2) + pow(e.y2 - e.y1, 2))))"

    def reach(px: str, py: str) -> str:
        t = f"CASE WHEN x0 = x1 AND y0 = y1 THEN 0 ELSE least(1, greatest(0, (({px} - x0) * (x1 - x0) + ({py} - y0) * (y1 - y0)) / (pow(x1 - x0, 2) + pow(y1 - y0, 2)))) END"
        return f"sqrt(pow({px} - (x0 + ({t}) * (x1 - x0)), 2) + pow({py} - (y0 + ({t}) * (y1 - y0)), 2))"

    return with_ctes(
        TRACK, edge_values(SHORE_RINGS),
        f"ends AS (SELECT path, arg_min(lng, (ts_us, id)) AS ax, arg_min(lat, (ts_us, id)) AS ay, arg_max(lng, (ts_us, id)) AS bx, arg_max(lat, (ts_us, id)) AS fy FROM track GROUP BY path)",
        f"seg AS (SELECT * FROM (SELECT path, row_number() OVER w AS ix, lag(lng) OVER w AS sx, lag(lat) OVER w AS sy, lng AS ex, lat AS ey FROM track WINDOW w AS ({WPATH})) WHERE sx IS NOT NULL)",
        f"cand AS (SELECT path, ix, unnest(CASE WHEN region = 'water' THEN [{', '.join([crossing, *outline])}] ELSE [{crossing}] END) AS t FROM seg, edge)",
        "mark AS (SELECT DISTINCT path, ix, t FROM cand WHERE t > 0 AND t < 1 UNION ALL SELECT path, ix, 0.0::DOUBLE FROM seg)",
        "cutp AS (SELECT path, ix, t, coalesce(lead(t) OVER (PARTITION BY path, ix ORDER BY t), 1.0) AS u FROM mark)",
        """piece AS MATERIALIZED (SELECT row_number() OVER (ORDER BY path, ix, t) AS id, path, ix, t, sx + (ex - sx) * t AS x0, sy + (ey - sy) * t AS y0, sx + (ex - sx) * u AS x1, sy + (ey - sy) * u AS y1,
 sx + (ex - sx) * ((t + u) / 2) AS lng, sy + (ey - sy) * ((t + u) / 2) AS lat FROM cutp JOIN seg USING (path, ix) WHERE u > t)""",
        "mid AS (SELECT id, lng, lat FROM piece)", inside_cte("mid"),
        "lv AS (SELECT id, list(region) AS r FROM inside GROUP BY id)",
        f"nearw AS (SELECT DISTINCT id FROM mid, edge e WHERE region = 'water' AND sqrt(pow(lng - (e.x1 + {near} * (e.x2 - e.x1)), 2) + pow(lat - (e.y1 + {near} * (e.y2 - e.y1)), 2)) <= {buffer!r}::DOUBLE)",
        """cls AS (SELECT p.*, coalesce(((list_contains(r, 'L1') AND NOT list_contains(r, 'L2')) OR (list_contains(r, 'L3') AND NOT list_contains(r, 'L4'))) AND NOT list_contains(r, 'water'), FALSE)
 AND p.id NOT IN (SELECT id FROM nearw) AS dry FROM piece p LEFT JOIN lv USING (id))""",
        "opn AS (SELECT *, CASE WHEN dry AND NOT coalesce(lag(dry) OVER (PARTITION BY path ORDER BY ix, t), FALSE) THEN 1 ELSE 0 END AS o FROM cls)",
        "num AS (SELECT *, CAST(sum(o) OVER (PARTITION BY path ORDER BY ix, t) AS BIGINT) AS run FROM opn)",
        f"""runs AS (SELECT path, run, sum(sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2))) AS len, min(least({reach('ax', 'ay')}, {reach('bx', 'fy')})) < 0.0007 AS terminal
 FROM num JOIN ends USING (path) WHERE dry GROUP BY path, run)""",
        body,
    )


FAILS = "len > CASE WHEN terminal THEN 0.0045 ELSE 0.0018 END"


@query("GEO08 WN10", _land_sql(f"SELECT path, run, round(len, 6) AS length_deg, terminal, {FAILS} AS fails FROM runs"))
def land_runs(spark, sf):
    """Dry stretches of every track."""
    pts = track_scan(spark, sf).extend(position="ix").df.select("path", F.col("ix").cast("bigint").alias("ix"), "lng", "lat")
    runs = dry_runs(pts, edges_from_rings(spark, SHORE_RINGS), ["path"])
    return runs.select("path", F.col("run").cast("bigint").alias("run"), r6(F.col("length_deg")).alias("length_deg"), "terminal", "fails")


@query("AG21 ST03 GEO08", _land_sql(f"SELECT path, round(max(len), 6) AS longest_deg, count(*) AS runs, arg_max(terminal, len) AS terminal FROM runs WHERE {FAILS} GROUP BY path"))
def failing_paths(spark, sf):
    pts = track_scan(spark, sf).extend(position="ix").df.select("path", F.col("ix").cast("bigint").alias("ix"), "lng", "lat")
    worst = failing_routes(dry_runs(pts, edges_from_rings(spark, SHORE_RINGS), ["path"]), "path")
    return worst.withColumn("longest_deg", r6(F.col("longest_deg")))


def _near_sql(region: str, radius: float) -> str:
    t = "least(1, greatest(0, ((lng - x1) * (x2 - x1) + (lat - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2))))"
    return f"EXISTS (SELECT 1 FROM edge WHERE region {region} AND sqrt(pow(lng - (x1 + {t} * (x2 - x1)), 2) + pow(lat - (y1 + {t} * (y2 - y1)), 2)) <= {radius})"


@query("GEO11", with_ctes(FIX, edge_values(SHORE_RINGS), inside_cte("fix"), f""", lv AS (SELECT id, list(region) AS r FROM inside GROUP BY id)
SELECT id FROM fix JOIN lv USING (id) WHERE ((list_contains(r, 'L1') AND NOT list_contains(r, 'L2')) OR (list_contains(r, 'L3') AND NOT list_contains(r, 'L4')))
 AND NOT list_contains(r, 'water') AND NOT {_near_sql("= 'water'", 0.05 + 0.00018)} AND NOT {_near_sql("!= 'water'", 0.05)}""").replace("\n, lv", ", lv"))
def inland_points(spark, sf):
    pts = fixes(spark, sf).select("id", "lng", "lat")
    return inland_controls(pts, edges_from_rings(spark, SHORE_RINGS), ["id"], margin=0.05).select("id")
