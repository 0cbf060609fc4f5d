"""Route and station feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayline import fixed_values as V
from wayline.operators import routes as R
from wayline.operators.ordered import first_wins
from wayline.operators.trips import select_routes
from wayline.plans.base import TRACK, edge_values, inside_cte, km, query, r6, region_edges, table, track, with_ctes
from wayline.plans.path_queries import _split_sql
from wayline.plans.trip_queries import CALL, FALL, ROUTE, TRIP, feeds, gtfs
from wayline.session import cut_lineage

FEEDCOL = """f AS (SELECT *, CASE feed WHEN 'f1' THEN 'amtrak' ELSE CASE kind WHEN 2 THEN 'commuter' WHEN 3 THEN 'bus' ELSE 'ferry' END END AS grp, CAST(route_id AS BIGINT) AS k FROM sel)"""


@query("PRJ17 JN25 FN21 FN14 AG14", with_ctes(ROUTE, FEEDCOL, f"""
SELECT feed || ':' || route_id AS route, grp, CASE WHEN feed = 'f2' THEN '#123456' WHEN grp = 'amtrak' THEN '#5b9bd5' ELSE CASE kind WHEN 2 THEN '#a58add' WHEN 3 THEN '#f2b84b' ELSE '#2eb7c5' END END AS color,
 CASE WHEN feed = 'f1' AND agency_id = '1' THEN 'Agency One' WHEN feed = 'f1' AND agency_id = '2' THEN 'Agency Two' ELSE 'Agency ' || right(feed, 1) END AS agency, label AS name,
 CASE WHEN feed = 'f3' THEN 'Feed maker' ELSE '{V.DEFAULT_PROVIDER}' END AS provider,
 '{V.SCHEDULE_NOTE}' || CASE WHEN k % 5 = 1 THEN ' · {V.ROAD_NOTE}' ELSE '' END AS schedule_note,
 CASE WHEN k % 3 = 0 THEN CASE WHEN feed IN ('f1', 'f3') THEN 'ct,ma' ELSE 'vt' END ELSE 'me,vt,boston' END AS regions,
 CASE WHEN k % 5 = 1 THEN 'approximate' END AS geometry_accuracy,
 CASE WHEN feed = 'f1' AND url IS NOT NULL THEN url ELSE '{V.DEFAULT_SOURCE_URL}' END AS source_url FROM f"""))
def route_properties(spark, sf):
    k = F.col("route_id").cast("bigint")
    found = F.when(k % 3 != 0, F.array(F.lit("boston"), F.lit("vt"), F.lit("me")))
    rows = select_routes(gtfs(spark, sf)["routes"], feeds(spark)).withColumns({"approximate": k % 5 == 1, "found": found})
    return R.route_properties(rows).select(
        "route", "grp", "color", "agency", "name", "provider", "schedule_note", F.array_join("regions", ",").alias("regions"), "geometry_accuracy", "source_url"
    )


@query("PRJ18 SO02 SO01", with_ctes("""s AS (SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'bus' WHEN 1 THEN 'ferry' WHEN 2 THEN 'plane' ELSE 'rocket' END AS grp FROM supplier)""", f"""
SELECT id, CASE WHEN id % 5 = 0 THEN 'reference' ELSE 'scheduled' END AS data_status, CASE WHEN id % 6 = 1 THEN 'surveyed' WHEN grp = 'ferry' THEN 'approximate' END AS geometry_accuracy,
 CASE WHEN grp = 'ferry' THEN '{V.WATER_NOTE}' END AS geometry_note, CASE grp WHEN 'bus' THEN '#f2b84b' WHEN 'ferry' THEN '#2eb7c5' WHEN 'plane' THEN '#9be1ff' ELSE '#8a949f' END AS color,
 CASE WHEN id % 2 = 0 THEN 'ct,me,boston,ny' ELSE 'me,ny' END AS regions FROM s"""))
def supplement_defaults(spark, sf):
    k = F.col("s_suppkey")
    rows = table(spark, sf, "supplier").select(
        k.alias("id"), F.when(k % 4 == 0, "bus").when(k % 4 == 1, "ferry").when(k % 4 == 2, "plane").otherwise("rocket").alias("grp"),
        F.when(k % 5 == 0, "reference").alias("data_status"), F.when(k % 6 == 1, "surveyed").alias("geometry_accuracy"),
        F.lit(None).cast("string").alias("geometry_note"), F.lit(None).cast("string").alias("provider"),
        F.when(k % 2 == 0, F.array(F.lit("boston"), F.lit("ct"))).alias("found"), F.array(F.lit("ny"), F.lit("me")).alias("declared"),
    )
    return R.supplement_properties(rows).select("id", "data_status", "geometry_accuracy", "geometry_note", "color", F.array_join("regions", ",").alias("regions"))


STATION_REGIONS = inside_cte("stp", key="stop_id")


@query("GEO10 AG18 JN06 JN01", with_ctes(ROUTE, TRIP, CALL, edge_values(), STATION_REGIONS, """, o(region, rk) AS (VALUES ('ct',1),('ma',2),('me',3),('nh',4),('ri',5),('vt',6),('boston',7)),
rg AS (SELECT stop_id, coalesce(string_agg(o.region, ',' ORDER BY rk), '') AS regions FROM inside LEFT JOIN o USING (region) GROUP BY stop_id),
cl AS (SELECT c.feed, stop_id, string_agg(DISTINCT label, ', ' ORDER BY label) AS names FROM call c JOIN trip t USING (feed, trip_id) JOIN sel r ON r.feed = t.feed AND r.route_id = t.route_id
 WHERE c.feed IN ('f1', 'f2') GROUP BY c.feed, stop_id)
SELECT feed, stop_id, s_name AS title, 'Agency ' || right(feed, 1) || ' station · ' || CASE WHEN s_suppkey % 2 = 0 THEN 'C' || s_suppkey ELSE stop_id END AS status, 'Routes: ' || names AS details,
 CASE feed WHEN 'f1' THEN '#5b9bd5' ELSE '#123456' END AS color, regions, lng, lat FROM cl JOIN stp USING (stop_id) JOIN rg USING (stop_id)""").replace("\n, o(region", ", o(region"))
def station_features(spark, sf):
    g = gtfs(spark, sf)
    chosen = select_routes(g["routes"], feeds(spark)).select("feed", "route_id")
    rows = R.station_features(g, feeds(spark), chosen, region_edges(spark))
    return rows.select(
        F.split_part(F.get("route_ids", F.lit(0)), F.lit(":"), F.lit(1)).alias("feed"),
        F.when(F.startswith("station_code", F.lit("C")), F.substring("station_code", 2, 20)).otherwise(F.col("station_code")).alias("stop_id"),
        "title", "status", "details", "color", F.array_join("regions", ",").alias("regions"), "lng", "lat",
    )


def _gtfs_with_shapes(spark, sf):
    g = gtfs(spark, sf)
    t = track(spark, sf)
    minute = F.floor(F.col("ts_us") / 60_000_000).cast("bigint")
    g["shapes"] = t.select(
        F.concat(F.lit("f"), (F.col("path") % 5).cast("string")).alias("feed"), F.concat(F.lit("sh"), F.col("path").cast("string")).alias("shape_id"),
        F.col("lat").cast("string").alias("shape_pt_lat"), F.col("lng").cast("string").alias("shape_pt_lon"),
        (minute - 28401120).cast("string").alias("shape_pt_sequence"),
    )
    # some trips run twice, the second time on a shape of another id with equal points
    g["shapes"] = g["shapes"].unionByName(g["shapes"].withColumn("shape_id", F.concat(F.lit("x"), "shape_id")))
    again = g["trips"].where((F.col("row_ix") % 9 == 1) & F.col("shape_id").isNotNull())
    g["trips"] = g["trips"].unionByName(again.withColumns({"trip_id": F.concat(F.lit("x"), "trip_id"), "shape_id": F.concat(F.lit("x"), "shape_id")}))
    return g


def _legs(spark, sf):
    return R.route_legs(_gtfs_with_shapes(spark, sf), feeds(spark), region_edges(spark))


def _no_roads(spark):
    return spark.createDataFrame([], "segment string, points array<struct<lng:double,lat:double>>")


def _assembled(spark, sf):
    return R.draw_routes(_legs(spark, sf), region_edges(spark), _no_roads(spark))


ASSEMBLED = [
    ROUTE, TRIP.replace("trip AS (", "trip0 AS ("),
    "trip AS (SELECT * FROM trip0 UNION ALL SELECT feed, row_ix, 'x' || trip_id, route_id, 'x' || shape_id, direction_id FROM trip0 WHERE row_ix % 9 = 1 AND shape_id != '')", CALL, FALL, TRACK,
    """shr AS (SELECT feed, shape_id, route_id FROM trip WHERE shape_id != '' AND (feed, route_id) IN (SELECT (feed, route_id) FROM sel) QUALIFY row_number() OVER (PARTITION BY feed, shape_id ORDER BY row_ix) = 1)""",
    """apt AS (SELECT s.feed, s.route_id, 'shape:' || shape_id AS path, ts_us // 60000000 AS seq, lng, lat FROM shr s JOIN track k ON 'sh' || k.path = ltrim(shape_id, 'x') AND 'f' || (k.path % 5) = s.feed
 UNION ALL SELECT f.feed, f.route_id, 'trip:' || f.trip_id, CAST(seq AS BIGINT), lng, lat FROM fb f JOIN call USING (feed, trip_id) JOIN stp USING (stop_id))""",
    "spot AS (SELECT row_number() OVER () AS id, lng, lat FROM (SELECT DISTINCT lng, lat FROM apt))", edge_values(), inside_cte("spot"),
    "hitp AS (SELECT DISTINCT feed, route_id, path, region FROM apt JOIN spot USING (lng, lat) JOIN inside USING (id))",
    """keptp AS (SELECT feed, route_id, path, kind FROM (SELECT feed, route_id, path FROM apt GROUP BY ALL HAVING count(*) >= 2) JOIN sel USING (feed, route_id)
 WHERE feed != 'f3' OR (feed, route_id, path) IN (SELECT (feed, route_id, path) FROM hitp))""",
    f"""aleg AS (SELECT *, {km('pl', 'pa', 'lng', 'lat')} AS leg_km FROM (SELECT apt.*, kind, lag(lng) OVER w AS pl, lag(lat) OVER w AS pa FROM apt JOIN keptp USING (feed, route_id, path)
 WINDOW w AS (PARTITION BY feed, route_id, path ORDER BY seq, lng, lat)))""",
    "drawn AS (SELECT DISTINCT feed, route_id FROM aleg WHERE pl IS NOT NULL AND (kind != 3 OR leg_km <= 20))",
    "o(region, rk) AS (VALUES ('ct',1),('ma',2),('me',3),('nh',4),('ri',5),('vt',6),('boston',7))",
    """regs AS (SELECT feed, route_id, coalesce(string_agg(o.region, ',' ORDER BY rk), '') AS regions FROM (SELECT DISTINCT feed, route_id, region FROM hitp WHERE (feed, route_id, path) IN (SELECT (feed, route_id, path) FROM aleg WHERE pl IS NOT NULL AND (kind != 3 OR leg_km <= 20)))
 h LEFT JOIN o USING (region) GROUP BY ALL)""",
    FEEDCOL,
]


@query("GEO07 SRC01 FLT03 FLT04 JN02 JN03 JN04 JN05 AG11 AG14 WN06", with_ctes(*ASSEMBLED, f"""
SELECT feed || ':' || route_id AS route, grp, CASE WHEN feed = 'f2' THEN '#123456' WHEN grp = 'amtrak' THEN '#5b9bd5' ELSE CASE kind WHEN 2 THEN '#a58add' WHEN 3 THEN '#f2b84b' ELSE '#2eb7c5' END END AS color,
 CASE WHEN feed = 'f1' AND agency_id = '1' THEN 'Agency One' WHEN feed = 'f1' AND agency_id = '2' THEN 'Agency Two' ELSE 'Agency ' || right(feed, 1) END AS agency, label AS name,
 CASE WHEN feed = 'f3' THEN 'Feed maker' ELSE '{V.DEFAULT_PROVIDER}' END AS provider, coalesce(regions, CASE WHEN feed IN ('f1', 'f3') THEN 'ct,ma' ELSE 'vt' END) AS regions,
 CAST(NULL AS VARCHAR) AS geometry_accuracy, CASE WHEN feed = 'f1' AND url IS NOT NULL THEN url ELSE '{V.DEFAULT_SOURCE_URL}' END AS source_url
FROM f JOIN drawn USING (feed, route_id) LEFT JOIN regs USING (feed, route_id)"""))
def assembled_routes(spark, sf):
    """Route features of the five feeds, from routes, trips, shapes, stops and stop times."""
    f = _assembled(spark, sf)["features"]
    return f.select("route", "grp", "color", "agency", "name", "provider", F.array_join("regions", ",").alias("regions"), "geometry_accuracy", "source_url")


# road geometry is cached for the gaps whose western end has an even hundredth of longitude
COVERED = "floor(abs(least(lng, pl)) * 100 + 0.5)::BIGINT % 2 = 0"
REPAIRED = [p.replace("(kind != 3 OR leg_km <= 20)", f"(kind != 3 OR leg_km <= 20 OR {COVERED})") for p in ASSEMBLED]


def _cached_roads(missing):
    """A road for every covered gap: both ends, and a point beside the first."""
    end = lambda token: F.struct(*[F.split(token, ",")[i].cast("double").alias(n) for i, n in enumerate(("lng", "lat"))])
    rows = missing.select("segment", end(F.col("from_token")).alias("a"), end(F.col("to_token")).alias("b"))
    even = F.floor(F.abs(F.least("a.lng", "b.lng")) * 100 + 0.5) % 2 == 0
    beside = F.struct((F.col("a.lng") + 0.00001).alias("lng"), F.col("a.lat").alias("lat"))
    return first_wins(rows.where(even).select("segment", F.array("a", beside, "b").alias("points")), ["segment"], ["points"])


@query("GEO07 GEO04 JN18 PRJ17", with_ctes(*REPAIRED, f"""mended AS (SELECT DISTINCT feed, route_id FROM aleg WHERE kind = 3 AND leg_km > 20 AND {COVERED})""", f"""
SELECT feed || ':' || route_id AS route, coalesce(regions, CASE WHEN feed IN ('f1', 'f3') THEN 'ct,ma' ELSE 'vt' END) AS regions, CASE WHEN m.feed IS NOT NULL THEN 'approximate' END AS geometry_accuracy,
 CASE WHEN m.feed IS NOT NULL THEN '{V.ROAD_GEOMETRY_PROVIDER}' END AS geometry_provider, CASE WHEN m.feed IS NOT NULL THEN '{V.ROAD_NOTE}' END AS geometry_note
FROM f JOIN drawn USING (feed, route_id) LEFT JOIN regs USING (feed, route_id) LEFT JOIN mended m USING (feed, route_id)""".replace("m.feed IS NOT NULL", "(feed, route_id) IN (SELECT (feed, route_id) FROM mended)").replace(" LEFT JOIN mended m USING (feed, route_id)", "")))
def assembled_repaired_routes(spark, sf):
    """Route features whose gaps meet a road cache: mended routes say that their geometry is approximate."""
    legs = _legs(spark, sf)
    roads = cut_lineage(_cached_roads(R.missing_roads(legs, _no_roads(spark))))
    f = R.draw_routes(legs, region_edges(spark), roads)["features"]
    return f.select("route", F.array_join("regions", ",").alias("regions"), "geometry_accuracy", "geometry_provider", "geometry_note")


def _kept_points(kinds: str, chord: float | None) -> str:
    pt = f"pt AS MATERIALIZED (SELECT path, ix, lng, lat FROM bp WHERE {kinds})"
    return with_ctes(pt, _split_sql(V.SIMPLIFY_TOLERANCE_DEG, chord), "SELECT path, ix, lng, lat FROM pt WHERE EXISTS (SELECT 1 FROM span s WHERE s.path = pt.path AND (s.lo = pt.ix OR s.hi = pt.ix))", recursive=True)


@query("GEO07 GEO02 GEO03 WN07 AG12", with_ctes(*ASSEMBLED[:-1], f"""pc AS (SELECT feed, route_id, kind, lng, lat, seq, path || '/' || sum(CASE WHEN kind = 3 AND leg_km > 20 THEN 1 ELSE 0 END)
 OVER (PARTITION BY feed, route_id, path ORDER BY seq, lng, lat ROWS UNBOUNDED PRECEDING) AS path FROM aleg)""",
    """bp AS (SELECT feed || '|' || route_id || '|' || path AS path, feed, route_id, kind, lng, lat, row_number() OVER (PARTITION BY feed, route_id, path ORDER BY seq, lng, lat) - 1 AS ix FROM pc
 QUALIFY count(*) OVER (PARTITION BY feed, route_id, path) > 1)""",
    f"kp AS ({_kept_points('kind = 3', V.MAX_CHORD_KM)} UNION ALL SELECT * FROM ({_kept_points('kind != 3', None)}))",
    "ln AS (SELECT path, list((lng, lat) ORDER BY ix) AS line FROM kp GROUP BY path)",
    "own AS (SELECT DISTINCT path, feed, route_id FROM bp)",
    "one AS (SELECT feed, route_id, min(path) AS path FROM ln JOIN own USING (path) GROUP BY feed, route_id, line)", """
SELECT feed, route_id, count(*) AS points, count(DISTINCT path) AS paths, round(sum(lng), 6) AS lng_sum FROM kp JOIN one USING (path) GROUP BY feed, route_id"""))
def assembled_paths(spark, sf):
    p = _assembled(spark, sf)["paths"]
    return p.groupBy("feed", "route_id").agg(F.count(F.lit(1)).alias("points"), F.countDistinct("path").alias("paths"), r6(F.sum("lng")).alias("lng_sum"))


@query("JN20 GEO04", with_ctes(*ASSEMBLED, """
SELECT DISTINCT feed, route_id, printf('%.5f,%.5f', pl, pa) AS from_token, printf('%.5f,%.5f', lng, lat) AS to_token FROM aleg WHERE kind = 3 AND leg_km > 20"""))
def assembled_missing(spark, sf):
    """Bus gaps above the chord limit that no cached road geometry covers."""
    return R.missing_roads(_legs(spark, sf), _no_roads(spark)).select("feed", "route_id", "from_token", "to_token").distinct()


@query("FLT17", with_ctes(ROUTE, """
SELECT feed || ':' || route_id AS route FROM sel WHERE CAST(route_id AS BIGINT) % 3 = 0 AND feed IN ('f0', 'f2', 'f4')
UNION ALL SELECT feed || ':' || route_id FROM sel WHERE CAST(route_id AS BIGINT) % 3 != 0"""))
def routes_shown(spark, sf):
    k = F.col("route_id").cast("bigint")
    rows = select_routes(gtfs(spark, sf)["routes"], feeds(spark)).withColumns(
        {"approximate": F.lit(False), "found": F.when(k % 3 != 0, F.array(F.lit("vt"), F.lit("me")))}
    )
    return R.visible_routes(R.route_properties(rows), "vt").select("route")


@query("AG20", with_ctes(ROUTE, """
SELECT x.feed, 'Agency ' || right(x.feed, 1) AS agency, coalesce(n, 0) AS features, CASE WHEN x.feed = 'f0' THEN 'Publisher 0' ELSE 'Agency ' || right(x.feed, 1) END AS publisher,
 CASE WHEN x.feed = 'f0' THEN 'v1' ELSE '' END AS version FROM (VALUES ('f0'), ('f1'), ('f2'), ('f3'), ('f4')) x(feed) LEFT JOIN (SELECT feed, count(*) AS n FROM sel GROUP BY feed) c ON c.feed = x.feed"""))
def feed_metadata(spark, sf):
    k = F.lit(False)
    rows = select_routes(gtfs(spark, sf)["routes"], feeds(spark)).withColumns({"approximate": k, "found": F.array().cast("array<string>")})
    info = spark.createDataFrame([("f0", "Publisher 0", "v1", "20240101", "20241231")], "feed string, feed_publisher_name string, feed_version string, feed_start_date string, feed_end_date string")
    return R.feed_metadata(feeds(spark), info, R.route_properties(rows)).select("feed", "agency", "features", "publisher", "version")
