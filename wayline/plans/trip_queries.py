"""Trip progress, estimated positions and GTFS trip joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayline.functions.geo import planar_bearing
from wayline.operators import trips as T
from wayline.operators.normalise import estimated_trains
from wayline.plans.base import NOW_S, STATION, STOPTIME, TRIP_NOW_S, now, query, r6, stop_times_view, stops_view, table, with_ctes

NXT = f"""nx AS (SELECT trip, min(seq) AS nseq FROM stoptime WHERE time > {TRIP_NOW_S} GROUP BY trip),
prog AS (SELECT nx.trip, p.stop AS prev_stop, p.time AS prev_time, n.stop AS next_stop, n.time AS next_time, d.stop AS dest_stop,
  greatest(0.0::DOUBLE, least(1.0::DOUBLE, CAST({TRIP_NOW_S} - p.time AS DOUBLE) / greatest(1.0::DOUBLE, CAST(n.time - p.time AS DOUBLE)))) AS progress
  FROM nx JOIN stoptime n ON n.trip = nx.trip AND n.seq = nx.nseq JOIN stoptime p ON p.trip = nx.trip AND p.seq = nx.nseq - 1
  JOIN (SELECT trip, max(seq) AS mseq FROM stoptime GROUP BY trip) m ON m.trip = nx.trip JOIN stoptime d ON d.trip = nx.trip AND d.seq = m.mseq)"""


def trip_now():
    return F.lit(TRIP_NOW_S).cast("bigint")


@query("JN09 WN08 SRC06", with_ctes(STOPTIME, NXT, "SELECT trip, prev_stop, prev_time, next_stop, next_time, dest_stop, round(progress, 6) AS progress FROM prog"))
def trip_progress(spark, sf):
    p = T.trip_progress(stop_times_view(spark, sf), trip_now())
    return p.select("trip", "prev_stop", "prev_time", "next_stop", "next_time", "dest_stop", r6(F.col("progress")).alias("progress"))


EST = """est AS (SELECT trip, a.lng + (b.lng - a.lng) * progress AS lng, a.lat + (b.lat - a.lat) * progress AS lat, a.name AS pn, b.name AS nn, next_time,
  (degrees(atan2(b.lng - a.lng, b.lat - a.lat)) + 360) % 360 AS bearing FROM prog JOIN station a ON a.stop = prev_stop JOIN station b ON b.stop = next_stop)"""


@query("JN10 FN23 FN03", with_ctes(STOPTIME, NXT, STATION, EST, f"""
SELECT trip, round(lng, 6) AS lng, round(lat, 6) AS lat, round(bearing, 6) AS bearing,
  pn || ' → ' || nn || ' · ' || CASE WHEN mi > 0 THEN mi || ' min' ELSE 'due' END AS status
FROM (SELECT *, greatest(0, CAST(floor((next_time - {TRIP_NOW_S}) / 60.0 + 0.5) AS BIGINT)) AS mi FROM est)"""))
def estimated_position(spark, sf):
    e = T.estimate_positions(T.trip_progress(stop_times_view(spark, sf), trip_now()), stops_view(spark, sf), trip_now())
    return e.select("trip", *[r6(F.col(c)).alias(c) for c in ("lng", "lat", "bearing")], "status")


LINES = "CASE trip % 4 WHEN 0 THEN 'New Haven' WHEN 1 THEN 'New Canaan' WHEN 2 THEN 'Danbury' ELSE 'Waterbury' END"


@query("JN10 PRJ19 SRC20", with_ctes(STOPTIME, NXT, STATION, f"""
SELECT 'mnr-' || trip AS id, 'Metro-North · ' || {LINES} || ' Line' AS title, 'Train ' || trip || coalesce(' to ' || s.name, '') AS dest, 'estimated' AS data_status,
  CAST({NOW_S} AS BIGINT) - {TRIP_NOW_S} > 120 AS stale
FROM prog LEFT JOIN station s ON s.stop = dest_stop"""))
def estimated_trains_fix(spark, sf):
    e = T.estimate_positions(T.trip_progress(stop_times_view(spark, sf), trip_now()), stops_view(spark, sf), trip_now())
    e = e.withColumns({"label": F.col("trip").cast("string"), "route": (F.col("trip") % 4 + 3).cast("string")})
    return estimated_trains(e, now(), F.timestamp_seconds(trip_now())).select("id", "title", "dest", "data_status", "stale")


@query("FN03", with_ctes(STATION, """
SELECT a.stop, round((degrees(atan2(b.lng - a.lng, b.lat - a.lat)) + 360) % 360, 6) AS bearing FROM station a JOIN station b ON CAST(b.stop AS BIGINT) = CAST(a.stop AS BIGINT) + 1"""))
def bearing(spark, sf):
    s = stops_view(spark, sf)
    nxt = s.select((F.col("stop").cast("bigint") - 1).cast("string").alias("stop"), F.col("lng").alias("lng2"), F.col("lat").alias("lat2"))
    return s.join(nxt, "stop").select("stop", r6(planar_bearing(F.col("lng"), F.col("lat"), F.col("lng2"), F.col("lat2"))).alias("bearing"))


def feed_of(key: str):
    return F.concat(F.lit("f"), (F.col(key) % 5).cast("string"))


def gtfs(spark, sf):
    """GTFS-shaped tables over the given ones: customers are routes, orders trips, suppliers stops, line items calls."""
    c, o, s, li = (table(spark, sf, t) for t in ("customer", "orders", "supplier", "lineitem"))
    routes = c.select(
        feed_of("c_custkey").alias("feed"), F.col("c_custkey").cast("string").alias("route_id"), F.col("c_nationkey").cast("string").alias("agency_id"),
        F.when(F.col("c_custkey") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("R"), (F.col("c_custkey") % 100).cast("string"))).alias("route_short_name"),
        F.when(F.col("c_custkey") % 4 == 0, F.lit("")).otherwise(F.concat("c_mktsegment", F.lit(" r"), (F.col("c_custkey") % 50).cast("string"))).alias("route_long_name"),
        F.when(F.col("c_nationkey") % 7 == 6, F.lit("x")).otherwise((F.col("c_nationkey") % 7).cast("string")).alias("route_type"),
        F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("http://www.amtrak.com/"), F.col("c_custkey").cast("string"))).alias("route_url"),
    )
    routes = routes.withColumn("row_ix", F.lit(1))
    # an older row of the same id is overruled by the later one
    routes = routes.unionByName(routes.withColumns({"row_ix": F.lit(0), "route_long_name": F.lit("old"), "route_type": F.lit("2")}))
    trips = o.select(
        feed_of("o_custkey").alias("feed"), F.col("o_orderkey").alias("row_ix"), F.col("o_orderkey").cast("string").alias("trip_id"),
        F.col("o_custkey").cast("string").alias("route_id"),
        F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("sh"), (F.col("o_custkey") % 150).cast("string"))).alias("shape_id"),
        (F.col("o_orderkey") % 2).cast("string").alias("direction_id"),
    )
    stops = s.select(
        F.explode(F.array(*[F.lit(f"f{i}") for i in range(5)])).alias("feed"), "s_suppkey", "s_name", "s_nationkey"
    )
    stops = stops.select(
        "feed", F.col("s_suppkey").cast("string").alias("stop_id"), F.col("s_suppkey").alias("row_ix"), F.col("s_name").alias("stop_name"),
        F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("C"), F.col("s_suppkey").cast("string"))).alias("stop_code"), F.lit(None).cast("string").alias("stop_url"),
        (F.lit(41000) + (F.col("s_suppkey") * 104729) % 5000).cast("double").alias("_lat"), (F.lit(-73500) + (F.col("s_suppkey") * 7919) % 6000).cast("double").alias("_lng"),
    ).withColumns(
        {
            "stop_lat": F.when(F.col("row_ix") % 20 == 7, "bad").otherwise((F.col("_lat") / 1000.0).cast("string")),
            "stop_lon": (F.col("_lng") / 1000.0).cast("string"),
        }
    ).drop("_lat", "_lng")
    older = stops.where((F.col("row_ix") % 3 == 0) & (F.col("row_ix") % 20 != 7))
    stops = stops.unionByName(older.withColumns({"row_ix": F.col("row_ix") - 1_000_000, "stop_name": F.lit("old"), "stop_lat": F.lit("44.5"), "stop_lon": F.lit("-70.5")}))
    calls = li.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        feed_of("o_custkey").alias("feed"), F.col("l_orderkey").cast("string").alias("trip_id"), F.col("l_suppkey").cast("string").alias("stop_id"),
        F.col("l_linenumber").cast("string").alias("stop_sequence"),
    )
    return {"routes": routes, "trips": trips, "stops": stops, "stop_times": calls}


def feeds(spark):
    rows = [
        (f"f{i}", f"Agency {i}", f"https://example.org/f{i}", ["ct", "ma", "ny"] if i % 2 else ["vt"], "building|house" if i == 1 else None,
         "route_long_name" if i == 1 else None, "amtrak" if i == 1 else None, "#123456" if i == 2 else None, "Feed maker" if i == 3 else None, None,
         3 if i == 4 else None, i in (1, 2), i == 2, i == 3, True, i == 1, i == 1, {"1": "Agency One", "2": "Agency Two"} if i == 1 else None)
        for i in range(5)
    ]
    schema = (
        "feed string, agency string, url string, states array<string>, route_name_pattern string, route_name_field string, group_override string, "
        "group_color string, provider string, source_url string, route_type_override int, include_stations boolean, shape_only boolean, "
        "require_region_match boolean, record_feed_info boolean, use_route_urls boolean, required boolean, agency_names map<string,string>"
    )
    return spark.createDataFrame(rows, schema)


ROUTE = """route AS (SELECT *, CASE WHEN feed = 'f4' THEN 3 WHEN route_type = 'x' THEN NULL ELSE CAST(route_type AS INTEGER) END AS kind FROM (
 SELECT 'f' || (c_custkey % 5) AS feed, CAST(c_custkey AS VARCHAR) AS route_id, CAST(c_nationkey AS VARCHAR) AS agency_id,
  CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'R' || (c_custkey % 100) END AS sn, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_mktsegment || ' r' || (c_custkey % 50) END AS ln,
  CASE WHEN c_nationkey % 7 = 6 THEN 'x' ELSE CAST(c_nationkey % 7 AS VARCHAR) END AS route_type,
  CASE WHEN c_custkey % 2 = 0 THEN 'https://www.amtrak.com/' || c_custkey END AS url FROM customer)),
sel AS (SELECT *, CASE WHEN sn != '' AND ln != '' AND NOT contains(lower(ln), lower(sn)) THEN sn || ' · ' || ln ELSE coalesce(nullif(sn, ''), nullif(ln, ''), route_id) END AS label
 FROM route WHERE kind IN (2, 3, 4) AND (feed != 'f1' OR regexp_matches(ln, '(?i)building|house')))"""
TRIP = """trip AS (SELECT 'f' || (o_custkey % 5) AS feed, o_orderkey AS row_ix, CAST(o_orderkey AS VARCHAR) AS trip_id, CAST(o_custkey AS VARCHAR) AS route_id,
 CASE WHEN o_orderkey % 3 != 0 THEN 'sh' || (o_custkey % 150) ELSE '' END AS shape_id, CAST(o_orderkey % 2 AS VARCHAR) AS direction_id FROM orders)"""
CALL = """stp AS (SELECT CAST(s_suppkey AS VARCHAR) AS stop_id, s_name, CAST(41000 + (s_suppkey * 104729) % 5000 AS DOUBLE) / 1000 AS lat,
 CAST(-73500 + (s_suppkey * 7919) % 6000 AS DOUBLE) / 1000 AS lng, s_suppkey FROM supplier WHERE s_suppkey % 20 != 7),
call AS (SELECT 'f' || (o_custkey % 5) AS feed, CAST(l_orderkey AS VARCHAR) AS trip_id, CAST(l_suppkey AS VARCHAR) AS stop_id, l_linenumber AS seq FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""


@query("FLT03 FLT04 FN14 SRC03", with_ctes(ROUTE, "SELECT feed, route_id, kind, label FROM sel"))
def selected_routes(spark, sf):
    return T.select_routes(gtfs(spark, sf)["routes"], feeds(spark)).select("feed", "route_id", "kind", "label")


@query("JN04 AG02", with_ctes(ROUTE, TRIP, """
SELECT feed, shape_id, route_id FROM trip WHERE shape_id != '' AND (feed, route_id) IN (SELECT (feed, route_id) FROM sel)
QUALIFY row_number() OVER (PARTITION BY feed, shape_id ORDER BY row_ix) = 1"""))
def shape_routes(spark, sf):
    g = gtfs(spark, sf)
    return T.route_shapes(g["trips"], T.select_routes(g["routes"], feeds(spark)))


FALL = """fb AS (SELECT * FROM trip WHERE shape_id = '' AND feed != 'f2' AND (feed, route_id) IN (SELECT (feed, route_id) FROM sel)
 QUALIFY row_number() OVER (PARTITION BY feed, route_id, direction_id ORDER BY row_ix) = 1)"""


@query("JN05 AG02 FLT02", with_ctes(ROUTE, TRIP, CALL, FALL, """
SELECT f.feed, f.route_id, 'trip:' || f.trip_id AS path, CAST(seq AS BIGINT) AS seq, lng, lat FROM fb f JOIN call USING (feed, trip_id) JOIN stp USING (stop_id)"""))
def shape_fallback(spark, sf):
    g = gtfs(spark, sf)
    chosen = T.fallback_trips(g["trips"], T.select_routes(g["routes"], feeds(spark)))
    return T.fallback_points(g["stop_times"], g["stops"], chosen)


@query("JN06 AG18", with_ctes(ROUTE, TRIP, CALL, """
SELECT c.feed, stop_id, count(DISTINCT label) AS n, string_agg(DISTINCT label, '|' ORDER BY label) AS labels FROM call c JOIN trip t USING (feed, trip_id)
JOIN sel r ON r.feed = t.feed AND r.route_id = t.route_id GROUP BY c.feed, stop_id"""))
def stop_routes(spark, sf):
    g = gtfs(spark, sf)
    routes = T.select_routes(g["routes"], feeds(spark)).select("feed", "route_id", "label")
    named = T.routes_by_stop(g["stop_times"], g["trips"]).join(routes, ["feed", "route_id"])
    labels = named.groupBy("feed", "stop_id").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    return labels.select("feed", "stop_id", F.size("labels").cast("bigint").alias("n"), F.array_join("labels", "|").alias("labels"))
