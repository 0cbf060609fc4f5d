"""Reference catalogs, share stations and road conditions."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayline.operators import catalogs as K
from wayline.operators import normalise as N
from wayline.operators import roads as R
from wayline.plans.base import NOW_S, NOW_TEXT, fixes, now, query, table, with_ctes

STATES = ["CT", "RI", "MA", "VT", "NH", "ME", "NY"]


def pick(values, key):
    out = F.lit(values[-1])
    for i, v in enumerate(values[:-1]):
        out = F.when(key % len(values) == i, F.lit(v)).otherwise(out)
    return out


def pick_sql(values, key):
    return "CASE " + " ".join(f"WHEN {key} % {len(values)} = {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def airport_rows(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        pick(["A", "B", "C", "G", "H", "U", "Z"], k).alias("SITE_TYPE_CODE"), pick(["PU", "PR"], k).alias("FACILITY_USE_CODE"),
        pick(["PU", "PR", "MA", "XX"], k).alias("OWNERSHIP_TYPE_CODE"), F.concat(F.lit("A"), k.cast("string")).alias("ARPT_ID"),
        F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat(F.lit("A"), k.cast("string"))).otherwise(F.concat(F.lit("KA"), k.cast("string"))).alias("ICAO_ID"),
        F.upper("p_name").alias("ARPT_NAME"), F.upper("p_type").alias("CITY"), F.lit("O'HARE-COUNTY").alias("COUNTY_NAME"), pick(STATES, k).alias("STATE_CODE"),
        pick(["O", "O", "O", "CP"], k).alias("ARPT_STATUS"), F.when(k % 50 == 0, "").otherwise((F.lit(41.0) + F.col("p_size") / 10.0).cast("string")).alias("LAT_DECIMAL"),
        F.lit("-72.5").alias("LONG_DECIMAL"), F.when(k % 5 == 0, "n/a").otherwise(F.col("p_retailprice").cast("string")).alias("ELEV"), F.lit("2026/08/06").alias("EFF_DATE"),
    )


KIND = "CASE p_partkey % 7 WHEN 0 THEN 'Airport' WHEN 1 THEN 'Balloonport' WHEN 2 THEN 'Seaplane base' WHEN 3 THEN 'Gliderport' WHEN 4 THEN 'Heliport' WHEN 5 THEN 'Ultralight facility' ELSE 'Landing facility' END"
INIT = "array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(w[1]) || lower(substr(w, 2))), ' ')"
FACIL = f"""fac AS (SELECT 'A' || p_partkey AS faa_id, {INIT.format(x='p_name')} AS title, CASE p_partkey % 2 WHEN 0 THEN 'Public use ' ELSE 'Private use ' END || lower({KIND}) AS status,
 {INIT.format(x='p_type')} || ', ' || {pick_sql(STATES, 'p_partkey')} || ' · A' || p_partkey || CASE WHEN p_partkey % 3 = 2 THEN ' / KA' || p_partkey ELSE '' END || ' · '
 || CASE p_partkey % 4 WHEN 0 THEN 'Publicly owned' WHEN 1 THEN 'Privately owned' WHEN 2 THEN 'Military' ELSE 'Other ownership' END
 || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE ' · ' || regexp_replace(CAST(round(p_retailprice, 1) AS VARCHAR), '\\.0$', '') || ' ft elevation' END AS details,
 CASE p_partkey % 2 WHEN 0 THEN 'public' ELSE 'private' END AS facility_use, lower({pick_sql(STATES, 'p_partkey')}) AS state, 'O''Hare-County' AS county
 FROM part WHERE p_partkey % 7 != 6 AND p_partkey % 4 != 3 AND p_partkey % 50 != 0)"""


@query("SRC17 FLT12 PRJ13 FN17 FN22 ST02", with_ctes(FACIL, "SELECT * FROM fac"))
def facilities(spark, sf):
    f = K.facilities(airport_rows(spark, sf)).select("faa_id", "title", "status", "details", "facility_use", "state", "county")
    return f.orderBy("faa_id")


@query("AG20 SNK01", with_ctes(FACIL, "SELECT count(*) AS count, count(*) FILTER (WHERE facility_use = 'public') AS public_use_count, '2026/08/06' AS effective_date FROM fac"))
def catalog_counts(spark, sf):
    return K.facility_metadata(K.facilities(airport_rows(spark, sf)))


PORTS = ["Derby Line, VT Station", "Houlton, ME", "Pittsburg", "Buffalo, NY", "Madawaska, Maine (NO PERMISSIBLE ENTRY)", "Calais,ME"]
SERVICES = ["HWY/B", "RAIL; HWY/B", "FERRY", "AIR", "CLVS PPTRA-Q"]


def office_rows(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        F.col("s_name").alias("office_name"), pick(PORTS, k).alias("us_port"), pick(["QC", "NB", "ON"], k).alias("province"), pick(SERVICES, k).alias("services"),
        F.when(k % 7 == 0, "").otherwise("06:00 / 22:00").alias("hours_weekday"), F.when(k % 2 == 0, "06:00 / 22:00").otherwise("08:00 / 16:00").alias("hours_weekend"),
        F.when(k % 3 == 0, "True").otherwise("False").alias("seasonal"), F.when(k % 4 == 0, F.concat(F.lit("note\r\n  "), F.repeat(F.lit("x"), 300))).otherwise("").alias("notes"),
    )


def geocode_rows(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").where(k % 8 != 0).select(
        F.concat_ws("|", "s_name", pick(PORTS, k)).alias("key"), (F.lit(-73.0) + k / 1000.0).alias("lng"), (F.lit(45.0) + k / 1000.0).alias("lat")
    )


CROSS = f"""off AS (SELECT *, {pick_sql(PORTS, 's_suppkey')} AS port, {pick_sql(SERVICES, 's_suppkey')} AS svc FROM supplier WHERE s_suppkey % 3 != 2 AND s_suppkey % 6 NOT IN (3, 4) AND s_suppkey % 5 != 3),
x AS (SELECT s_name || '|' || port AS key, CASE WHEN s_suppkey % 8 != 0 THEN -73.0::DOUBLE + s_suppkey / 1000.0::DOUBLE END AS lng, replace(port, ' Station', '') AS us_port,
 CASE s_suppkey % 5 WHEN 0 THEN 'road' WHEN 1 THEN 'road + rail' WHEN 2 THEN 'ferry' ELSE 'road' END AS crossing_type, CASE s_suppkey % 6 WHEN 0 THEN 'vt' WHEN 2 THEN 'nh' ELSE 'me' END AS region,
 concat_ws(' · ', CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 7 != 0 THEN 'Daily 06:00–22:00' WHEN s_suppkey % 7 = 0 THEN 'Sat ' || CASE WHEN s_suppkey % 2 = 0 THEN '06:00–22:00' ELSE '08:00–16:00' END
  ELSE 'Mon 06:00–22:00 · Sat 08:00–16:00' END, CASE WHEN s_suppkey % 5 = 4 THEN 'remote-traveller pilot location' END, CASE WHEN s_suppkey % 3 = 0 THEN 'seasonal hours' END,
  CASE WHEN s_suppkey % 4 = 0 THEN 'note ' || repeat('x', 275) END) AS details, s_suppkey FROM off)"""


@query("SRC18 FLT13 PRJ14 FN18 FN25 JN24 ST02", with_ctes(CROSS, "SELECT key, lng, 'Canada–U.S. ' || crossing_type || ' crossing · ' || us_port AS status, details, crossing_type, us_port, region FROM x"))
def crossings(spark, sf):
    c = K.crossings(office_rows(spark, sf), geocode_rows(spark, sf)).orderBy("province", "title")
    return c.select("key", "lng", "status", "details", "crossing_type", "us_port", F.get("regions", F.lit(0)).alias("region"))


@query("JN24", with_ctes(CROSS, "SELECT key FROM x WHERE s_suppkey % 8 = 0"))
def ungeocoded(spark, sf):
    return K.ungeocoded(office_rows(spark, sf), geocode_rows(spark, sf)).select("key")


@query("PRJ15 SRC19", """SELECT 'road-' || p_partkey AS id, CASE WHEN p_partkey % 9 = 0 THEN 'Primary roadway' ELSE p_name END AS title,
 CASE p_partkey % 5 WHEN 0 THEN 'Interstate highway' WHEN 1 THEN 'U.S. highway' WHEN 2 THEN 'State route' ELSE 'Primary roadway' END AS status FROM part""")
def road_features(spark, sf):
    k = F.col("p_partkey")
    rows = table(spark, sf, "part").select(k.alias("row_ix"), F.when(k % 9 == 0, "").otherwise(F.col("p_name")).alias("NAME"), F.when(k % 5 < 4, pick(["I", "U", "S", "C", "M"], k)).alias("RTTYP"))
    return K.roads(rows).select("id", "title", "status")


@query("FLT14 PRJ16 FN16", f"""SELECT 'rail-' || p_partkey AS id, concat_ws(' · ', CASE WHEN p_partkey % 9 = 0 THEN 'Rail network' ELSE p_brand END, CASE WHEN p_partkey % 4 = 0 THEN nullif('', '') WHEN p_partkey % 4 = 1 THEN p_type ELSE 'Branch' END,
 CASE WHEN p_partkey % 6 = 0 THEN 'Yard' END) AS title, concat_ws(' · ', {pick_sql(STATES, 'p_partkey')} || ' ' || CASE p_partkey % 4 WHEN 0 THEN 'main rail network' WHEN 1 THEN 'major industrial lead' ELSE 'passing siding' END,
 (p_size % 4) || ' track' || CASE WHEN p_size % 4 = 1 THEN '' ELSE 's' END, printf('%.1f', floor(p_retailprice / 100 * 10 + 0.5) / 10) || ' mi segment') AS status
FROM part WHERE p_partkey % 7 != 6 AND p_partkey % 4 != 3""")
def rail_features(spark, sf):
    k = F.col("p_partkey")
    rows = table(spark, sf, "part").select(
        k.alias("FRAARCID"), pick(STATES, k).alias("STATEAB"), pick(["M", "I", "S", "Y"], k).alias("NET"), F.when(k % 9 == 0, "").otherwise(F.col("p_brand")).alias("RROWNER1"),
        F.when(k % 4 == 1, F.col("p_type")).otherwise("").alias("SUBDIV"), F.when(k % 4 == 0, F.lit("")).otherwise("Branch").alias("BRANCH"), F.when(k % 6 == 0, " Yard ").alias("YARDNAME"),
        (F.col("p_size") % 4).alias("TRACKS"), (F.col("p_retailprice") / 100).cast("string").alias("MILES"),
    )
    return K.rail(rows).select("id", "title", "status")


SYSTEMS = [("bluebikes", "Bluebikes", "#4d9fec"), ("spin", "Spin", "#ff7f32")]


def systems(spark):
    return spark.createDataFrame(SYSTEMS, "system string, system_name string, system_color string")


BIKES = "l_linenumber - 1"


@query("JN08 PRJ05 FLT10 FN10", f"""WITH st AS (SELECT l_orderkey, l_linenumber, CASE l_suppkey % 2 WHEN 0 THEN 'bluebikes' ELSE 'spin' END AS sys, l_suppkey, min({BIKES}) AS bikes, min(CAST(l_quantity AS INTEGER)) % 3 AS docks, count(*) AS c
 FROM lineitem GROUP BY ALL)
SELECT sys || '-station-' || l_suppkey || '/' || l_orderkey || '/' || l_linenumber AS id, CASE WHEN bikes = 0 THEN '#5c6570' WHEN bikes <= 2 THEN '#ffb454' WHEN sys = 'spin' THEN '#ff7f32' ELSE '#4d9fec' END AS color, bikes = 0 AS stale,
 bikes || ' bike' || CASE bikes WHEN 1 THEN '' ELSE 's' END || CASE WHEN docks > 0 THEN ' (' || docks || ' electric)' ELSE '' END || ' · ' || docks || ' dock' || CASE docks WHEN 1 THEN '' ELSE 's' END || ' open' AS status,
 s_name AS dest, CASE WHEN l_suppkey % 4 = 0 THEN 'GBFS station' ELSE 'capacity ' || l_suppkey END AS meta
FROM st JOIN supplier ON s_suppkey = l_suppkey WHERE l_suppkey % 9 != 0 AND l_orderkey % 5 != 0""")
def dock_status(spark, sf):
    li = table(spark, sf, "lineitem")
    k = F.col("l_suppkey")
    system = F.when(k % 2 == 0, "bluebikes").otherwise("spin")
    st = li.groupBy("l_orderkey", "l_linenumber", "l_suppkey").agg(F.min(F.col("l_quantity").cast("int")).alias("q"))
    sid = F.concat_ws("/", k.cast("string"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    status = st.select(
        system.alias("system"), sid.alias("sid"), k.cast("string").alias("station_id"), (F.col("l_linenumber") - 1).alias("num_bikes_available"),
        (F.col("q") % 3).alias("num_ebikes_available"), (F.col("q") % 3).alias("num_docks_available"), F.when(k % 9 == 0, F.lit(False)).alias("is_installed"),
        F.when(F.col("l_orderkey") % 5 == 0, F.lit(False)).when(F.col("l_orderkey") % 5 == 1, F.lit(True)).alias("is_renting"),
        F.lit("1705319000").alias("last_reported"), F.lit("1705319500").alias("last_updated"),
    )
    s = F.col("s_suppkey")
    info = table(spark, sf, "supplier").select(
        F.when(s % 2 == 0, "bluebikes").otherwise("spin").alias("system"), s.cast("string").alias("station_id"), F.col("s_name").alias("name"),
        F.lit(42.0).alias("lat"), F.lit(-71.0).alias("lon"), F.when(s % 4 != 0, s).alias("capacity"),
    )
    rows = status.join(info, ["system", "station_id"]).drop("name", "lat", "lon", "capacity")
    full = info.join(rows.select("system", "station_id", "sid").distinct(), ["system", "station_id"]).drop("station_id").withColumnRenamed("sid", "station_id")
    status2 = rows.drop("station_id").withColumnRenamed("sid", "station_id")
    return N.docks(status2, full, systems(spark), now()).select("id", "color", "stale", "status", "dest", "meta")


@query("PRJ06 FLT11 JN08 FN15", f"""SELECT CASE event_id % 2 WHEN 0 THEN 'bluebikes' ELSE 'spin' END || '-vehicle-' || event_id AS id, CASE event_id % 4 WHEN 0 THEN 'electric scooter' WHEN 1 THEN 'bike' ELSE 'electric bike' END AS dest,
 coalesce(nullif(concat_ws(' · ', CASE WHEN event_id % 5 != 0 THEN CAST(floor(CAST(event_id % 100 AS DOUBLE) / 100 * 100 + 0.5) AS BIGINT) || '% battery' END,
  CASE WHEN event_id % 6 != 0 THEN 'about ' || CAST(floor(value * 100 / 1609.344 + 0.5) AS BIGINT) || ' mi range' END), ''), 'Available to rent') AS status
FROM events WHERE event_id % 7 != 0 AND event_id % 11 != 0 AND event_id % 17 != 0""")
def free_vehicles(spark, sf):
    k = F.col("id")
    system = F.when(k % 2 == 0, "bluebikes").otherwise("spin")
    rows = fixes(spark, sf).select(
        system.alias("system"), F.when(k % 3 == 0, k.cast("string")).alias("bike_id"), k.cast("string").alias("vehicle_id"),
        F.when(k % 17 == 0, "x").otherwise(F.col("lat").cast("string")).alias("lat"), F.col("lng").cast("string").alias("lon"), F.when(k % 7 == 0, F.lit(True)).alias("is_disabled"),
        (k % 11 == 0).alias("is_reserved"), (k % 4).cast("string").alias("vehicle_type_id"), F.when(k % 6 != 0, (F.col("speed") * 100).cast("string")).alias("current_range_meters"),
        F.when(k % 5 != 0, ((k % 100).cast("double") / 100).cast("string")).alias("current_fuel_percent"), F.lit(None).cast("string").alias("last_reported"), F.lit("1705319500").alias("last_updated"),
    )
    types = spark.createDataFrame(
        [(s, t, f, p) for s, _, _ in SYSTEMS for t, f, p in [("0", "scooter", "electric"), ("1", "bicycle", "human"), ("2", "bicycle", "electric")]],
        "system string, vehicle_type_id string, form_factor string, propulsion_type string",
    )
    return N.free_vehicles(rows, types, systems(spark), now()).select("id", "dest", "status")


@query("AG09", """
SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN '' WHEN m < 30 THEN 'Light crowding' WHEN m < 60 THEN 'Moderate crowding' ELSE 'Heavy crowding' END AS band
FROM (SELECT vec_id, list_sum(list_transform(embedding, lambda e: floor(abs(CAST(e AS DOUBLE)) * 400))) / len(embedding) AS m FROM embeddings)""")
def occupancy_band(spark, sf):
    shares = F.transform("embedding", lambda e: F.when(F.col("vec_id") % 10 != 0, F.floor(F.abs(e.cast("double")) * 400).cast("double")))
    padded = F.concat(shares, F.array(F.lit(None).cast("double")))
    return table(spark, sf, "embeddings").select("vec_id", N.occupancy_band(padded).alias("band"))


ZONE = f"""z AS (SELECT o_orderkey AS k, TIMESTAMP '{NOW_TEXT}' + to_hours(CAST(o_orderkey % 400 - 200 AS BIGINT)) AS s, TIMESTAMP '{NOW_TEXT}' + to_hours(CAST(o_orderkey % 400 - 200 + o_custkey % 48 AS BIGINT)) AS e, o_custkey AS c FROM orders),
w AS (SELECT * FROM z WHERE k % 11 != 0 AND e >= TIMESTAMP '{NOW_TEXT}' - INTERVAL 15 MINUTE AND s <= TIMESTAMP '{NOW_TEXT}' + INTERVAL 7 DAY AND k % 3 != 2)"""


@query("SRC10 FLT06 PRJ09 PRJ10 FLT15 FN09 FN16", with_ctes(ZONE, f"""
SELECT CASE k % 4 WHEN 0 THEN 'vt' WHEN 1 THEN 'NH' WHEN 2 THEN 'Me' ELSE 'MA' END || k AS id, s <= TIMESTAMP '{NOW_TEXT}' AND e >= TIMESTAMP '{NOW_TEXT}' AS active,
 CASE WHEN k % 5 = 0 THEN 'Official work zone' ELSE 'I-' || c || ' / US ' || k END AS title, concat_ws(' · ', CASE WHEN k % 2 = 0 THEN 'north bound' END,
 CASE k % 3 WHEN 0 THEN 'all lanes closed' ELSE 'some lanes closed' END, CASE WHEN c % 3 > 0 THEN (c % 3) || ' closed lane' || CASE WHEN c % 3 = 1 THEN '' ELSE 's' END END) AS status,
 CASE k % 3 WHEN 0 THEN '#ff5c5c' ELSE '#ffb454' END AS color, CASE k % 4 WHEN 0 THEN 'VTrans · New England 511 WZDx' WHEN 1 THEN 'NHDOT · New England 511 WZDx' WHEN 2 THEN 'MaineDOT · New England 511 WZDx' ELSE 'Feed' END AS provider,
 'road works, paving' AS work_types, CASE WHEN k % 2 = 0 THEN epoch_us(TIMESTAMP '2023-12-01 00:00:00') ELSE epoch_us(TIMESTAMP '2024-01-02 00:00:00') END AS updated_us FROM w"""))
def work_zones(spark, sf):
    from wayline.sources.messages import work_zone_rows

    k, c = F.col("o_orderkey"), F.col("o_custkey")
    at = lambda h: F.date_format(F.timestamp_micros(F.lit(NOW_S * 1_000_000) + h.cast("bigint") * F.lit(3_600_000_000)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    lane = lambda status: F.struct(F.lit(status).alias("status"), F.lit("general").alias("type"))
    lanes = F.when(c % 3 == 0, F.array(lane("open"))).when(c % 3 == 1, F.array(lane("closed"), lane("open"))).otherwise(F.array(lane("closed"), lane("closed")))
    props = F.struct(
        F.struct(
            F.when(k % 5 != 0, F.array(F.concat(F.lit("I-"), c.cast("string")), F.lit(""), F.concat(F.lit("US "), k.cast("string")))).alias("road_names"),
            F.when(k % 2 == 0, "north-bound").alias("direction"), F.when(k % 2 == 0, "2023-12-01T00:00:00Z").otherwise("1999-01-01T00:00:00Z").alias("update_date"), F.lit("text").alias("description"),
        ).alias("core_details"),
        F.when(k % 11 == 0, "unknown").otherwise(at(k % 400 - 200)).alias("start_date"), at(k % 400 - 200 + c % 48).alias("end_date"),
        F.when(k % 3 == 0, "all-lanes-closed").otherwise("some-lanes-closed").alias("vehicle_impact"), lanes.alias("lanes"),
        F.array(F.struct(F.lit("road-works").alias("type_name")), F.struct(F.lit("paving").alias("type_name"))).alias("types_of_work"),
    )
    shape = F.struct(F.when(k % 3 == 2, "Point").when(k % 3 == 1, "LineString").otherwise("MultiLineString").alias("type"), F.lit("[[-72.1,41.0],[-72.2,41.1]]").alias("coordinates"))
    zone = F.struct(F.concat(F.when(k % 4 == 0, "vt").when(k % 4 == 1, "NH").when(k % 4 == 2, "Me").otherwise("MA"), k.cast("string")).alias("id"), shape.alias("geometry"), props.alias("properties"))
    file = F.struct(F.array(zone).alias("features"), F.struct(F.lit("2024-01-02T00:00:00Z").alias("update_date")).alias("feed_info"))
    messages = table(spark, sf, "orders").select(F.to_json(file).alias("payload"), F.lit("Feed").alias("provider"), F.lit("https://feed.example/").alias("source_url"))
    z = R.work_zones(work_zone_rows(messages), now())
    return z.select("id", "active", "title", "status", "color", "provider", "work_types", F.unix_micros("updated_at").alias("updated_us"))


@query("SRC11 SRC12 PRJ11 FLT18 FN12 FN13", f"""SELECT 'ct-' || page_id AS id, -72.0::DOUBLE - page_id / 1000.0::DOUBLE AS lng, 41.0::DOUBLE + page_id / 1000.0::DOUBLE AS lat, CASE WHEN page_id % 3 = 0 THEN 'Official 511 road incident' ELSE 'Crash ' || page_id END AS title,
 concat_ws(' · ', CASE WHEN page_id % 3 != 0 THEN 'Started 1/15/2024 9:05 AM' END, CASE WHEN page_id % 3 = 1 THEN 'Expected through noon' END) AS status,
 'https://ct.example/Event/Incidents/' || page_id || '?lang=en' AS source_url, CASE page_id % 3 WHEN 0 THEN CAST({NOW_S} AS BIGINT) * 1000000 WHEN 1 THEN epoch_us(TIMESTAMP '2024-01-15 09:05:00') ELSE CAST({NOW_S} AS BIGINT) * 1000000 END AS updated_us,
 page_id % 3 = 2 AS time_rejected FROM pages WHERE page_id % 5 != 0""")
def incidents(spark, sf):
    from wayline.sources.messages import icon_rows

    k = F.col("page_id")
    icon = F.struct(F.when(k % 5 == 0, F.concat(F.lit("x"), k.cast("string"))).otherwise(k.cast("string")).alias("itemId"), F.array(F.lit(41.0) + k / 1000.0, F.lit(-72.0) - k / 1000.0).alias("location"))
    messages = table(spark, sf, "pages").select(F.lit("ct").alias("source"), F.to_json(F.struct(F.array(icon).alias("item2"))).alias("payload"))
    html = F.concat(
        F.lit("<td colspan=2>Crash "), k.cast("string"), F.lit("</td><th>Start Time</th><td>1/15/2024 9:05 AM</td>"),
        F.when(k % 3 == 1, "<th>Anticipated End Time</th><td>noon</td>").otherwise("<th>Last Updated</th><td>some time ago</td>"), F.col("html"),
    )
    pages = table(spark, sf, "pages").where(k % 3 != 0).select(F.lit("ct").alias("source"), k.cast("string").alias("item_id"), html.alias("html"))
    sources = spark.createDataFrame([("ct", "https://ct.example", "CT 511")], "source string, base string, provider string")
    rows = R.incidents(icon_rows(messages), pages, sources, now())
    return rows.select("id", "lng", "lat", "title", "status", "source_url", F.unix_micros("updated_at").alias("updated_us"), "time_rejected")


@query("SRC13 PRJ12 SO01 FLT15", """SELECT 'ct-' || s_suppkey AS id, 'Official traffic camera' AS title, 'Click to load the latest public image' AS status, CAST(s_suppkey AS VARCHAR) AS camera_id FROM supplier
UNION ALL SELECT 'ma-' || CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey AS VARCHAR) ELSE 'o' || s_suppkey END, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE 'MassDOT traffic camera' END,
 concat_ws(' · ', CASE WHEN s_suppkey % 4 != 0 THEN 'Route ' || s_nationkey END, 'NB', CASE WHEN s_suppkey % 5 = 0 THEN 'mile ' || s_suppkey END), NULL FROM supplier WHERE s_suppkey % 7 != 0""")
def cameras(spark, sf):
    from wayline.sources.messages import camera_rows, icon_rows

    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier")
    text = k.cast("string")
    icon = F.struct(text.alias("itemId"), F.array(F.lit(41.5), F.lit(-72.5)).alias("location"))
    icons = icon_rows(s.select(F.lit("ct").alias("source"), F.to_json(F.struct(F.array(icon).alias("item2"))).alias("payload")))
    props = F.struct(
        F.when(k % 3 == 0, F.col("s_name")).alias("HOC_Display"), F.when(k % 4 != 0, F.col("s_nationkey").cast("string")).otherwise("").alias("Roadway"), F.lit("NB").alias("Direction"),
        F.when(k % 5 == 0, text).alias("MM"), F.lit("").alias("Status"), F.concat(F.lit("o"), text).alias("OBJECTID"),
    )
    point = F.struct(F.when(k % 7 == 0, "Polygon").otherwise("Point").alias("type"), F.array(F.lit(-71.1), F.lit(42.3)).alias("coordinates"))
    feature = F.struct(F.when(k % 2 == 0, text).alias("id"), point.alias("geometry"), props.alias("properties"))
    inventory = camera_rows(s.select(F.to_json(F.struct(F.array(feature).alias("features"))).alias("payload")))
    sources = spark.createDataFrame([("ct", "https://ct.example", "CT 511")], "source string, base string, provider string")
    return R.cameras(icons, sources, inventory).select("id", "title", "status", "camera_id")


@query("FLT18", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_partkey % 8 = 0 WHEN 1 THEN p_partkey % 8 = 1 WHEN 2 THEN p_partkey % 8 = 2 ELSE p_partkey % 24 <= 22 AND p_size < pow(2, p_partkey % 24) END AS ok FROM part""")
def request_validation(spark, sf):
    k, text = F.col("p_partkey"), F.col("p_partkey").cast("string")
    kind = pick(["camera", "callsign", "region", "tile"], k)
    even = k % 8 < 4
    value = (
        F.when(k % 4 == 0, F.when(even, text).otherwise(F.concat(text, F.lit("a")))).when(k % 4 == 1, F.when(even, "AAL12").otherwise("ab"))
        .when(k % 4 == 2, F.when(even, "new-england").otherwise("california")).otherwise(F.concat_ws("/", (k % 24).cast("string"), F.col("p_size").cast("string"), F.lit("0")))
    )
    return table(spark, sf, "part").select("p_partkey", R.valid_request(kind, value).alias("ok"))
