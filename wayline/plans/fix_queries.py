"""Position-table queries: latest rows, freshness, visibility, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayline import fixed_values as V
from wayline.functions.numbers import safe_number
from wayline.functions.times import epoch_time, micros, relative_age
from wayline.operators import counts as C
from wayline.operators.normalise import age_rows, decode, layer_group
from wayline.operators.ordered import first_wins, last_wins
from wayline.plans.base import FIX, NOW_S, fixes, now, query, table, with_ctes

AGE = f"((CAST({NOW_S} AS BIGINT) * 1000000 - ts_us) / 1e6)"


@query("WN09 AG01", with_ctes(FIX, """
SELECT entity, id, ts_us, lng, lat, speed FROM fix QUALIFY row_number() OVER (PARTITION BY entity ORDER BY ts_us DESC, id DESC) = 1"""))
def latest_fix(spark, sf):
    f = fixes(spark, sf).select("entity", "id", "ts_us", "lng", "lat", "speed")
    return last_wins(f, ["entity"], ["ts_us", "id"])


@query("AG02", with_ctes(FIX, """
SELECT source, grp, id, lng FROM fix QUALIFY row_number() OVER (PARTITION BY source, grp ORDER BY id) = 1"""))
def first_row(spark, sf):
    return first_wins(fixes(spark, sf).select("source", "grp", "id", "lng"), ["source", "grp"], ["id"])


@query("AG01", with_ctes(FIX, """
SELECT entity, probe, pos, lng FROM (SELECT entity, id % 3 AS probe, id AS pos, lng FROM fix)
QUALIFY row_number() OVER (PARTITION BY entity ORDER BY probe DESC, pos DESC) = 1"""))
def ordered_dedupe(spark, sf):
    rows = fixes(spark, sf).select("entity", (F.col("id") % 3).alias("probe"), F.col("id").alias("pos"), "lng")
    return last_wins(rows, ["entity"], ["probe", "pos"])


def _source_names():
    k = F.col("entity") % 5
    return F.when(k == 0, "transit").when(k == 1, "amtrak").when(k == 2, "mnr").when(k == 3, "ais").otherwise("regional")


NAMES = "CASE entity % 5 WHEN 0 THEN 'transit' WHEN 1 THEN 'amtrak' WHEN 2 THEN 'mnr' WHEN 3 THEN 'ais' ELSE 'regional' END"
TTL = f"CASE entity % 5 WHEN 0 THEN 90 WHEN 1 THEN 300 WHEN 2 THEN 120 WHEN 3 THEN 180 ELSE 90 END"


@query("PRJ19", with_ctes(FIX, f"SELECT id, {NAMES} AS source, {AGE} > {TTL} AS stale FROM fix"))
def stale_flags(spark, sf):
    f = fixes(spark, sf).withColumn("source", _source_names())
    return age_rows(f, now()).select("id", "source", "stale")


@query("PRJ20", with_ctes(FIX, f"SELECT id, CASE WHEN id % 7 = 0 THEN TRUE ELSE {AGE} > 300 END AS stale FROM fix"))
def reaged(spark, sf):
    text = F.when(F.col("id") % 7 == 0, "not a time").otherwise(F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    f = fixes(spark, sf).withColumn("updated_at", F.try_to_timestamp(text)).withColumn("source", F.lit("amtrak"))
    return age_rows(f, now()).select("id", "stale")


@query("FLT16", with_ctes(FIX, """
SELECT id, grp FROM (SELECT *, CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'estimated' WHEN 2 THEN 'live' ELSE 'scheduled' END AS data_status FROM fix)
WHERE grp IN ('view', 'click') AND coalesce(data_status, 'live') IN ('live', 'scheduled')"""))
def status_filter(spark, sf):
    k = F.col("id") % 4
    f = fixes(spark, sf).withColumn("data_status", F.when(k == 1, "estimated").when(k == 2, "live").when(k == 3, "scheduled"))
    return C.visible(f, ["view", "click"], ["live", "scheduled"]).select("id", "grp")


@query("FN11", with_ctes(FIX, f"""
SELECT id, CASE WHEN id % 11 = 0 THEN 'update time unavailable' WHEN s < 60 THEN s || 's ago' ELSE CAST(floor(s / 60.0 + 0.5) AS BIGINT) || 'm ago' END AS age
FROM (SELECT id, greatest(0, CAST(floor({AGE} + 0.5) AS BIGINT)) AS s FROM fix)"""))
def relative_ages(spark, sf):
    at = F.when(F.col("id") % 11 != 0, F.col("updated_at"))
    return fixes(spark, sf).select("id", relative_age(at, now()).alias("age"))


@query("FN10", with_ctes(FIX, f"""
SELECT id, CASE WHEN s > 1000000000 THEN s * 1000000 ELSE CAST({NOW_S} AS BIGINT) * 1000000 END AS at_us
FROM (SELECT id, CASE WHEN id % 5 = 0 THEN id ELSE ts_us // 1000000 END AS s FROM fix)"""))
def epoch_guard(spark, sf):
    s = F.when(F.col("id") % 5 == 0, F.col("id")).otherwise(F.floor(F.col("ts_us") / 1_000_000).cast("bigint"))
    return fixes(spark, sf).select("id", micros(epoch_time(s.cast("string"), now())).alias("at_us"))


@query("AG07 AG05", with_ctes(FIX, """c AS (SELECT source, grp, CASE WHEN grp = 'error' THEN NULL ELSE count(*) END AS n FROM fix GROUP BY source, grp)""", """
SELECT grp, CAST(sum(n) AS BIGINT) AS live FROM c GROUP BY grp"""))
def live_totals(spark, sf):
    counts = fixes(spark, sf).groupBy("source", "grp").agg(F.count(F.lit(1)).alias("n"))
    return C.live_totals(counts.withColumn("n", F.when(F.col("grp") != "error", F.col("n"))))


GROUP_NAMES = "CASE grp WHEN 'view' THEN 'bus' WHEN 'click' THEN 'airport' WHEN 'signup' THEN 'ferry' WHEN 'error' THEN 'roads' ELSE 'plane' END"


@query("AG06 SRC23", with_ctes(FIX, f"""
SELECT coalesce(count(*) FILTER (WHERE g IN ('bus','ferry','plane')), 0) AS total FROM (SELECT {GROUP_NAMES} AS g FROM fix)"""))
def vehicle_total(spark, sf):
    g = F.col("grp")
    named = fixes(spark, sf).withColumn(
        "grp", F.when(g == "view", "bus").when(g == "click", "airport").when(g == "signup", "ferry").when(g == "error", "roads").otherwise("plane")
    )
    counts = named.groupBy("source", "grp").agg(F.count(F.lit(1)).alias("n"))
    return C.vehicle_total(counts, C.layer_groups(spark))


ROUTE_ID = "CASE o_custkey % 9 WHEN 0 THEN '741' WHEN 1 THEN 'Mattapan' WHEN 2 THEN 'Green-B' WHEN 3 THEN 'Red' ELSE 'r' || (o_custkey % 400) END"
ROUTE_KIND = "CASE WHEN o_custkey % 9 IN (0) THEN 3 WHEN o_custkey % 9 IN (1, 2, 3) THEN 0 ELSE o_custkey % 4 + 1 END"


def named_routes(spark, sf):
    """Route id and kind of every order."""
    k = F.col("o_custkey") % 9
    route = F.when(k == 0, "741").when(k == 1, "Mattapan").when(k == 2, "Green-B").when(k == 3, "Red").otherwise(
        F.concat(F.lit("r"), (F.col("o_custkey") % 400).cast("string"))
    )
    kind = F.when(k == 0, 3).when(k.isin(1, 2, 3), 0).otherwise((F.col("o_custkey") % 4 + 1).cast("int"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), route.alias("route"), kind.cast("int").alias("kind"))


GROUPING = """CASE WHEN route IN ('741','742','743','746','749','751') THEN 'silver' WHEN kind = 2 THEN 'commuter' WHEN kind = 3 THEN 'bus' WHEN kind = 4 THEN 'ferry'
  WHEN route = 'Mattapan' THEN 'mattapan' WHEN route LIKE 'Green%' THEN 'green' ELSE lower(route) END"""


@query("PRJ07 AG04", with_ctes(f"r AS (SELECT {ROUTE_ID} AS route, {ROUTE_KIND} AS kind FROM orders)", f"""
SELECT {GROUPING} AS grp, count(DISTINCT route) AS routes FROM r GROUP BY 1"""))
def scheduled_routes(spark, sf):
    r = named_routes(spark, sf)
    return C.scheduled_routes(r.withColumn("grp", layer_group(F.col("route"), F.col("kind"))))


@query("SRC23 AG08", with_ctes(f"r AS (SELECT DISTINCT {ROUTE_ID} AS route, {ROUTE_KIND} AS kind FROM orders)", """
SELECT CASE kind WHEN 2 THEN 'commuter' WHEN 3 THEN 'bus' ELSE 'ferry' END AS grp, count(*) AS n FROM r WHERE kind IN (2, 3, 4) AND route != '741' GROUP BY 1
UNION ALL SELECT * FROM (VALUES ('red', 1::BIGINT), ('orange', 1), ('green', 4), ('blue', 1), ('silver', 6), ('mattapan', 1)) t(grp, n)"""))
def group_members(spark, sf):
    routes = named_routes(spark, sf).select("route", "kind").distinct()
    return C.group_members(C.layer_groups(spark), routes).groupBy("grp").agg(F.count(F.lit(1)).alias("n"))


@query("FN07", """
SELECT user_id AS entity, count(*) AS n, CAST(sum(CASE event_type WHEN 'view' THEN 22.5 WHEN 'click' THEN 180.0 WHEN 'signup' THEN 337.5 WHEN 'error' THEN 0.0 END) AS DOUBLE) AS heading_sum
FROM events GROUP BY user_id""")
def compass_headings(spark, sf):
    g = F.col("grp")
    point = F.when(g == "view", "NNE").when(g == "click", "S").when(g == "signup", "NNW").when(g == "error", "N").otherwise("?")
    return fixes(spark, sf).groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.sum(decode(point, V.COMPASS)).alias("heading_sum"))


@query("FLT02 FN22", with_ctes(FIX, "SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE speed END AS speed FROM fix"))
def safe_numbers(spark, sf):
    k = F.col("id") % 9
    raw = F.when(k == 0, "").when(k == 3, "NaN").when(k == 6, "1e999").otherwise(F.col("speed").cast("string"))
    return fixes(spark, sf).select("id", safe_number(raw).alias("speed"))
