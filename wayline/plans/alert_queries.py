"""Alert queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayline import fixed_values as V
from wayline.functions.text import alert_severity, pretty_effect, translated
from wayline.operators import alerts as A
from wayline.operators import counts as C
from wayline.operators.paths import bounding_boxes
from wayline.plans.base import FIX, NOW_S, REGISTRY, STATION, edge_values, fixes, inside_cte, query, region_edges, stops_view, table, with_ctes
from wayline.sources import realtime
from wayline.sources.messages import service_alerts

SEVERE = "suspend|no service|cancel|tion"
DELAY = "delay|late|reduced|modified|replacement bus|und"
SEV = f"CASE WHEN regexp_matches(text, '(?i){SEVERE}') THEN 8 WHEN regexp_matches(text, '(?i){DELAY}') THEN 6 ELSE 4 END"


@query("PRJ21", f"SELECT doc_id, {SEV} AS severity FROM documents")
def alert_severity_levels(spark, sf):
    return table(spark, sf, "documents").select("doc_id", alert_severity(F.col("text"), f"(?i){SEVERE}", f"(?i){DELAY}").alias("severity"))


ALERT = """alert AS (SELECT doc_id AS id, 4 + doc_id % 5 AS severity, list_distinct(['r' || (doc_id % 400), 'r' || (doc_id * 7 % 400), CASE WHEN doc_id % 10 = 0 THEN '741' ELSE 'r' || (doc_id % 3) END]) AS routes,
 list_distinct([CAST(doc_id % 150 AS VARCHAR), CAST(doc_id * 3 % 150 AS VARCHAR)]) AS stops, source FROM documents)"""


def alerts(spark, sf):
    d = F.col("doc_id")
    text = lambda c: c.cast("string")
    rt = lambda c: F.concat(F.lit("r"), text(c))
    routes = F.array_distinct(F.array(rt(d % 400), rt(d * 7 % 400), F.when(d % 10 == 0, "741").otherwise(rt(d % 3))))
    return table(spark, sf, "documents").select(
        d.alias("id"), (4 + d % 5).alias("severity"), routes.alias("routes"), F.array_distinct(F.array(text(d % 150), text(d * 3 % 150))).alias("stops"), "source"
    )


KIND = "kinds AS (SELECT DISTINCT 'r' || (o_custkey % 400) AS route, o_custkey % 4 + 1 AS kind FROM orders WHERE o_custkey % 400 % 3 != 1)"


def kinds(spark, sf):
    k = F.col("o_custkey")
    return table(spark, sf, "orders").where(k % 400 % 3 != 1).select(F.concat(F.lit("r"), (k % 400).cast("string")).alias("route"), (k % 4 + 1).alias("kind")).distinct()


@query("FLT09", with_ctes(ALERT, KIND, """
SELECT id, severity FROM alert a WHERE severity >= 7 OR EXISTS (SELECT 1 FROM unnest(a.routes) u(route) LEFT JOIN kinds k ON k.route = u.route WHERE k.kind IS NULL OR k.kind != 3 OR u.route = '741')"""))
def relevance(spark, sf):
    return A.relevant_alerts(alerts(spark, sf), kinds(spark, sf)).select("id", "severity")


@query("ST01 ST04", with_ctes(ALERT, "SELECT id, severity, source FROM alert"))
def alert_top(spark, sf):
    return A.ranked(alerts(spark, sf)).select("id", "severity", "source")


@query("AG08 SRC23", with_ctes(ALERT, """member AS (SELECT 'silver' AS grp, unnest(['741','742','743','746','749','751']) AS route UNION ALL SELECT CASE o_custkey % 400 % 2 WHEN 0 THEN 'bus' ELSE 'ferry' END, 'r' || (o_custkey % 400) FROM orders)""", """
SELECT grp, max(coalesce(s, 0)) AS worst, CASE WHEN max(coalesce(s, 0)) >= 7 THEN 'major' WHEN max(coalesce(s, 0)) >= 4 THEN 'minor' END AS badge
FROM member m LEFT JOIN (SELECT route, max(severity) AS s FROM alert, unnest(routes) u(route) GROUP BY route) w USING (route) GROUP BY grp"""))
def worst_by_group(spark, sf):
    k = F.col("o_custkey") % 400
    typed = table(spark, sf, "orders").select(F.when(k % 2 == 0, "bus").otherwise("ferry").alias("grp"), F.concat(F.lit("r"), k.cast("string")).alias("route")).distinct()
    silver = C.layer_groups(spark).where(F.col("grp") == "silver").select("grp", F.explode("routes").alias("route"))
    return A.worst_by_group(alerts(spark, sf), silver.unionByName(typed))


PERIODS = """per AS (SELECT event_id AS id, epoch_us(ts) // 1000000 AS s FROM events),
act AS (SELECT id, s, CASE WHEN id % 4 = 0 THEN TRUE WHEN id % 4 = 1 THEN s <= 1705320000 WHEN id % 4 = 2 THEN s <= 1705320000 AND s + 86400 >= 1705320000 ELSE s >= 1705320000 END AS active FROM per)"""


@query("FLT07 N13", with_ctes(PERIODS, "SELECT id, active FROM act"))
def active_periods(spark, sf):
    s, k = F.floor(F.col("ts_us") / 1_000_000).cast("bigint"), F.col("id") % 4
    period = lambda a, b: F.struct(a.cast("bigint").alias("start"), b.cast("bigint").alias("end"))
    null = F.lit(None)
    typed = "array<struct<start:bigint,end:bigint>>"
    periods = (
        F.when(k == 0, F.array().cast(typed)).when(k == 1, F.array(period(s, null)))
        .when(k == 2, F.array(period(s - 10_000_000, s - 9_000_000), period(s, s + 86400)).cast(typed)).otherwise(F.array(period(null, s)))
    )
    # a window that lies before every event keeps the second period decisive
    rows = fixes(spark, sf).select("id", periods.alias("periods"))
    return rows.select("id", A.any_period_active(F.col("periods"), F.lit(NOW_S).cast("bigint")).alias("active"))


@query("FLT08 AG10 SO04", """
SELECT doc_id AS id, array_to_string(list_filter(named, x -> x IN ('3','4','5','6')), ',') AS routes FROM (SELECT doc_id, list_distinct(list_filter([CAST(doc_id % 9 AS VARCHAR), '', CAST(doc_id % 5 AS VARCHAR)], x -> x != '')) AS named FROM documents)
WHERE len(list_filter(named, x -> x IN ('3','4','5','6'))) > 0""".replace("array_to_string(list_filter(named, x -> x IN ('3','4','5','6')), ',')", "array_to_string(list_sort(list_filter(named, lambda x: x IN ('3','4','5','6'))), ',')").replace("x -> x != ''", "lambda x: x != ''").replace("x -> x IN", "lambda x: x IN"))
def alert_scope(spark, sf):
    d = F.col("doc_id")
    ent = lambda c: F.struct(c.cast("string").alias("route"), F.lit(None).cast("string").alias("stop"))
    rows = table(spark, sf, "documents").select(d.alias("id"), F.array(ent(d % 9), ent(F.lit("")), ent(d % 5)).alias("entities"))
    scoped = rows.select("id", A.scoped_routes(F.col("entities"), list(V.ESTIMATED_LINES)).alias("routes"))
    return scoped.where(F.size("routes") > 0).select("id", F.array_join(F.array_sort("routes"), ",").alias("routes"))


@query("PRJ22", """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'en ' || lang WHEN 1 THEN 'plain' WHEN 2 THEN '<p>' ELSE '' END AS header FROM documents""")
def translations(spark, sf):
    t = lambda text, language: F.struct(text.alias("text"), language.cast("string").alias("language"))
    d, null = F.col("doc_id"), F.lit(None)
    html = t(F.lit("<p>"), F.lit("en-html"))
    choices = (
        F.when(d % 4 == 0, F.array(html, t(F.concat(F.lit("en "), F.col("lang")), F.lit("en")))).when(d % 4 == 1, F.array(html, t(F.lit("plain"), null)))
        .when(d % 4 == 2, F.array(html, html)).otherwise(F.array().cast("array<struct<text:string,language:string>>"))
    )
    return table(spark, sf, "documents").select("doc_id", translated(choices).alias("header"))


@query("SRC07 FLT07 FLT08 PRJ21 PRJ22 AG10", f"""
SELECT CAST(doc_id AS VARCHAR) AS id, text AS header, CASE WHEN regexp_matches(text, '{V.ALERT_SEVERE}') THEN 8 WHEN regexp_matches(text, '{V.ALERT_DELAY}') THEN 6 ELSE 4 END AS severity,
 CAST(doc_id % 9 AS VARCHAR) AS routes, 's' || (doc_id % 150) AS stops FROM documents WHERE doc_id % 9 IN (3, 4, 5, 6) AND doc_id % 3 != 2 AND text != ''""")
def alert_messages(spark, sf):
    sent = table(spark, sf, "documents").select(F.to_json(_alert_message()).alias("payload"))
    return _alert_rows(service_alerts(sent))


@query("SRC07", REGISTRY["alert_messages"].sql)
def binary_alerts(spark, sf):
    sent = realtime.encoded(table(spark, sf, "documents").select(_alert_message().alias("m")), "alert")
    return _alert_rows(service_alerts(realtime.decoded(sent, "alert"), parsed=True))


def _alert_message():
    d = F.col("doc_id")
    text = lambda value, language: F.struct(F.array(F.struct(value.alias("text"), F.lit(language).alias("language"))).alias("translation"))
    alert = F.struct(
        F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.when(d % 3 == 2, F.lit(NOW_S - 1)).cast("bigint").alias("end"))).alias("activePeriod"),
        F.array(F.struct((d % 9).cast("string").alias("routeId"), F.concat(F.lit("s"), (d % 150).cast("string")).alias("stopId"))).alias("informedEntity"),
        text(F.col("text"), "en").alias("headerText"), text(F.col("lang"), "fr").alias("descriptionText"),
    )
    return F.struct(F.struct(F.lit(NOW_S).alias("timestamp")).alias("header"), F.array(F.struct(d.cast("string").alias("id"), alert.alias("alert"))).alias("entity"))


def _alert_rows(parsed):
    out = A.normalise_alerts(parsed, F.col("header_timestamp"))
    return out.select("id", "header", "severity", F.array_join("routes", ",").alias("routes"), F.array_join("stops", ",").alias("stops"))


STOPS = """, pt AS (SELECT id, u.stop, s.lng, s.lat FROM alert, unnest(stops) u(stop) LEFT JOIN station s ON s.stop = u.stop)"""


@query("JN11", with_ctes(ALERT, STATION + STOPS, "SELECT id, stop, lng, lat FROM pt"))
def alert_points(spark, sf):
    return A.alert_points(alerts(spark, sf), stops_view(spark, sf)).select("id", "stop", "lng", "lat")


@query("JN11 ST04", with_ctes(ALERT, STATION + STOPS, "SELECT DISTINCT stop FROM pt WHERE lng IS NULL"))
def unresolved_stops(spark, sf):
    missing = A.unresolved_stops(alerts(spark, sf), stops_view(spark, sf))
    return A.lookup_batches(missing, 10).select(F.explode("ids").alias("stop"))


@query("JN14 JN01", with_ctes(ALERT, STATION + STOPS, edge_values(), inside_cte("(SELECT id, lng, lat FROM pt WHERE lng IS NOT NULL)"), "SELECT DISTINCT id FROM inside WHERE region = 'vt'")
       .replace("inside_ring AS (SELECT id, region, poly, ring FROM (SELECT id, lng, lat FROM pt WHERE lng IS NOT NULL), edge", "inside_ring AS (SELECT id, stop, region, poly, ring FROM (SELECT * FROM pt WHERE lng IS NOT NULL), edge")
       .replace("GROUP BY id, region, poly, ring HAVING", "GROUP BY id, stop, region, poly, ring HAVING").replace("h.id = a.id AND", "h.id = a.id AND h.stop = a.stop AND"))
def alerts_in_region(spark, sf):
    a = alerts(spark, sf)
    return A.alerts_in_region(a, A.alert_points(a, stops_view(spark, sf)), region_edges(spark), "vt").select("id")


@query("JN12 AG15", with_ctes(FIX, ALERT, STATION + STOPS, """box AS (SELECT 'r' || (entity % 400) AS route, min(lng) AS w, min(lat) AS s, max(lng) AS e, max(lat) AS n FROM fix WHERE entity % 2 = 0 GROUP BY 1),
sb AS (SELECT id, min(lng) AS w, min(lat) AS s, max(lng) AS e, max(lat) AS n FROM pt WHERE lng IS NOT NULL AND id % 3 = 0 GROUP BY id),
rb AS (SELECT id, min(w) AS w, min(s) AS s, max(e) AS e, max(n) AS n FROM alert, unnest(routes) u(route) JOIN box USING (route) GROUP BY id)""", """
SELECT a.id, CASE WHEN sb.w IS NOT NULL THEN 'stops' WHEN rb.w IS NOT NULL THEN 'routes' ELSE 'none' END AS focus, coalesce(sb.w, rb.w) AS west, coalesce(sb.s, rb.s) AS south,
 coalesce(sb.e, rb.e) AS east, coalesce(sb.n, rb.n) AS north FROM alert a LEFT JOIN sb ON sb.id = a.id LEFT JOIN rb ON rb.id = a.id"""))
def alert_focus(spark, sf):
    a = alerts(spark, sf)
    points = A.alert_points(a, stops_view(spark, sf)).where(F.col("id") % 3 == 0)
    f = fixes(spark, sf).where(F.col("entity") % 2 == 0).withColumn("route", F.concat(F.lit("r"), (F.col("entity") % 400).cast("string")))
    return A.focus_extents(a, points, bounding_boxes(f, ["route"]))


@query("FN20", """SELECT o_orderkey, upper(substr(e, 1, 1)) || substr(e, 2) AS effect FROM (SELECT o_orderkey, lower(replace(replace(o_orderpriority, '-', '_'), '_', ' ')) AS e FROM orders)""")
def pretty_effects(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", pretty_effect(F.replace("o_orderpriority", F.lit("-"), F.lit("_"))).alias("effect"))
