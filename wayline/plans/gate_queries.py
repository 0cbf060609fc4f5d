"""Gates and readers that no other query runs: exact sets, crossing rules, JSON:API alerts and stops, estimate serving."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayline import fixed_values as V
from wayline.functions.text import camera_direction
from wayline.operators import catalogs as K
from wayline.operators import quality as Q
from wayline.operators import snapshots as N
from wayline.plans.base import STATION, query, stops_view, table, with_ctes
from wayline.sources import messages as M


def _values(names: list[str]) -> str:
    return ", ".join("('" + v.replace("'", "''") + "')" for v in names)


EXACT_SETS = {"train": V.REQUIRED_TRAINS, "vt_train": V.REQUIRED_VT_TRAINS, "vt_station": V.REQUIRED_VT_STATIONS, "water": V.REQUIRED_WATER_SERVICES}


def _exact_sql(kind: str, names: list[str]) -> str:
    return f"""SELECT '{kind}' AS kind, coalesce(have.v, want.v) AS name, CASE WHEN have.v IS NULL THEN 'missing' ELSE 'unexpected' END AS detail
 FROM (SELECT DISTINCT CASE WHEN o_custkey % 7 = 3 THEN 'stray ' || (o_custkey % 5) ELSE (SELECT v FROM (SELECT col0 AS v, row_number() OVER (ORDER BY col0) AS i FROM (VALUES {_values(names)}))
  WHERE i = 1 + o_custkey % {max(1, len(names) - 1)}) END AS v FROM orders) have FULL OUTER JOIN (SELECT col0 AS v FROM (VALUES {_values(names)})) want ON have.v = want.v WHERE have.v IS NULL OR want.v IS NULL"""


@query("QC04 JN21", " UNION ALL ".join(_exact_sql(k, v) for k, v in EXACT_SETS.items()))
def exact_sets(spark, sf):
    """Trains, Vermont trains and stations, and water services, each with one name missing and some strays."""
    o, found = table(spark, sf, "orders"), None
    for kind, names in EXACT_SETS.items():
        listed = F.array(*[F.lit(v) for v in sorted(names)])
        k = F.col("o_custkey")
        name = F.when(k % 7 == 3, F.concat(F.lit("stray "), (k % 5).cast("string"))).otherwise(F.get(listed, (k % max(1, len(names) - 1)).cast("int")))
        part = Q.required_set(o.select(name.alias("name")), "name", Q.literal_set(o, names)).select(F.lit(kind).alias("kind"), F.col("key").alias("name"), "detail")
        found = part if found is None else found.unionByName(part)
    return found


@query("QC08", """SELECT 'crossing' AS check_id, CAST(s_suppkey AS VARCHAR) AS key, unnest(list_filter([CASE WHEN s_suppkey % 3 = 0 THEN 'title' END, CASE WHEN s_suppkey % 4 = 1 THEN 'us_port' END,
 CASE WHEN s_suppkey % 5 = 2 THEN 'province' END], lambda e: e IS NOT NULL)) AS detail FROM supplier""")
def crossing_validity(spark, sf):
    k = F.col("s_suppkey")
    rows = table(spark, sf, "supplier").select(
        k, F.when(k % 3 == 0, "").otherwise(F.col("s_name")).alias("title"), F.when(k % 4 != 1, "Calais").alias("us_port"), F.when(k % 5 == 2, "ON").otherwise("QC").alias("province"),
    )
    return Q.rule_breaks(rows, "crossing", k.cast("string"), Q.crossing_rules())


@query("SRC15 AG10", """SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey % 10 AS severity, 'r' || (o_custkey % 9) AS routes, CASE WHEN o_orderkey % 2 = 0 THEN 's1,s' || (o_custkey % 4 + 2) ELSE 's1' END AS stops FROM orders""")
def api_alert_rows(spark, sf):
    """Alerts of JSON:API pages: informed entities repeat routes and stops and leave some out."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    route, stop = F.concat(F.lit("r"), (c % 9).cast("string")), F.concat(F.lit("s"), (c % 4 + 2).cast("string"))
    entity = lambda r, s: F.struct(r.alias("route"), s.alias("stop"))
    none = F.lit(None).cast("string")
    entities = F.array(entity(route, F.lit("s1")), entity(route, F.when(k % 2 == 0, stop)), entity(F.lit(""), none), entity(none, F.lit("s1")))
    page = F.struct(F.array(F.struct(k.cast("string").alias("id"), F.struct((k % 10).cast("int").alias("severity"), entities.alias("informed_entity")).alias("attributes"))).alias("data"))
    rows = M.api_alerts(table(spark, sf, "orders").select(F.to_json(page).alias("payload")))
    return rows.select("id", F.col("severity").cast("bigint").alias("severity"), F.array_join("routes", ",").alias("routes"), F.array_join("stops", ",").alias("stops"))


@query("SRC15", with_ctes(STATION, "SELECT stop, lng, lat FROM station WHERE CAST(stop AS BIGINT) % 5 != 0"))
def api_stop_rows(spark, sf):
    """Stops of JSON:API pages; those without a position are left out."""
    far = F.col("stop").cast("bigint") % 5 == 0
    place = F.struct(F.when(~far, F.col("lat")).alias("latitude"), F.when(~far, F.col("lng")).alias("longitude"))
    page = F.struct(F.array(F.struct(F.col("stop").alias("id"), place.alias("attributes"))).alias("data"))
    return M.api_stops(stops_view(spark, sf).select(F.to_json(page).alias("payload")))


@query("JN17", "SELECT s_suppkey AS feed, s_suppkey % 3 = 0 OR s_suppkey % 3 = 2 AS served FROM supplier")
def estimate_regions(spark, sf):
    k = F.col("s_suppkey")
    region = F.when(k % 3 == 0, "ct").when(k % 3 == 1, "vt").otherwise("new-england")
    return table(spark, sf, "supplier").select(k.alias("feed"), N.serves_estimates(region).alias("served"))


@query("FN13 SRC13", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN s_name || ' & north' ELSE '' END AS direction FROM supplier")
def camera_directions(spark, sf):
    k = F.col("s_suppkey")
    html = F.when(k % 2 == 0, F.concat(F.lit("<div class='dirDescHeader' id=x><b>"), F.col("s_name"), F.lit("</b>  &amp; north</div><p>x</p>"))).otherwise(F.lit("<div class='other'>x</div>"))
    return table(spark, sf, "supplier").select(k.alias("id"), F.coalesce(camera_direction(html), F.lit("")).alias("direction"))


@query("JN24", """SELECT k AS key, lng, lat FROM (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 4 != 3 THEN -75.0 + s_suppkey % 10 END AS lng, 44.0 + s_suppkey % 5 AS lat FROM supplier)
WHERE NOT coalesce(lng BETWEEN -74.0 AND -66.0 AND lat BETWEEN 44.8 AND 47.6, FALSE)""".replace("-75.0 + s_suppkey % 10", "CAST(-75 + s_suppkey % 10 AS DOUBLE)").replace("44.0 + s_suppkey % 5", "CAST(44 + s_suppkey % 5 AS DOUBLE)"))
def geocode_range(spark, sf):
    k = F.col("s_suppkey")
    rows = table(spark, sf, "supplier").select(
        k.alias("key"), F.when(k % 4 != 3, (F.lit(-75) + k % 10).cast("double")).alias("lng"), (F.lit(44) + k % 5).cast("double").alias("lat"),
    )
    return K.geocodes_out_of_range(rows)
