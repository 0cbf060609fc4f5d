"""Region assignment queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline import fixed_values as V
from wayline.functions.geo import in_box
from wayline.functions.numbers import finite
from wayline.functions.times import older_than
from wayline.operators import counts as C
from wayline.operators import regions as R
from wayline.operators import sketches as K
from wayline.plans.base import (
    FIX, FIXPATH, NOW_S, STATION, TRACK, edge_values, fixes, inside_cte, now, query, r6, region_edges, stops_view, table, track, with_ctes,
)
from wayline.session import cut_lineage

INSIDE = inside_cte("fix")
STALE = f"(CAST({NOW_S} AS BIGINT) * 1000000 - ts_us) / 1e6 > 90"


def live_fixes(spark: SparkSession, sf: str) -> DataFrame:
    return fixes(spark, sf).withColumn("stale", older_than(F.col("updated_at"), now(), 90))


@query("JN01 AG03 PRJ19 SRC22", with_ctes(FIX, edge_values(), INSIDE, f"""
SELECT region, source, grp, count(*) AS n, count(*) FILTER (WHERE {STALE}) AS n_stale
FROM fix JOIN inside USING (id) GROUP BY region, source, grp"""))
def region_counts(spark, sf):
    return C.region_counts(live_fixes(spark, sf), region_edges(spark))


@query("JN01", with_ctes(FIX, edge_values(), INSIDE, "SELECT id, lng, lat FROM fix JOIN inside USING (id) WHERE region = 'notch'"))
def region_hole(spark, sf):
    rows = R.assign_regions(fixes(spark, sf), region_edges(spark))
    return rows.where(R.in_region(F.col("regions"), "notch")).select("id", "lng", "lat")


@query("JN01", with_ctes(FIX, edge_values(), INSIDE, """
SELECT id, coalesce(string_agg(region, ',' ORDER BY region), '') AS regions FROM fix LEFT JOIN inside USING (id) GROUP BY id"""))
def region_shuffle_join(spark, sf):
    """The path for region tables beyond the broadcast bound, forced here."""
    with R.broadcast_bound(0):
        rows = R.assign_regions(fixes(spark, sf), region_edges(spark))
    return rows.select("id", F.array_join("regions", ",").alias("regions"))


@query("AG03 FLT17", with_ctes(FIX, edge_values(), INSIDE, """
SELECT source, grp, count(*) AS n FROM fix WHERE id IN (SELECT id FROM inside WHERE region IN ('ct','me','ma','nh','ri','vt')) GROUP BY source, grp"""))
def counts_in_parent(spark, sf):
    return C.counts_in_region(fixes(spark, sf), region_edges(spark), "new-england")


@query("AG03 JN01", with_ctes(FIX, edge_values(), INSIDE, """, st AS (SELECT id, region, grp FROM fix JOIN inside USING (id) WHERE region IN ('ct','me','ma','nh','ri','vt'))
SELECT region, grp, count(*) AS n FROM st GROUP BY GROUPING SETS ((region, grp), (region))
UNION ALL
SELECT 'new-england' AS region, grp, count(DISTINCT id) AS n FROM st GROUP BY GROUPING SETS ((grp), ())""").replace("\n, st", ", st"))
def region_rollup(spark, sf):
    return C.region_rollup(fixes(spark, sf), region_edges(spark))


@query("JN02 AG14", with_ctes(FIX, FIXPATH, edge_values(), INSIDE, """, hit AS (SELECT DISTINCT path, region FROM fixpath JOIN inside USING (id)),
o(region, rk) AS (VALUES ('ct',1),('ma',2),('me',3),('nh',4),('ri',5),('vt',6),('boston',7))
SELECT path, coalesce(string_agg(o.region, ',' ORDER BY rk), '') AS regions FROM hit LEFT JOIN o USING (region) GROUP BY path""").replace("\n, hit", ", hit"))
def path_regions(spark, sf):
    pts = fixes(spark, sf).withColumnRenamed("entity", "path")
    found = R.path_regions(pts, region_edges(spark), ["path"])
    return found.select("path", F.array_join(R.ordered_regions(F.col("found")), ",").alias("regions"))


@query("JN03", with_ctes(TRACK, edge_values(), inside_cte("track"), """
SELECT path, id FROM track WHERE path % 3 != 0 OR path IN (SELECT path FROM track JOIN inside USING (id))"""))
def required_region_paths(spark, sf):
    pts = track(spark, sf).withColumn("required", F.col("path") % 3 == 0)
    return R.paths_in_required_region(pts, region_edges(spark), ["path"], "required").select("path", "id")


@query("FLT01 FLT02", with_ctes(FIX, """
SELECT id, lng BETWEEN -74.0 AND -66.0 AND lat BETWEEN 40.8 AND 47.7 AS live_box, lng BETWEEN -75.0 AND -65.0 AND lat BETWEEN 40.0 AND 48.5 AS build_box,
  lng > -74.1 AND lng < -65.8 AND lat > 40.7 AND lat < 47.75 AS train_box, lng > -72.0 AND lng < -70.0 AND lat > 42.0 AND lat < 44.0 AS open_box,
  lng BETWEEN -72.0 AND -70.0 AND lat BETWEEN 42.0 AND 44.0 AS closed_box
FROM fix"""))
def bbox_variants(spark, sf):
    x, y = finite(F.col("lng")), finite(F.col("lat"))
    small = (-72.0, 42.0, -70.0, 44.0)
    f = fixes(spark, sf).where(x.isNotNull() & y.isNotNull())
    return f.select(
        "id", in_box(x, y, V.LIVE_BOX).alias("live_box"), in_box(x, y, V.BUILD_BOX).alias("build_box"),
        in_box(x, y, V.TRAIN_BOX, inclusive=False).alias("train_box"), in_box(x, y, small, inclusive=False).alias("open_box"),
        in_box(x, y, small).alias("closed_box"),
    )


def _probe_values() -> str:
    rows = [f"('{k}',{i},{lat}::DOUBLE,{lng}::DOUBLE,{nm}*1.852::DOUBLE)" for k, ps in V.PROBES.items() for i, (lat, lng, nm) in enumerate(ps)]
    return f"probe(region, probe_ix, lat0, lng0, radius_km) AS (VALUES {', '.join(rows)})"


@query("JN16 SRC22 FN01", with_ctes(FIX, _probe_values(), """
SELECT region, CAST(probe_ix AS INTEGER) AS probe_ix, count(*) AS n, round(max(2 * 6371.0 * asin(sqrt(pow(sin(radians(lat - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(lat))
  * pow(sin(radians(lng - lng0) / 2), 2)))), 6) AS farthest_km
FROM fix, probe WHERE 2 * 6371.0 * asin(sqrt(pow(sin(radians(lat - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(lat))
  * pow(sin(radians(lng - lng0) / 2), 2))) <= radius_km GROUP BY ALL"""))
def probe_join(spark, sf):
    hits = R.within_radius(fixes(spark, sf), R.probe_table(spark))
    return hits.groupBy("region", "probe_ix").agg(F.count(F.lit(1)).alias("n"), r6(F.max("distance_km")).alias("farthest_km"))


@query("FLT17", with_ctes("""listed AS (SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN ['ct'] WHEN 1 THEN ['ma','boston'] ELSE ['vt','nh'] END AS regions FROM supplier)""", """
SELECT id, list_contains(regions, 'vt') AS in_vt, list_contains(regions, 'boston') AS in_boston, TRUE AS in_parent FROM listed"""))
def listed_regions(spark, sf):
    k = F.col("s_suppkey") % 3
    arr = lambda *v: F.array(*[F.lit(x) for x in v])
    rows = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), F.when(k == 0, arr("ct")).when(k == 1, arr("ma", "boston")).otherwise(arr("vt", "nh")).alias("regions")
    )
    return rows.select("id", *[R.lists_region(F.col("regions"), r).alias(n) for r, n in [("vt", "in_vt"), ("boston", "in_boston"), ("new-england", "in_parent")]])


@query("AG15 JN13", with_ctes(FIX, STATION, """layer AS (SELECT grp, 0 AS rank, lng, lat FROM fix WHERE grp IN ('click','view')
  UNION ALL SELECT CASE s_suppkey % 3 WHEN 0 THEN 'view' WHEN 1 THEN 'error' ELSE 'depot' END, 1, lng, lat FROM station JOIN supplier ON stop = CAST(s_suppkey AS VARCHAR)),
best AS (SELECT grp, min(rank) AS rank FROM layer GROUP BY grp)""", """
SELECT grp, min(lng) AS west, min(lat) AS south, max(lng) AS east, max(lat) AS north, rank FROM layer JOIN best USING (grp, rank) GROUP BY grp, rank"""))
def group_extents(spark, sf):
    first = fixes(spark, sf).where(F.col("grp").isin("click", "view"))
    k = F.col("stop").cast("bigint") % 3
    second = stops_view(spark, sf).withColumn("grp", F.when(k == 0, "view").when(k == 1, "error").otherwise("depot"))
    return C.group_extent([first, second])


@query("AG03 AG04", with_ctes(FIX, edge_values(), INSIDE, """, st AS (SELECT id, region, grp FROM fix JOIN inside USING (id) WHERE region IN ('ct','me','ma','nh','ri','vt'))
SELECT region, grp, count(DISTINCT id) AS exact, TRUE AS within FROM st GROUP BY region, grp
UNION ALL SELECT 'new-england' AS region, grp, count(DISTINCT id) AS exact, TRUE AS within FROM st GROUP BY grp""").replace("\n, st", ", st"))
def distinct_rollup(spark, sf):
    """Distinct fixes per region and group from sketches by region, group and hour, with the exact counts beside and whether the stated error holds."""
    rows = R.assign_regions(fixes(spark, sf), region_edges(spark))
    rows = rows.select("id", "grp", F.floor(F.col("ts_us") / 3_600_000_000).alias("hour"), F.explode("regions").alias("region")).where(F.col("region").isin(V.STATE_IDS))
    by_hour = cut_lineage(K.sketch_table(rows, ["region", "grp", "hour"], F.col("id")))
    estimates = K.estimated(K.with_parents(K.united(by_hour, ["region", "grp"]), "region", {"new-england": V.STATE_IDS}))
    above = rows.unionByName(rows.withColumn("region", F.lit("new-england")))
    exact = above.groupBy("region", "grp").agg(F.countDistinct("id").alias("exact"))
    return exact.join(estimates, ["region", "grp"]).select("region", "grp", "exact", F.col("exact").between(F.col("low"), F.col("high")).alias("within"))
