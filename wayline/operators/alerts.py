"""Service alerts: activity, scope, relevance, focus and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline import fixed_values as V
from wayline.functions.text import alert_severity, translated
from wayline.operators.regions import assign_regions, in_region


def any_period_active(periods: Column, now: Column) -> Column:
    """No period means always active; a missing end is open."""
    def covers(p: Column) -> Column:
        return (F.coalesce(p["start"], F.lit(0).cast("bigint")) <= now) & (p["end"].isNull() | (p["end"] >= now))

    return F.coalesce(F.size(periods), F.lit(0)).isin(0, -1) | F.coalesce(F.exists(periods, covers), F.lit(False))


def distinct_ids(entities: Column, field: str) -> Column:
    values = F.transform(entities, lambda e: e[field])
    return F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != "")))


def scoped_routes(entities: Column, known: list[str]) -> Column:
    return F.array_intersect(distinct_ids(entities, "route"), F.array(*[F.lit(r) for r in known]))


def normalise_alerts(alerts: DataFrame, now: Column, known_routes: list[str] | None = None) -> DataFrame:
    """Active alerts within scope.

    ``alerts(id, periods array<struct<start,end>>, entities array<struct<route,stop>>,
    header array<struct<text,language>>, description array<struct<text,language>>)``.
    """
    known = list(V.ESTIMATED_LINES) if known_routes is None else known_routes
    named = distinct_ids(F.col("entities"), "route")
    routes = scoped_routes(F.col("entities"), known)
    header = translated(F.col("header"))
    rows = alerts.where(any_period_active(F.col("periods"), now)).where((F.size(named) == 0) | (F.size(routes) > 0))
    return rows.select(
        "id", header.alias("header"), translated(F.col("description")).alias("description"), routes.alias("routes"),
        distinct_ids(F.col("entities"), "stop").alias("stops"),
    ).where(F.col("header") != "").withColumn(
        "severity", alert_severity(F.col("header"), V.ALERT_SEVERE, V.ALERT_DELAY)
    )


def relevant_alerts(alerts: DataFrame, routes: DataFrame) -> DataFrame:
    """Keep alerts that name a non-bus, Silver or unknown route, or are severe. ``routes(route, kind)``."""
    named = alerts.select("id", F.explode("routes").alias("route")).join(routes, "route", "left")
    other = (F.col("kind").isNull() | (F.col("kind") != 3)) | F.col("route").isin(*V.SILVER_ROUTES)
    non_bus = named.where(other).select("id").distinct().withColumn("non_bus", F.lit(True))
    return alerts.join(non_bus, "id", "left").where(
        F.coalesce("non_bus", F.lit(False)) | (F.col("severity") >= V.BADGE_MAJOR)
    ).drop("non_bus")


def worst_by_group(alerts: DataFrame, members: DataFrame) -> DataFrame:
    """Worst severity and badge per layer group; ``members(grp, route)``."""
    named = alerts.select("severity", F.explode("routes").alias("route"))
    # severities are few, so the distinct pairs stay small however many alerts name a route
    worst = named.groupBy("route").agg(F.max("severity").alias("severity"))
    per = members.join(worst, "route", "left").groupBy("grp").agg(F.coalesce(F.max("severity"), F.lit(0)).alias("worst"))
    badge = F.when(F.col("worst") >= V.BADGE_MAJOR, "major").when(F.col("worst") >= V.BADGE_MINOR, "minor")
    return per.withColumn("badge", badge)


def alert_points(alerts: DataFrame, stations: DataFrame) -> DataFrame:
    """Long table of alert stops with coordinates; unresolved stops are dropped, alerts without any keep one null row."""
    rows = alerts.select("id", F.posexplode_outer("stops").alias("at", "stop"))
    return rows.join(stations.select("stop", "lng", "lat"), "stop", "left")


def unresolved_stops(alerts: DataFrame, stations: DataFrame) -> DataFrame:
    return alerts.select(F.explode("stops").alias("stop")).distinct().join(stations.select("stop"), "stop", "left_anti")


def lookup_batches(stops: DataFrame, size: int = 250) -> DataFrame:
    """Batches of at most ``size`` ids for coordinate lookups; every id is in exactly one batch."""
    ids = stops.select("stop").distinct()
    buckets = max(1, ids.count() * 2 // size)
    hashed = ids.withColumn("bucket", F.pmod(F.xxhash64("stop"), F.lit(buckets)))
    listed = hashed.groupBy("bucket").agg(F.array_sort(F.collect_list("stop")).alias("ids"))
    starts = F.sequence(F.lit(0), F.floor((F.size("ids") - 1) / F.lit(size)).cast("int"))
    slices = F.transform(starts, lambda k: F.slice(F.col("ids"), k * size + 1, F.lit(size)))
    return listed.select("bucket", F.posexplode(slices).alias("part", "ids"))


def alerts_in_region(alerts: DataFrame, points: DataFrame, edges: DataFrame, region: str) -> DataFrame:
    """Alerts with a stop in the region; three regions show all."""
    if region in ("boston", "ma", "new-england"):
        return alerts
    inside = assign_regions(points.where(F.col("lng").isNotNull()), edges).where(in_region(F.col("regions"), region))
    return alerts.join(inside.select("id").distinct(), "id", "left_semi")


def focus_extents(alerts: DataFrame, points: DataFrame, route_boxes: DataFrame) -> DataFrame:
    """Box of the alert's stops, else of its routes. ``route_boxes(route, west, south, east, north)``."""
    def box(prefix: str) -> list[Column]:
        return [F.min("west").alias(f"{prefix}w"), F.min("south").alias(f"{prefix}s"),
                F.max("east").alias(f"{prefix}e"), F.max("north").alias(f"{prefix}n")]

    stop_points = points.where(F.col("lng").isNotNull()).select(
        "id", F.col("lng").alias("west"), F.col("lng").alias("east"), F.col("lat").alias("south"), F.col("lat").alias("north")
    )
    by_stop = stop_points.groupBy("id").agg(*box("p"))
    by_route = alerts.select("id", F.explode("routes").alias("route")).join(route_boxes, "route").groupBy("id").agg(*box("r"))
    joined = alerts.select("id").join(by_stop, "id", "left").join(by_route, "id", "left")
    return joined.select(
        "id", F.when(F.col("pw").isNotNull(), "stops").when(F.col("rw").isNotNull(), "routes").otherwise("none").alias("focus"),
        *[F.coalesce(F.col(f"p{k}"), F.col(f"r{k}")).alias(n) for k, n in zip("wsen", ("west", "south", "east", "north"))],
    )


def ranked(alerts: DataFrame) -> DataFrame:
    return alerts.orderBy(F.desc("severity"), "source", "id")
