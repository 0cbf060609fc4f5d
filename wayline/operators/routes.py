"""GTFS tables to route and station features, all feeds in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline import fixed_values as V
from wayline.functions.text import non_empty, route_label, source_url
from wayline.operators.normalise import decode
from wayline.operators.ordered import OrderedScan, last_wins
from wayline.operators.paths import distinct_paths, ordered_points, path_scan, runs_in_box, segments
from wayline.operators.regions import assign_regions, ordered_regions, path_regions
from wayline.operators.repair import missing_gaps, repair_legs
from wayline.operators.simplify import simplify
from wayline.session import cut_lineage
from wayline.operators.trips import fallback_points, fallback_trips, route_shapes, routes_by_stop, select_routes, shape_points, stop_places


def route_group(kind: Column, override: Column) -> Column:
    names = {str(k): v for k, v in V.GROUP_BY_ROUTE_TYPE.items()}
    return F.coalesce(non_empty(override), decode(kind.cast("string"), names))


def route_color(kind: Column, group: Column, override: Column) -> Column:
    by_type = {str(k): v for k, v in V.COLOR_BY_ROUTE_TYPE.items()}
    return F.coalesce(non_empty(override), decode(group, V.COLOR_BY_GROUP), decode(kind.cast("string"), by_type), F.lit(V.NO_COLOR))


def agency_name(names: Column, agency_id: Column, fallback: Column) -> Column:
    return F.coalesce(F.try_element_at(names, F.coalesce(agency_id, F.lit(""))), fallback)


def route_properties(routes: DataFrame) -> DataFrame:
    """Properties of selected routes (columns of feed and route plus ``found`` regions and ``approximate``)."""
    group = route_group(F.col("kind"), F.col("group_override"))
    note = F.when(F.col("approximate"), F.concat(F.lit(V.SCHEDULE_NOTE), F.lit(" · "), F.lit(V.ROAD_NOTE))).otherwise(V.SCHEDULE_NOTE)
    url = F.when(F.col("use_route_urls"), F.col("route_url"))
    return routes.select(
        F.concat_ws(":", "feed", "route_id").alias("route"), group.alias("grp"),
        route_color(F.col("kind"), group, F.col("group_color")).alias("color"),
        agency_name(F.col("agency_names"), F.col("agency_id"), F.col("agency")).alias("agency"), F.col("label").alias("name"),
        F.lit("regional-static").alias("kind"), F.lit("scheduled").alias("data_status"),
        F.coalesce(non_empty(F.col("provider")), F.lit(V.DEFAULT_PROVIDER)).alias("provider"), note.alias("schedule_note"),
        ordered_regions(F.coalesce("found", F.array().cast("array<string>")), F.col("states")).alias("regions"),
        F.when(F.col("approximate"), "approximate").alias("geometry_accuracy"),
        F.when(F.col("approximate"), V.ROAD_GEOMETRY_PROVIDER).alias("geometry_provider"),
        F.when(F.col("approximate"), V.ROAD_NOTE).alias("geometry_note"),
        source_url(url, F.coalesce(non_empty(F.col("source_url")), F.lit(V.DEFAULT_SOURCE_URL))).alias("source_url"),
    )


def supplement_properties(features: DataFrame) -> DataFrame:
    """Defaults of supplemental corridors: given values win, colour follows the group."""
    ferry = F.col("grp") == "ferry"
    return features.withColumns(
        {
            "data_status": F.coalesce("data_status", F.lit("scheduled")),
            "geometry_accuracy": F.coalesce("geometry_accuracy", F.when(ferry, "approximate")),
            "geometry_note": F.coalesce("geometry_note", F.when(ferry, V.WATER_NOTE)),
            "color": decode(F.col("grp"), V.SUPPLEMENT_COLORS, V.NO_COLOR),
            "provider": F.coalesce("provider", F.lit("Official carrier schedule")),
            "regions": ordered_regions(F.coalesce("found", F.array().cast("array<string>")), F.col("declared"), append_declared=True),
        }
    )


@dataclass(frozen=True)
class RouteLegs:
    """Points and legs of all routes before roads are known; kept as tables, so that missing roads and drawings share them."""

    routes: DataFrame
    source_regions: DataFrame
    rounded: DataFrame
    legs: OrderedScan


KEYS = ["feed", "route_id", "path"]


def route_legs(gtfs: dict[str, DataFrame], feeds: DataFrame, edges: DataFrame) -> RouteLegs:
    """``gtfs``: tables with a ``feed`` column (and ``row_ix`` on trips); ``feeds``: the registry with ``id`` renamed ``feed``."""
    keys = KEYS
    routes = select_routes(gtfs["routes"], feeds)
    shaped = shape_points(gtfs["shapes"], route_shapes(gtfs["trips"], routes))
    bare = fallback_points(gtfs["stop_times"], gtfs["stops"], fallback_trips(gtfs["trips"], routes))
    raw = shaped.unionByName(bare)
    scan = path_scan(raw, keys, ["seq", "lng", "lat"]).extend(position="ix").settle()
    runs = runs_in_box(scan).withColumns(
        {"path": F.concat_ws("#", "path", F.col("run").cast("string"))}
    ).select(*keys, F.col("ix").cast("bigint").alias("ix"), "lng", "lat")
    runs = cut_lineage(runs)

    source_regions = cut_lineage(path_regions(runs, edges, keys))
    rules = routes.select("feed", "route_id", "kind", F.coalesce("require_region_match", F.lit(False)).alias("required"))
    kept = runs.join(rules, ["feed", "route_id"]).join(source_regions, keys, "left")
    kept = kept.where(~F.col("required") | F.col("found").isNotNull()).drop("found", "required")
    rounded = cut_lineage(kept.withColumns({"lng": F.round("lng", 5), "lat": F.round("lat", 5)}))
    legs = segments(path_scan(rounded.where(F.col("kind") == 3).select(*keys, "ix", "lng", "lat"), keys)).settle()
    return RouteLegs(routes, source_regions, rounded, legs)


def missing_roads(prepared: RouteLegs, roads: DataFrame) -> DataFrame:
    """Long gaps without geometry; draws nothing."""
    gaps = prepared.legs.df.where(F.col("leg_km") > V.MAX_CHORD_KM)
    return missing_gaps(gaps, roads).select(*KEYS, "from_token", "to_token", "segment")


def assemble_routes(gtfs: dict[str, DataFrame], feeds: DataFrame, edges: DataFrame, roads: DataFrame) -> dict[str, DataFrame]:
    """Route features of all feeds, from the tables of ``route_legs`` and ``roads``, valid cached road geometry.

    Returns ``features`` (one row per route), ``paths`` (long form, one numbered point per row) and ``missing`` (long gaps without geometry).
    """
    return draw_routes(route_legs(gtfs, feeds, edges), edges, roads)


def draw_routes(prepared: RouteLegs, edges: DataFrame, roads: DataFrame) -> dict[str, DataFrame]:
    """``assemble_routes`` from prepared legs."""
    keys, routes, source_regions, rounded, legs = KEYS, prepared.routes, prepared.source_regions, prepared.rounded, prepared.legs
    repaired = cut_lineage(repair_legs(legs, roads))
    approximate = repaired.where("repaired").select("feed", "route_id").distinct().withColumn("approximate", F.lit(True))
    pieces = repaired.withColumn("path", F.concat_ws("/", "path", F.col("piece").cast("string")))
    numbered = path_scan(pieces, keys, ["ix", "sub"]).extend(position="pos").df.select(*keys, F.col("pos").alias("ix"), "lng", "lat")
    bus_paths = simplify(cut_lineage(numbered), keys, chord_km=V.MAX_CHORD_KM, dense=True)
    other_paths = simplify(rounded.where(F.col("kind") != 3).select(*keys, "ix", "lng", "lat"), keys)
    drawn_paths = cut_lineage(bus_paths.unionByName(other_paths))

    route_keys = ["feed", "route_id"]
    # points are numbered from 0 within a path, so equal lines have equal rows whatever they were cut from
    lines = path_scan(drawn_paths, keys, ["ix"]).extend(position="pos").df.select(*keys, F.col("pos").alias("ix"), "lng", "lat")
    only = distinct_paths(lines, route_keys, "path").select(*keys)
    paths = drawn_paths.join(only, keys, "left_semi")
    # a path whose legs are all gaps without geometry is not drawn, and its regions are not the route's
    shown = repaired.select(*keys).unionByName(rounded.where(F.col("kind") != 3).select(*keys)).distinct()
    original = source_regions.join(shown, keys, "left_semi")
    regions = original.unionByName(path_regions(paths, edges, keys)).select(*route_keys, F.explode("found").alias("region")).distinct()
    found = regions.groupBy(*route_keys).agg(F.collect_set("region").alias("found"))
    drawn = paths.select(*route_keys).distinct()
    described = (
        routes.join(drawn, route_keys).join(found, route_keys, "left").join(approximate, route_keys, "left")
        .withColumn("approximate", F.coalesce("approximate", F.lit(False)))
    )
    return {
        "features": route_properties(described), "paths": paths,
        "missing": missing_roads(prepared, roads),
    }


def path_parts(paths: DataFrame, keys: list[str]) -> DataFrame:
    """Paths as bounded coordinate lists for writing."""
    return ordered_points(paths, keys)


def station_features(gtfs: dict[str, DataFrame], feeds: DataFrame, included: DataFrame, edges: DataFrame) -> DataFrame:
    """Stations of opted-in feeds with their regions and sorted route names. ``included(feed, route_id)``."""
    opted = feeds.where(F.coalesce("include_stations", F.lit(False)))
    trips = gtfs["trips"].join(included, ["feed", "route_id"], "left_semi").join(opted.select("feed"), "feed", "left_semi")
    calls = routes_by_stop(gtfs["stop_times"], trips)
    listed = gtfs["routes"]
    if "row_ix" in listed.columns:
        listed = last_wins(listed, ["feed", "route_id"], ["row_ix"])
    labels = listed.select(
        "feed", "route_id", route_label(F.col("route_short_name"), F.col("route_long_name"), F.col("route_id")).alias("label")
    )
    names = calls.join(labels, ["feed", "route_id"]).groupBy("feed", "stop_id").agg(
        F.array_sort(F.collect_set("label")).alias("route_names"),
        F.array_sort(F.collect_set(F.concat_ws(":", "feed", "route_id"))).alias("route_ids"),
    )
    placed = stop_places(gtfs["stops"])
    rows = assign_regions(names.join(placed, ["feed", "stop_id"]).join(opted.drop("url"), "feed"), edges)
    code = F.trim(F.coalesce(non_empty(F.col("stop_code")), F.col("stop_id")))
    group = F.col("group_override")
    return rows.where(F.size("regions") > 0).select(
        F.round("lng", 6).alias("lng"), F.round("lat", 6).alias("lat"), group.alias("grp"),
        F.coalesce(non_empty(F.col("group_color")), decode(group, V.COLOR_BY_GROUP), F.lit(V.NO_COLOR)).alias("color"),
        F.lit("regional-station").alias("kind"), F.lit("scheduled").alias("data_status"),
        F.coalesce(non_empty(F.col("stop_name")), F.concat("agency", F.lit(" station"))).alias("title"),
        F.concat("agency", F.lit(" station · "), code).alias("status"), F.concat(F.lit("Routes: "), F.array_join("route_names", ", ")).alias("details"),
        code.alias("station_code"), "route_ids", F.coalesce(non_empty(F.col("provider")), F.lit(V.DEFAULT_PROVIDER)).alias("provider"),
        source_url(F.col("stop_url"), F.col("source_url")).alias("source_url"), ordered_regions(F.col("regions")).alias("regions"),
    )


def visible_routes(features: DataFrame, region: str) -> DataFrame:
    """Route features shown for a region; local ones show only for the two home regions."""
    if region == "new-england":
        return features
    listed = F.coalesce(F.array_contains("regions", region), F.lit(False))
    regional = F.col("kind").isin("regional-static", "regional-station")
    return features.where(F.when(regional, listed).otherwise(F.lit(region in ("boston", "ma"))))


def feed_metadata(feeds: DataFrame, feed_info: DataFrame, features: DataFrame) -> DataFrame:
    """Per feed: feature count and, where asked for, publisher, version and dates of the first info row."""
    counts = features.groupBy(F.split_part("route", F.lit(":"), F.lit(1)).alias("feed")).agg(F.count(F.lit(1)).alias("features"))
    info = feeds.where("record_feed_info").select("feed").join(feed_info, "feed", "left")
    return feeds.select("feed", "agency", "url").join(counts, "feed", "left").join(info, "feed", "left").select(
        "feed", "agency", F.coalesce("features", F.lit(0)).alias("features"), "url",
        F.coalesce(non_empty(F.col("feed_publisher_name")), F.col("agency")).alias("publisher"),
        F.coalesce("feed_version", F.lit("")).alias("version"), F.coalesce("feed_start_date", F.lit("")).alias("start_date"),
        F.coalesce("feed_end_date", F.lit("")).alias("end_date"),
    )
