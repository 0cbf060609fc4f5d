"""Road conditions: work zones, incidents, cameras."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline import fixed_values as V
from wayline.functions.numbers import plural
from wayline.functions.text import html_cell, html_description, join_non_empty, non_empty
from wayline.functions.times import iso_time, iso_time_since_2000

NUMERIC_ID = r"^[0-9]+$"


def work_zone_provider(zone_id: Column, fallback: Column) -> Column:
    def starts(prefix: str) -> Column:
        return F.startswith(F.upper(F.coalesce(zone_id, F.lit(""))), F.lit(prefix))

    return (
        F.when(starts("VT"), "VTrans · New England 511 WZDx").when(starts("NH"), "NHDOT · New England 511 WZDx")
        .when(starts("ME"), "MaineDOT · New England 511 WZDx").otherwise(fallback)
    )


def in_window(start: Column, end: Column, now: Column) -> Column:
    """Active or upcoming: not ended more than the grace ago, not starting beyond the horizon."""
    earliest = F.timestamp_micros(F.unix_micros(now) - F.lit(V.WORK_ZONE_GRACE_S * 1_000_000))
    horizon = F.timestamp_micros(F.unix_micros(now) + F.lit(V.WORK_ZONE_HORIZON_S * 1_000_000))
    return F.coalesce((end >= earliest) & (start <= horizon), F.lit(False))


def work_zones(zones: DataFrame, now: Column) -> DataFrame:
    """Line work zones that are active or upcoming.

    ``zones``: the fields of ``schemas.WORK_ZONE`` plus ``provider, source_url, feed_updated`` (text).
    """
    p = F.col("properties")
    spaced = lambda x: F.replace(x, F.lit("-"), F.lit(" "))
    start, end = iso_time(p["start_date"]), iso_time(p["end_date"])
    impact = F.coalesce(p["vehicle_impact"], F.lit("unknown-impact"))
    closed = F.size(F.filter(F.coalesce(p["lanes"], F.array().cast("array<struct<status:string,type:string>>")), lambda x: x["status"] == "closed"))
    roads = F.array_join(F.filter(p["core_details"]["road_names"], lambda r: r.isNotNull() & (r != "")), " / ")
    works = F.array_join(F.filter(F.transform(p["types_of_work"], lambda w: spaced(w["type_name"])), lambda w: w.isNotNull() & (w != "")), ", ")
    color = (
        F.when(F.contains(impact, F.lit("all-lanes-closed")), "#ff5c5c")
        .when(F.contains(impact, F.lit("some")) | F.contains(impact, F.lit("reduced")), "#ffb454").otherwise("#ff8a4c")
    )
    kept = zones.where(in_window(start, end, now)).where(
        F.col("geometry.coordinates").isNotNull() & F.col("geometry.type").isin("LineString", "MultiLineString")
    )
    feed_time = iso_time_since_2000(F.col("feed_updated"), now)
    return kept.select(
        "id", "geometry", F.lit("roadwork").alias("grp"), F.lit("live").alias("data_status"), color.alias("color"),
        ((start <= now) & (end >= now)).alias("active"), F.coalesce(non_empty(roads), F.lit("Official work zone")).alias("title"),
        join_non_empty(" · ", spaced(p["core_details"]["direction"]), spaced(impact), F.when(closed > 0, plural(closed, "closed lane"))).alias("status"),
        F.coalesce(p["core_details"]["description"], F.lit("")).alias("details"), F.coalesce(works, F.lit("")).alias("work_types"),
        work_zone_provider(F.col("id"), F.col("provider")).alias("provider"), "source_url", start.alias("start_at"), end.alias("end_at"),
        iso_time_since_2000(p["core_details"]["update_date"], feed_time).alias("updated_at"),
    )


def valid_icons(icons: DataFrame) -> DataFrame:
    """Icons ``(source, itemId, location)`` with a numeric id and a lat/lng pair; axes are swapped here."""
    ok = F.rlike(F.coalesce("itemId", F.lit("")), F.lit(NUMERIC_ID)) & (F.size("location") == 2)
    return icons.where(F.coalesce(ok, F.lit(False))).select(
        "source", F.col("itemId").alias("item_id"), F.col("location")[1].alias("lng"), F.col("location")[0].alias("lat")
    )


def incidents(icons: DataFrame, pages: DataFrame, sources: DataFrame, now: Column, time_formats: tuple[str, ...] = ("M/d/yyyy h:mm a",)) -> DataFrame:
    """Incident features from icons and their tooltip pages (``source, item_id, html``); a missing page keeps the point.

    ``sources(source, base, provider)``.
    """
    joined = valid_icons(icons).join(pages, ["source", "item_id"], "left").join(sources, "source")
    html = F.coalesce("html", F.lit(""))
    text, started, until, changed = (
        html_description(html), html_cell(html, "Start Time"), html_cell(html, "Anticipated End Time"), html_cell(html, "Last Updated"),
    )
    rows = joined.withColumns({"details": text, "started": started, "until": until, "changed": changed})
    stamp = F.coalesce(non_empty(F.col("changed")), non_empty(F.col("started")))
    parsed = F.coalesce(iso_time(stamp), *[F.try_to_timestamp(stamp, F.lit(f)) for f in time_formats])
    return rows.select(
        F.concat_ws("-", "source", "item_id").alias("id"), "lng", "lat", F.lit("incident").alias("grp"), F.lit("live").alias("data_status"),
        F.lit("#ff5c5c").alias("color"), F.coalesce(non_empty(F.col("details")), F.lit("Official 511 road incident")).alias("title"),
        join_non_empty(" · ", F.concat(F.lit("Started "), non_empty(F.col("started"))),
                       F.concat(F.lit("Expected through "), non_empty(F.col("until")))).alias("status"),
        "details", "provider", F.concat(F.col("base"), F.lit("/Event/Incidents/"), F.col("item_id"), F.lit("?lang=en")).alias("source_url"),
        F.coalesce(parsed, now).alias("updated_at"),
        (stamp.isNotNull() & parsed.isNull()).alias("time_rejected"),
    )


def icon_cameras(icons: DataFrame, sources: DataFrame) -> DataFrame:
    return valid_icons(icons).join(sources, "source").select(
        F.concat_ws("-", "source", "item_id").alias("id"), "lng", "lat", F.lit("camera").alias("grp"), F.lit("live").alias("data_status"),
        F.lit("#d2d7dd").alias("color"), F.lit("Official traffic camera").alias("title"),
        F.lit("Click to load the latest public image").alias("status"), "provider", F.col("source").alias("provider_key"),
        F.col("item_id").alias("camera_id"), F.concat("base", F.lit("/")).alias("source_url"),
    )


def inventory_cameras(features: DataFrame) -> DataFrame:
    """Point features of the state inventory (``id, geometry, properties``)."""
    p, at = F.col("properties"), F.col("geometry.coordinates")
    return features.where((F.col("geometry.type") == "Point") & at.isNotNull()).select(
        F.concat(F.lit("ma-"), F.coalesce(F.col("id"), p["OBJECTID"])).alias("id"), at[0].alias("lng"), at[1].alias("lat"),
        F.lit("camera").alias("grp"), F.lit("live").alias("data_status"), F.lit("#d2d7dd").alias("color"),
        F.coalesce(p["HOC_Display"], p["Description"], F.lit("MassDOT traffic camera")).alias("title"),
        join_non_empty(" · ", F.concat(F.lit("Route "), non_empty(p["Roadway"])), p["Direction"], F.concat(F.lit("mile "), p["MM"]), p["Status"]).alias("status"),
        F.lit("MassDOT publishes the camera location; open Mass511 for the public viewer.").alias("details"),
        F.lit("MassDOT CCTV asset inventory").alias("provider"), F.lit("https://www.mass511.com/").alias("source_url"),
    )


def cameras(icons: DataFrame, sources: DataFrame, inventory: DataFrame) -> DataFrame:
    return icon_cameras(icons, sources).unionByName(inventory_cameras(inventory), allowMissingColumns=True)


def valid_request(kind: Column, value: Column) -> Column:
    """Validity of a request key: camera id, callsign, region or ``z/x/y`` tile."""
    part = F.split(value, "/")
    z, x, y = (F.get(part, F.lit(i)).try_cast("int") for i in range(3))
    side = F.pow(F.lit(2.0), F.coalesce(z, F.lit(0)))
    tile = F.rlike(value, F.lit(r"^[0-9]+/[0-9]+/[0-9]+$")) & (z <= 22) & (x < side) & (y < side)
    ok = (
        F.when(kind == "camera", F.rlike(value, F.lit(NUMERIC_ID))).when(kind == "callsign", F.rlike(value, F.lit(r"^[A-Z0-9]{3,8}$")))
        .when(kind == "region", value.isin(*V.REGION_IDS)).when(kind == "tile", tile)
    )
    return F.coalesce(ok, F.lit(False))
