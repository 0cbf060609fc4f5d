"""Source rows to the one position schema (``schemas.FIX``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline import fixed_values as V
from wayline.functions.geo import in_box
from wayline.functions.numbers import (
    finite, fixed_text, knots_to_mph, meters_to_miles, mps_to_mph, plain_text, plural, round_half_up, safe_number,
)
from wayline.functions.text import join_non_empty, non_empty, status_phrase
from wayline.functions.times import delay_label, epoch_time, iso_time, older_than
from wayline.schemas import FIX_COLUMNS


def _text(value: str | None) -> Column:
    return F.lit(value).cast("string")


def to_fix(df: DataFrame, **columns: Column) -> DataFrame:
    """Select the position schema; columns not given are null."""
    types = dict(FIX_COLUMNS)
    return df.select(*[columns.get(n, F.lit(None)).cast(t).alias(n) for n, t in types.items()])


def literal_map(codes: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])


def decode(code: Column, codes: dict[str, object], default: str | None = None) -> Column:
    found = F.try_element_at(literal_map(codes), F.coalesce(code, F.lit("")))
    return found if default is None else F.coalesce(found, F.lit(default))


def has_coordinates(lng: Column, lat: Column) -> Column:
    return finite(lng).isNotNull() & finite(lat).isNotNull()


def revenue_only(vehicles: DataFrame) -> DataFrame:
    """Vehicles with a route and coordinates that are in revenue service."""
    return vehicles.where(
        (F.coalesce("route", F.lit("")) != "") & has_coordinates(F.col("lng"), F.col("lat"))
        & ~F.col("revenue").eqNullSafe(F.lit("NON_REVENUE"))
    )


def age_rows(fixes: DataFrame, now: Column) -> DataFrame:
    """Recompute ``stale`` from each source's limit; an unknown time is stale."""
    return fixes.withColumn("stale", older_than(F.col("updated_at"), now, decode(F.col("source"), V.STALE_AFTER_S)))


def vehicle_positions(entities: DataFrame, now: Column, box=V.LIVE_BOX) -> DataFrame:
    """Realtime vehicle entities (``sources.realtime.vehicle_entities``) inside the live box."""
    v = F.col("vehicle")
    lng, lat = finite(v["position"]["longitude"]), finite(v["position"]["latitude"])
    inner = v["vehicle"]
    vehicle_id = F.coalesce(non_empty(inner["id"]), non_empty(inner["label"]), F.col("id"))
    stamp = F.coalesce(v["timestamp"], F.col("header_timestamp"))
    rows = entities.where(lng.isNotNull() & lat.isNotNull() & in_box(lng, lat, box))
    return rows.select(
        F.concat_ws("-", "feed", vehicle_id).alias("id"), "feed", "agency", lng.alias("lng"), lat.alias("lat"),
        F.coalesce(v["trip"]["routeId"], F.lit("")).alias("route"), F.coalesce(v["trip"]["tripId"], F.lit("")).alias("trip"),
        F.coalesce(inner["label"], inner["id"], F.lit("")).alias("label"), finite(v["position"]["bearing"]).alias("bearing"),
        finite(v["position"]["speed"]).alias("speed_mps"),
        F.when(stamp != 0, F.timestamp_seconds(stamp)).otherwise(now).alias("updated_at"),
    )


def regional_buses(vehicles: DataFrame, now: Column) -> DataFrame:
    agency, route = F.col("agency"), non_empty(F.col("route"))
    mph = round_half_up(mps_to_mph(finite(F.col("speed_mps"))))
    return to_fix(
        vehicles, id=F.concat(F.lit("regional-"), F.col("id")), source=_text("regional"), grp=_text("bus"),
        data_status=_text("live"), color=_text(V.COLOR_BY_ROUTE_TYPE[3]), lng=F.col("lng"), lat=F.col("lat"),
        bearing=F.coalesce("bearing", F.lit(0.0)), has_bearing=finite(F.col("bearing")).isNotNull(),
        stale=older_than(F.col("updated_at"), now, V.STALE_AFTER_S["regional"]),
        title=F.when(route.isNotNull(), F.concat(agency, F.lit(" · "), route)).otherwise(agency),
        dest=F.coalesce(F.concat(F.lit("Vehicle "), non_empty(F.col("label"))), F.lit("")),
        status=F.coalesce(F.concat(mph.cast("string"), F.lit(" mph")), F.lit("In service")),
        meta=F.concat(F.lit("GTFS-RT · "), F.col("feed")), provider=F.concat(agency, F.lit(" GTFS-Realtime")),
        updated_at=F.col("updated_at"),
    )


def aircraft(rows: DataFrame, now: Column) -> DataFrame:
    """Aircraft rows ``(hex, flight, kind, lat, lon, track, gs, seen, alt_baro, provider)``, already deduped."""
    lng, lat = safe_number(F.col("lon")), safe_number(F.col("lat"))
    ground = F.coalesce(F.col("alt_baro") == "ground", F.lit(False))
    feet = F.when(~ground, safe_number(F.col("alt_baro")))
    mph = round_half_up(knots_to_mph(safe_number(F.col("gs"))))
    callsign = F.trim(F.coalesce("flight", F.lit("")))
    seen_us = F.coalesce(safe_number(F.col("seen")), F.lit(0.0)) * 1e6
    moving = join_non_empty(
        " · ", F.concat(F.format_number(feet.cast("bigint"), 0), F.lit(" ft")), F.concat(mph.cast("string"), F.lit(" mph"))
    )
    kept = rows.where((F.coalesce("hex", F.lit("")) != "") & lng.isNotNull() & lat.isNotNull())
    return to_fix(
        kept, id=F.concat(F.lit("plane-"), F.col("hex")), source=_text("planes"), grp=_text("plane"),
        data_status=_text("live"), color=_text("#9be1ff"), lng=lng, lat=lat,
        bearing=F.coalesce(safe_number(F.col("track")), F.lit(0.0)), has_bearing=safe_number(F.col("track")).isNotNull(),
        stale=ground, title=F.coalesce(non_empty(callsign), F.upper("hex")), dest=F.coalesce("kind", F.lit("")),
        status=F.when(ground, "On the ground").otherwise(moving), meta=F.concat(F.lit("icao "), F.col("hex")),
        provider=F.coalesce(non_empty(F.col("provider")), F.lit("ADSB public telemetry")),
        source_url=_text("https://api.adsb.lol/"),
        updated_at=F.timestamp_micros((F.unix_micros(now) - seen_us).cast("bigint")),
    )


def trains(rows: DataFrame, now: Column, box=V.TRAIN_BOX, ttl_s: float = V.STALE_AFTER_S["amtrak"]) -> DataFrame:
    """Train records (``schemas.TRAIN``) inside the open box, completed ones dropped."""
    lng, lat = safe_number(F.col("lon")), safe_number(F.col("lat"))
    stations = F.coalesce("stations", F.array().cast("array<struct<name:string,status:string,schArr:string,arr:string>>"))
    nxt = F.get(F.filter(stations, lambda s: s["status"] == "Enroute"), F.lit(0))
    final = F.get(stations, F.size(stations) - 1)
    origin = F.coalesce(non_empty(F.col("origName")), F.get(stations, F.lit(0))["name"])
    dest = F.coalesce(non_empty(F.col("destName")), final["name"])
    pre = F.coalesce(F.col("trainState") == "Predeparture", F.lit(False))
    updated = F.when(pre, now).otherwise(iso_time(F.coalesce("lastValTS", "updatedAt")))
    delay = delay_label(iso_time(nxt["schArr"]), iso_time(nxt["arr"]))
    heading = decode(F.col("heading"), V.COMPASS)
    velocity = round_half_up(safe_number(F.col("velocity")))
    under_way = F.concat(F.lit("Next stop "), nxt["name"], F.coalesce(F.concat(F.lit(" · "), non_empty(delay)), F.lit("")))
    kept = rows.where(
        ~F.coalesce(F.col("trainState") == "Completed", F.lit(False)) & F.coalesce(in_box(lng, lat, box, inclusive=False), F.lit(False))
    )
    return to_fix(
        kept, id=F.concat(F.lit("amtrak-"), F.coalesce("trainID", "trainNum")), source=_text("amtrak"), grp=_text("amtrak"),
        data_status=F.when(pre, "estimated").otherwise("live"), color=_text("#5b9bd5"), lng=lng, lat=lat,
        bearing=F.coalesce(heading, F.lit(0.0)), has_bearing=heading.isNotNull(), stale=older_than(updated, now, ttl_s),
        title=F.trim(F.concat(F.lit("Amtrak "), F.coalesce("routeName", F.lit("")))),
        dest=F.coalesce(F.concat(non_empty(origin), F.lit(" → "), non_empty(dest)), F.concat(F.lit("to "), non_empty(dest)), F.lit("")),
        status=F.when(
            pre, F.concat(F.lit("Scheduled to depart "), F.coalesce(non_empty(origin), non_empty(nxt["name"]), F.lit("origin station")))
        ).otherwise(F.coalesce(F.when(non_empty(nxt["name"]).isNotNull(), under_way), F.col("trainState"), F.lit(""))),
        meta=join_non_empty(
            " · ", F.concat(F.lit("train "), non_empty(F.col("trainNum"))), F.concat(velocity.cast("string"), F.lit(" mph"))
        ),
        provider=_text("Amtraker community Amtrak telemetry"), source_url=_text("https://amtraker.com/"), updated_at=updated,
    )


def vessels(rows: DataFrame, now: Column, ttl_s: float = V.STALE_AFTER_S["ais"]) -> DataFrame:
    """Vessel state rows ``(mmsi, lng, lat, name, sog, heading, ship_type, at)``."""
    kind = finite(F.col("ship_type"))
    heading, sog = finite(F.col("heading")), finite(F.col("sog"))
    name = F.coalesce("name", F.lit(""))
    ferry = F.coalesce(kind.between(60, 69), F.lit(False)) | F.rlike(name, F.lit(V.FERRY_NAME))
    label = F.concat(F.lit("MMSI "), F.col("mmsi").cast("string"))
    return to_fix(
        rows, id=F.concat(F.lit("vessel-"), F.col("mmsi").cast("string")), source=_text("ais"),
        grp=F.when(ferry, "ferry").otherwise("vessel"), data_status=_text("live"),
        color=F.when(ferry, V.COLOR_BY_ROUTE_TYPE[4]).otherwise("#63d8c8"), lng=F.col("lng"), lat=F.col("lat"),
        bearing=F.coalesce(heading, F.lit(0.0)), has_bearing=heading.isNotNull(), stale=older_than(F.col("at"), now, ttl_s),
        title=F.coalesce(non_empty(name), label),
        dest=F.coalesce(F.concat(F.lit("Heading "), round_half_up(heading).cast("string"), F.lit("°")), F.lit("")),
        status=F.coalesce(F.concat(fixed_text(sog, 1), F.lit(" kn")), F.lit("")),
        meta=F.concat(label, F.coalesce(F.concat(F.lit(" · AIS type "), plain_text(kind)), F.lit(""))),
        provider=_text("AISStream public vessel telemetry"), source_url=_text("https://aisstream.io/"), updated_at=F.col("at"),
    )


def true_heading(heading: Column, course: Column) -> Column:
    """511 means no heading; the course stands in."""
    h = finite(heading)
    return F.when(h.isNotNull() & (h != 511), h).otherwise(finite(course))


def layer_group(route: Column, kind: Column) -> Column:
    return (
        F.when(route.isin(*V.SILVER_ROUTES), "silver").when(kind == 2, "commuter").when(kind == 3, "bus").when(kind == 4, "ferry")
        .when(route == "Mattapan", "mattapan").when(F.startswith(route, F.lit("Green")), "green").otherwise(F.lower(route))
    )


def occupancy_band(shares: Column) -> Column:
    """Crowding text of the mean carriage occupancy; carriages without a number do not count."""
    known = F.filter(shares, lambda s: s.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda a, s: a + s.cast("double")) / F.nullif(F.size(known), F.lit(0))
    return (
        F.when(mean.isNull(), "").when(mean < 30, "Light crowding").when(mean < 60, "Moderate crowding").otherwise("Heavy crowding")
    )


def transit_vehicles(vehicles: DataFrame, routes: DataFrame, stops: DataFrame, now: Column) -> DataFrame:
    """Vehicles joined to route info and stop names.

    ``vehicles(id, route, stop, lng, lat, bearing, status, direction_id, label, occupancy, revenue, updated_at)``,
    ``routes(route, kind, short_name, long_name, color, destinations)``, ``stops(stop, stop_name)``.
    """
    joined = revenue_only(vehicles).join(routes, "route", "left").join(stops, "stop", "left")
    joined = joined.withColumn("g", layer_group(F.col("route"), F.col("kind")))
    short, long = F.col("short_name"), F.col("long_name")
    title = (
        F.when(F.col("g") == "silver", F.trim(F.concat(F.lit("Silver Line "), F.coalesce(short, F.lit("")))))
        .when(F.col("g") == "bus", F.concat(F.lit("Bus "), F.coalesce(non_empty(short), F.col("route"))))
        .otherwise(F.coalesce(long, F.col("route")))
    )
    headed = F.get("destinations", F.col("direction_id"))
    return to_fix(
        joined, id=F.col("id"), source=_text("transit"), grp=F.col("g"), data_status=_text("live"),
        color=F.coalesce("color", F.lit("#8a939c")), lng=F.col("lng"), lat=F.col("lat"),
        bearing=F.coalesce("bearing", F.lit(0.0)), has_bearing=F.col("bearing").isNotNull(),
        stale=older_than(F.col("updated_at"), now, V.STALE_AFTER_S["transit"]), title=title,
        dest=F.coalesce(F.concat(F.lit("to "), non_empty(headed)), F.lit("")), status=status_phrase(F.col("status"), F.col("stop_name")),
        meta=join_non_empty(" · ", F.concat(F.lit("car "), non_empty(F.col("label"))), F.lower("occupancy")),
        provider=_text("MBTA V3 vehicle feed"), source_url=_text("https://www.mbta.com/developers/v3-api"), updated_at=F.col("updated_at"),
    )


def docks(status: DataFrame, info: DataFrame, systems: DataFrame, now: Column) -> DataFrame:
    """Rentable stations with stock text. ``systems(system, system_name, system_color)``."""
    rentable = F.coalesce("is_installed", F.lit(True)) & F.coalesce("is_renting", F.lit(True))
    rows = status.where(rentable).join(info, ["system", "station_id"]).join(systems, "system")
    bikes, electric, free = (F.coalesce(c, F.lit(0)) for c in ("num_bikes_available", "num_ebikes_available", "num_docks_available"))
    return to_fix(
        rows, id=F.concat(F.col("system"), F.lit("-station-"), F.col("station_id")), source=_text("shared-mobility"), grp=_text("bike"),
        data_status=_text("live"), lng=F.col("lon"), lat=F.col("lat"), bearing=F.lit(0.0), has_bearing=F.lit(False), stale=bikes == 0,
        color=F.when(bikes == 0, "#5c6570").when(bikes <= 2, "#ffb454").otherwise(F.col("system_color")), title=F.col("system_name"),
        dest=F.col("name"),
        status=F.concat(
            plural(bikes, "bike"), F.when(electric > 0, F.concat(F.lit(" ("), electric.cast("string"), F.lit(" electric)"))).otherwise(""),
            F.lit(" · "), plural(free, "dock"), F.lit(" open"),
        ),
        meta=F.coalesce(F.concat(F.lit("capacity "), F.col("capacity").cast("string")), F.lit("GBFS station")),
        provider=F.concat(F.col("system_name"), F.lit(" · GBFS")),
        updated_at=epoch_time(F.col("last_reported"), epoch_time(F.col("last_updated"), now)),
    )


def free_vehicles(vehicles: DataFrame, types: DataFrame, systems: DataFrame, now: Column) -> DataFrame:
    """Rentable free-floating vehicles; ``dest`` names the kind, ``meta`` is fixed."""
    lng, lat = safe_number(F.col("lon")), safe_number(F.col("lat"))
    open_ = ~F.coalesce("is_disabled", F.lit(False)) & ~F.coalesce("is_reserved", F.lit(False))
    rows = vehicles.where(open_ & lng.isNotNull() & lat.isNotNull()).join(types, ["system", "vehicle_type_id"], "left").join(systems, "system")
    miles = round_half_up(meters_to_miles(safe_number(F.col("current_range_meters"))))
    share = round_half_up(safe_number(F.col("current_fuel_percent")) * 100)
    text = join_non_empty(
        " · ", F.concat(share.cast("string"), F.lit("% battery")), F.concat(F.lit("about "), miles.cast("string"), F.lit(" mi range"))
    )
    return to_fix(
        rows, id=F.concat(F.col("system"), F.lit("-vehicle-"), F.coalesce("bike_id", "vehicle_id")), source=_text("shared-mobility"),
        grp=_text("bike"), data_status=_text("live"), color=F.coalesce("system_color", F.lit("#69d277")), lng=lng, lat=lat,
        bearing=F.lit(0.0), has_bearing=F.lit(False), stale=F.lit(False), title=F.col("system_name"),
        dest=F.when(F.col("form_factor") == "scooter", "electric scooter").when(F.col("propulsion_type") == "human", "bike").otherwise("electric bike"),
        status=F.coalesce(non_empty(text), F.lit("Available to rent")), meta=_text("free-floating GBFS vehicle"),
        provider=F.concat(F.col("system_name"), F.lit(" · GBFS")),
        updated_at=epoch_time(F.col("last_reported"), epoch_time(F.col("last_updated"), now)),
    )


def estimated_trains(estimates: DataFrame, now: Column, feed_time: Column) -> DataFrame:
    """Estimated commuter trains (``trips.estimate_positions`` plus ``trip``, ``label``, ``route``)."""
    named = F.coalesce(F.concat(F.lit("Train "), non_empty(F.col("label"))), F.lit("Train"))
    return to_fix(
        estimates, id=F.concat(F.lit("mnr-"), F.col("trip").cast("string")), source=_text("mnr"), grp=_text("commuter"),
        data_status=_text("estimated"), color=_text(V.ESTIMATED_LINE_COLOR), lng=F.col("lng"), lat=F.col("lat"),
        bearing=F.col("bearing"), has_bearing=F.lit(True), stale=older_than(feed_time, now, V.STALE_AFTER_S["mnr"]),
        title=F.concat(F.lit("Metro-North · "), decode(F.col("route"), V.ESTIMATED_LINES), F.lit(" Line")),
        dest=F.concat(named, F.coalesce(F.concat(F.lit(" to "), F.col("dest_name")), F.lit(""))), status=F.col("status"),
        meta=_text("Estimated position from MTA trip updates"), provider=_text("MTA Metro-North GTFS-Realtime"),
        source_url=_text("https://www.mta.info/developers"), updated_at=feed_time,
    )


def itineraries(fixes: DataFrame, catalog: DataFrame) -> DataFrame:
    """Callsign to itinerary; ``catalog(callsign, airports array<struct<name,icao,iata>>)`` with at least two airports."""
    usable = catalog.where(F.size("airports") >= 2).select(F.upper(F.trim("callsign")).alias("key"), "airports")
    keyed = fixes.withColumn("key", F.upper(F.trim("callsign"))).where(F.rlike("key", F.lit(r"^[A-Z0-9]{3,8}$")))
    codes = F.filter(F.transform("airports", lambda a: F.coalesce(non_empty(a["iata"]), non_empty(a["icao"]))), lambda c: c.isNotNull())
    return keyed.join(usable, "key", "left").select(
        *fixes.columns, F.array_join(codes, " → ").alias("itinerary"),
        F.concat(F.col("airports")[0]["name"], F.lit(" → "), F.element_at("airports", -1)["name"]).alias("endpoints"),
    )
