"""JSON messages in a text column or in landing files, typed and split into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline import schemas as S
from wayline.functions.numbers import finite, number_of, safe_number

CORRUPT = "_corrupt"
QUOTED_NUMBER = r'"(?:latitude|longitude|bearing|speed|timestamp)"\s*:\s*"'  # a number of a vehicle message given as text


def read_messages(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """One message per row in ``payload`` with its file name; whole JSON documents, one per line or one per file."""
    reader = spark.readStream if stream else spark.read
    return reader.schema("value string").text(path).select(F.col("value").alias("payload"), F.col("_metadata.file_name").alias("file"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("payload"), F.col("_metadata.file_name").alias("file"))


def once(rows: DataFrame, *columns: Column) -> DataFrame:
    """Adds columns that are computed once per row, however often later steps refer to them.

    The optimizer merges projections and so copies an expression into every place that uses it; it does not copy through a Generate.
    """
    return rows.select("*", F.inline(F.array(F.struct(*columns))))


def parse(messages: DataFrame, schema: str, payload: str = "payload") -> DataFrame:
    """Typed column ``m``; text that does not parse has ``m`` null and stays in ``_corrupt``."""
    typed = F.from_json(payload, f"{schema}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    rows = once(messages, typed.alias("m")).withColumn(CORRUPT, F.coalesce(F.col(f"m.{CORRUPT}"), F.when(F.col("m").isNull(), F.col(payload))))
    return rows.withColumn("m", F.when(F.col(CORRUPT).isNull(), F.col("m")))


def good(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def dead_letters(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col(CORRUPT).isNotNull()).drop("m", CORRUPT)


def vehicle_entities(messages: DataFrame) -> DataFrame:
    """Vehicle entities of position messages; ``messages`` carries ``feed`` and ``agency``.

    A message is read with numbers as numbers; only where that fails is it read again with its leaves as text, so that one bad value makes
    one field null and not the message. A failed reading costs several good ones, so messages with a number in quotes are read as text at once.
    """
    def read(schema: str) -> Column:
        return F.from_json("payload", f"{schema}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})

    axes = ("latitude", "longitude", "bearing", "speed")

    def entity(e: Column, number, stamp) -> Column:
        v = e["vehicle"]
        position = F.when(v["position"].isNotNull(), F.struct(*[number(v["position"][c]).alias(c) for c in axes]))
        vehicle = F.struct(stamp(v["timestamp"]).alias("timestamp"), position.alias("position"), v["trip"].alias("trip"), v["vehicle"].alias("vehicle"))
        return F.struct(e["id"].alias("id"), F.when(v.isNotNull(), vehicle).alias("vehicle"))

    def typed(entities: Column) -> Column:  # in two steps, since a function of elements computes a text's number anew for every use of it
        numbers = F.transform(entities, lambda e: entity(e, number_of, number_of))
        return F.transform(numbers, lambda e: entity(e, finite, lambda x: finite(x).cast("bigint")))

    quoted = F.coalesce(F.rlike("payload", F.lit(QUOTED_NUMBER)), F.lit(False))
    rows = once(messages.select("feed", "agency", "payload"), F.when(~quoted, read(S.VEHICLE_NUMBERS)).alias("n"))
    clean = F.col("n").isNotNull() & F.col(f"n.{CORRUPT}").isNull()
    rows = once(rows, F.when(~clean, read(S.VEHICLE_MESSAGE)).alias("t"))
    whole = F.when(F.col(f"t.{CORRUPT}").isNull(), F.col("t.entity"))
    entities = F.when(clean, F.col("n.entity")).otherwise(typed(whole))
    stamp = F.when(clean, F.col("n.header.timestamp")).otherwise(safe_number(F.col("t.header.timestamp")).cast("bigint"))
    return _vehicles(rows.select("feed", "agency", stamp.alias("header_timestamp"), F.explode(entities).alias("e")))


def _vehicles(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("e.vehicle").isNotNull()).select("feed", "agency", "header_timestamp", "e.id", "e.vehicle")


def binary_vehicle_entities(decoded: DataFrame) -> DataFrame:
    """The rows of ``vehicle_entities`` from ``realtime.decoded`` messages of vehicles."""
    return _vehicles(good(decoded).select("feed", "agency", F.col("m.header.timestamp").alias("header_timestamp"), F.explode("m.entity").alias("e")))


def trip_updates(messages: DataFrame, parsed: bool = False) -> DataFrame:
    """Trip updates with their stop lists; ``header_timestamp`` is the feed clock. ``parsed`` messages have ``m`` already."""
    rows = good(messages if parsed else parse(messages, S.TRIP_MESSAGE)).select(F.col("m.header.timestamp").alias("header_timestamp"), F.explode("m.entity").alias("e"))
    updates = F.transform(
        F.coalesce("e.tripUpdate.stopTimeUpdate", F.array().cast("array<struct<stopId:string,arrival:struct<time:bigint>,departure:struct<time:bigint>>>")),
        lambda u: F.struct(u["stopId"].alias("stop"), u["arrival"]["time"].alias("arrival"), u["departure"]["time"].alias("departure")),
    )
    return rows.where(F.col("e.tripUpdate").isNotNull()).select(
        "header_timestamp", F.col("e.id").alias("trip"), F.coalesce("e.tripUpdate.trip.routeId", F.lit("")).alias("route"), updates.alias("updates")
    )


def service_alerts(messages: DataFrame, parsed: bool = False) -> DataFrame:
    rows = good(messages if parsed else parse(messages, S.ALERT_MESSAGE)).select(F.col("m.header.timestamp").alias("header_timestamp"), F.explode("m.entity").alias("e"))
    a = F.col("e.alert")
    return rows.where(a.isNotNull()).select(
        "header_timestamp", F.col("e.id").alias("id"), a["activePeriod"].alias("periods"),
        F.transform(F.coalesce(a["informedEntity"], F.array().cast("array<struct<routeId:string,stopId:string>>")),
                    lambda i: F.struct(i["routeId"].alias("route"), i["stopId"].alias("stop"))).alias("entities"),
        a["headerText"]["translation"].alias("header"), a["descriptionText"]["translation"].alias("description"),
    )


def aircraft_rows(messages: DataFrame, *keep: str) -> DataFrame:
    """Aircraft of probe snapshots with their position in the list."""
    rows = good(parse(messages, S.AIRCRAFT_MESSAGE)).select(*keep, F.posexplode("m.ac").alias("pos", "a"))
    return rows.select(*keep, "pos", "a.hex", "a.flight", F.col("a.t").alias("kind"), "a.lat", "a.lon", "a.track", "a.gs", "a.seen", "a.alt_baro")


def vessel_rows(messages: DataFrame, *keep: str) -> DataFrame:
    """Position and static messages of vessels; the body sits under its message type."""
    from wayline.operators.normalise import true_heading

    rows = good(parse(messages, S.VESSEL_MESSAGE))
    rows = once(rows.select(*keep, "m"), F.try_element_at("m.Message", F.col("m.MessageType")).alias("b"), (F.col("m.MessageType") == "ShipStaticData").alias("is_static"))
    meta = F.col("m.MetaData")
    rows = once(
        rows.where(F.col("b").isNotNull()), meta["MMSI"].alias("mmsi"), meta["longitude"].alias("lng"), meta["latitude"].alias("lat"),
        F.trim(F.when(F.col("is_static"), F.coalesce("b.Name", meta["ShipName"])).otherwise(F.coalesce(meta["ShipName"], F.lit("")))).alias("name"),
        F.col("b.Sog").alias("sog"), true_heading(F.col("b.TrueHeading"), F.col("b.Cog")).alias("heading"),
        F.when(F.col("is_static"), F.coalesce("b.Type", "b.TypeAndCargo", "b.ShipType")).otherwise(meta["ShipType"]).alias("ship_type"),
    )
    return rows.select(*keep, "mmsi", "is_static", "lng", "lat", "name", "sog", "heading", "ship_type").where(F.col("is_static") | (F.col("lng").isNotNull() & F.col("lat").isNotNull()))


def trains_by_number(messages: DataFrame) -> DataFrame:
    """Trains of an object that maps a number to a list of trains."""
    element = S.TRAIN.replace(" string", ":string").replace("stations array", "stations:array")
    typed = F.from_json("payload", f"map<string,array<struct<{element}>>>")
    rows = messages.select(F.explode(typed).alias("number", "trains"))
    return rows.select(F.inline("trains"))


def work_zone_rows(messages: DataFrame) -> DataFrame:
    """Zones of WZDx files; ``messages`` carries ``provider`` and ``source_url``."""
    rows = good(parse(messages, S.WORK_ZONE_FILE))
    updated = F.coalesce("m.road_event_feed_info.update_date", "m.feed_info.update_date")
    return rows.select("provider", "source_url", updated.alias("feed_updated"), F.inline("m.features"))


def icon_rows(messages: DataFrame) -> DataFrame:
    return good(parse(messages, S.ICONS)).select("source", F.inline("m.item2"))


def camera_rows(messages: DataFrame) -> DataFrame:
    return good(parse(messages, S.CAMERA_FILE)).select(F.inline("m.features"))


def share_rows(messages: DataFrame, feed: str) -> DataFrame:
    """Items of a share feed; the payload sits at ``data.en`` or at ``data``. ``messages`` carries ``system``."""
    field = {"feeds": "feeds", "station_information": "stations", "station_status": "stations", "vehicle_types": "vehicle_types",
             "free_bike_status": "bikes", "vehicle_status": "vehicles"}[feed]
    rows = good(parse(messages, S.SHARE[feed]))
    items = F.coalesce(F.col(f"m.data.en.{field}"), F.col(f"m.data.{field}"))
    return rows.select("system", F.col("m.last_updated").alias("last_updated"), F.inline(items))


def api_vehicles(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vehicles and the included stop names of JSON:API pages."""
    from wayline.operators.normalise import occupancy_band

    rows = good(parse(messages, S.API_VEHICLES))
    v = rows.select(F.explode("m.data").alias("d"))
    a = F.col("d.attributes")
    shares = F.transform(F.coalesce(a["carriages"], F.array().cast("array<struct<occupancy_percentage:double>>")), lambda c: c["occupancy_percentage"])
    vehicles = v.select(
        "d.id", F.col("d.relationships.route.data.id").alias("route"), F.col("d.relationships.stop.data.id").alias("stop"),
        a["longitude"].alias("lng"), a["latitude"].alias("lat"), a["bearing"].alias("bearing"), a["current_status"].alias("status"),
        a["direction_id"].alias("direction_id"), a["label"].alias("label"), occupancy_band(shares).alias("occupancy"), a["revenue"].alias("revenue"),
        F.try_to_timestamp(a["updated_at"]).alias("updated_at"),
    )
    stops = rows.select(F.explode("m.included").alias("i")).where(F.col("i.type") == "stop").select(
        F.col("i.id").alias("stop"), F.col("i.attributes.name").alias("stop_name")
    ).groupBy("stop").agg(F.max("stop_name").alias("stop_name"))
    return vehicles, stops


def api_routes(messages: DataFrame) -> DataFrame:
    a = F.col("d.attributes")
    return good(parse(messages, S.API_ROUTES)).select(F.explode("m.data").alias("d")).select(
        F.col("d.id").alias("route"), a["type"].alias("kind"), F.concat(F.lit("#"), a["color"]).alias("color"),
        F.concat(F.lit("#"), a["text_color"]).alias("text_color"), a["long_name"].alias("long_name"), a["short_name"].alias("short_name"),
        a["direction_destinations"].alias("destinations"),
    )


def api_alerts(messages: DataFrame) -> DataFrame:
    from wayline.operators.alerts import distinct_ids

    a = F.col("d.attributes")
    return good(parse(messages, S.API_ALERTS)).select(F.explode("m.data").alias("d")).select(
        "d.id", a["effect"].alias("effect"), a["severity"].alias("severity"), a["header"].alias("header"),
        distinct_ids(a["informed_entity"], "route").alias("routes"), distinct_ids(a["informed_entity"], "stop").alias("stops"),
    )


def api_stops(messages: DataFrame) -> DataFrame:
    a = F.col("d.attributes")
    return good(parse(messages, S.API_STOPS)).select(F.explode("m.data").alias("d")).select(
        F.col("d.id").alias("stop"), a["longitude"].alias("lng"), a["latitude"].alias("lat")
    ).where(F.col("lng").isNotNull())


def keyed_map(messages: DataFrame, value_type: str, key: str, field: str | None = None) -> DataFrame:
    """Rows of a JSON object that maps a key to a struct, optionally nested under ``field``."""
    if field is None:
        typed: Column = F.from_json("payload", f"map<string,{value_type}>")
    else:
        typed = F.from_json("payload", f"{field} map<string,{value_type}>")[field]
    return messages.select(F.explode(typed).alias(key, "value"))
