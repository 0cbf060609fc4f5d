"""Trip progress, position estimates and GTFS trip joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline import fixed_values as V
from wayline.functions.geo import interpolate, planar_bearing
from wayline.functions.numbers import round_half_up
from wayline.operators.ordered import OrderedScan, block_chunk, first_wins, last_wins


def stop_scan(stop_times: DataFrame, trip: str = "trip", seq: str = "seq") -> OrderedScan:
    return OrderedScan(stop_times, [trip], [seq], block_chunk(seq, 1024))


def trip_progress(scan: OrderedScan, now: Column) -> DataFrame:
    """Previous and next stop per trip at ``now`` (epoch seconds in ``time``).

    The next stop is the first in stop order whose time lies after ``now``; the one before it
    is the previous stop. Trips not yet started, already ended or with one timed stop drop out.
    """
    (trip,) = scan.keys
    seq = F.struct(*scan.order)
    rows = scan.extend(lag={"prev_stop": F.col("stop"), "prev_time": F.col("time")}).df
    ahead = F.col("time") > now
    found = rows.groupBy(trip).agg(
        F.count(F.lit(1)).alias("stops"),
        F.min_by(F.struct("prev_stop", "prev_time", F.col("stop").alias("next_stop"), F.col("time").alias("next_time")),
                 F.when(ahead, seq)).alias("n"),
        F.max_by("stop", seq).alias("dest_stop"),
    )
    span = F.greatest(F.lit(1.0), (F.col("next_time") - F.col("prev_time")).cast("double"))
    done = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (now - F.col("prev_time")).cast("double") / span))
    return (
        found.where((F.col("stops") >= 2) & F.col("n").isNotNull() & F.col("n.prev_time").isNotNull())
        .select(trip, "stops", "n.*", "dest_stop").withColumn("progress", done)
    )


def timed_stops(updates: DataFrame) -> DataFrame:
    """Long stop rows of trip updates ``(trip, route, updates array<struct<stop,arrival,departure>>)``."""
    rows = updates.select("trip", "route", F.posexplode("updates").alias("seq", "u"))
    time = F.coalesce(F.col("u.departure"), F.col("u.arrival"))
    return rows.select("trip", "route", "seq", F.col("u.stop").alias("stop"), time.alias("time")).where(
        F.col("time").isNotNull() & (F.col("stop") != "")
    )


def estimate_positions(progress: DataFrame, stations: DataFrame, now: Column) -> DataFrame:
    """Interpolated positions between known stations; the destination name is optional."""
    def side(name: str) -> DataFrame:
        return stations.select(
            F.col("stop").alias(f"{name}_stop"), F.col("name").alias(f"{name}_name"),
            F.col("lng").alias(f"{name}_lng"), F.col("lat").alias(f"{name}_lat"),
        )

    joined = (
        progress.join(side("prev"), "prev_stop").join(side("next"), "next_stop")
        .join(side("dest").drop("dest_lng", "dest_lat"), "dest_stop", "left")
    )
    minutes = F.greatest(F.lit(0).cast("bigint"), round_half_up((F.col("next_time") - now) / F.lit(60.0)))
    return joined.select(
        "*",
        interpolate(F.col("prev_lng"), F.col("next_lng"), F.col("progress")).alias("lng"),
        interpolate(F.col("prev_lat"), F.col("next_lat"), F.col("progress")).alias("lat"),
        planar_bearing(F.col("prev_lng"), F.col("prev_lat"), F.col("next_lng"), F.col("next_lat")).alias("bearing"),
        F.concat(
            F.col("prev_name"), F.lit(" → "), F.col("next_name"), F.lit(" · "),
            F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit(" min"))).otherwise("due"),
        ).alias("status"),
    )


def select_routes(routes: DataFrame, feeds: DataFrame) -> DataFrame:
    """Routes of kept types whose name matches the feed's pattern.

    ``feeds`` carries ``feed, route_type_override, route_name_pattern, route_name_field``.
    """
    from wayline.functions.text import route_label

    # the last row of a route id counts
    latest = last_wins(routes, ["feed", "route_id"], ["row_ix"]) if "row_ix" in routes.columns else routes
    joined = latest.join(feeds, "feed")
    kind = F.coalesce(F.col("route_type_override"), F.trim("route_type").try_cast("int"))
    label = route_label(F.col("route_short_name"), F.col("route_long_name"), F.col("route_id"))
    field = F.col("route_name_field")
    value = (
        F.when(field == "route_long_name", F.col("route_long_name"))
        .when(field == "route_short_name", F.col("route_short_name"))
        .when(field == "route_id", F.col("route_id")).when(field.isNull(), label)
    )
    pattern = F.col("route_name_pattern")
    matches = pattern.isNull() | F.rlike(F.coalesce(value, F.lit("")), F.concat(F.lit("(?i)"), pattern))
    return joined.withColumns({"kind": kind, "label": label}).where(
        F.col("kind").isin(*V.GROUP_BY_ROUTE_TYPE) & F.coalesce(matches, F.lit(False))
    )


def route_shapes(trips: DataFrame, routes: DataFrame) -> DataFrame:
    """First route of every shape among the selected routes, in file order."""
    kept = trips.join(routes.select("feed", "route_id").distinct(), ["feed", "route_id"], "left_semi")
    shaped = kept.where(F.trim(F.coalesce("shape_id", F.lit(""))) != "").select(
        "feed", F.trim("shape_id").alias("shape_id"), "row_ix", "route_id"
    )
    return first_wins(shaped, ["feed", "shape_id"], ["row_ix"]).drop("row_ix")


def fallback_trips(trips: DataFrame, routes: DataFrame) -> DataFrame:
    """First shapeless trip per route and direction; feeds marked shape-only have none."""
    kept = trips.join(routes.select("feed", "route_id", "shape_only").distinct(), ["feed", "route_id"])
    bare = kept.where(
        (F.trim(F.coalesce("shape_id", F.lit(""))) == "") & ~F.coalesce(F.col("shape_only"), F.lit(False))
    ).select("feed", "route_id", F.coalesce("direction_id", F.lit("")).alias("direction_id"), "row_ix", "trip_id")
    return first_wins(bare, ["feed", "route_id", "direction_id"], ["row_ix"]).drop("row_ix").where(
        F.coalesce("trip_id", F.lit("")) != ""
    )


def shape_points(shapes: DataFrame, used: DataFrame) -> DataFrame:
    """Parsed points of the used shapes; malformed rows are skipped."""
    rows = shapes.join(used, ["feed", "shape_id"]).select(
        "feed", "route_id", F.concat(F.lit("shape:"), F.col("shape_id")).alias("path"),
        F.coalesce(F.nullif(F.trim("shape_pt_sequence"), F.lit("")), F.lit("0")).try_cast("bigint").alias("seq"),
        F.col("shape_pt_lon").try_cast("double").alias("lng"), F.col("shape_pt_lat").try_cast("double").alias("lat"),
    )
    return rows.where(F.col("seq").isNotNull() & F.col("lng").isNotNull() & F.col("lat").isNotNull())


def stop_places(stops: DataFrame) -> DataFrame:
    """Stops with a usable position, one row per stop id: the last one of the file, as long as it has a position."""
    placed = stops.withColumns({"lng": F.col("stop_lon").try_cast("double"), "lat": F.col("stop_lat").try_cast("double")}).where(
        F.col("lng").isNotNull() & F.col("lat").isNotNull()
    )
    return last_wins(placed, ["feed", "stop_id"], ["row_ix"]) if "row_ix" in stops.columns else placed


def fallback_points(stop_times: DataFrame, stops: DataFrame, trips: DataFrame) -> DataFrame:
    """Stop positions of the fallback trips; a call without a usable sequence takes its place in the trip's list."""
    calls = stop_times.join(trips, ["feed", "trip_id"])
    place = F.lit(0).cast("bigint")
    if "row_ix" in stop_times.columns:
        place = F.row_number().over(Window.partitionBy("feed", "trip_id").orderBy("row_ix")).cast("bigint") - 1  # the calls of one trip
        calls = stop_times.join(trips.drop("row_ix"), ["feed", "trip_id"])
    return (
        calls.withColumn("seq", F.coalesce(F.col("stop_sequence").try_cast("bigint"), place))
        .join(stop_places(stops).select("feed", "stop_id", "lng", "lat"), ["feed", "stop_id"])
        .select("feed", "route_id", F.concat(F.lit("trip:"), F.col("trip_id")).alias("path"), "seq", "lng", "lat")
    )


def routes_by_stop(stop_times: DataFrame, trips: DataFrame) -> DataFrame:
    """Distinct routes that call at every stop."""
    pairs = stop_times.select("feed", "trip_id", "stop_id").distinct().join(
        trips.select("feed", "trip_id", "route_id"), ["feed", "trip_id"]
    )
    return pairs.select("feed", "stop_id", "route_id").distinct()
