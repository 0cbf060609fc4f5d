"""Polyline operators over the long form ``(path, ix, lng, lat)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline import fixed_values as V
from wayline.functions.geo import axis_progress, haversine_km, in_box, token, undirected_key
from wayline.operators.ordered import OrderedScan, block_chunk

POINT = ("lng", "lat")


def path_scan(
    points: DataFrame, keys: Sequence[str] = ("path",), order: Sequence[str] = ("ix",), chunk: Column | None = None, partitions: int | None = None
) -> OrderedScan:
    return OrderedScan(points, keys, order, block_chunk(order[0]) if chunk is None else chunk, partitions=partitions)


def _leg_km() -> Column:
    return haversine_km(F.col("prev_lng"), F.col("prev_lat"), F.col("lng"), F.col("lat"))


def _previous() -> dict[str, Column]:
    return {"prev_lng": F.col("lng"), "prev_lat": F.col("lat")}


def with_legs(scan: OrderedScan) -> OrderedScan:
    """Distance from the previous point of the path (null on the first)."""
    return scan.extend(lag=_previous(), derived={"leg_km": _leg_km()})


def with_cumulative(scan: OrderedScan) -> OrderedScan:
    return scan.extend(lag=_previous(), derived={"leg_km": _leg_km()}, running_sum={"cum_km": F.col("leg_km")})


def path_lengths(scan: OrderedScan) -> DataFrame:
    return with_legs(scan).df.groupBy(*scan.keys).agg(
        F.count(F.lit(1)).alias("points"), F.coalesce(F.sum("leg_km"), F.lit(0.0)).alias("length_km")
    )


def long_legs(scan: OrderedScan, limit_km: float = V.MAX_CHORD_CHECK_KM) -> DataFrame:
    return with_legs(scan).df.where(F.col("leg_km") > limit_km)


def dedupe_consecutive(scan: OrderedScan) -> DataFrame:
    """Drop a point whose five-decimal position repeats the one before it."""
    here = token(F.col("lng"), F.col("lat"))
    rows = scan.extend(lag={"prev_token": here}).df
    return rows.where(F.col("prev_token").isNull() | (F.col("prev_token") != here)).drop("prev_token")


def number_pieces(
    scan: OrderedScan, lag: dict[str, Column], lead: dict[str, Column], derived: dict[str, Column], before: Column, after: Column, name: str
) -> DataFrame:
    """Number the pieces of at least two points from 1; a point joined to no neighbour is in none.

    ``before`` and ``after`` say whether a point is joined to the one before and after it.
    """
    opens = F.when(~before & after, F.lit(1)).otherwise(F.lit(0))
    return scan.extend(lag=lag, lead=lead, derived={**derived, "_kept": before | after, "_opens": opens}, running_sum={name: F.col("_opens")}).df.where(
        "_kept"
    ).drop("_kept", "_opens", *lag, *lead)


def runs_in_box(scan: OrderedScan, box=V.BUILD_BOX) -> DataFrame:
    """Maximal runs of at least two consecutive points inside the box, numbered from 1 per path."""
    inside = in_box(F.col("lng"), F.col("lat"), box)
    before = inside & F.coalesce(F.col("_prev_in"), F.lit(False))
    after = inside & F.coalesce(F.col("_next_in"), F.lit(False))
    return number_pieces(scan, {"_prev_in": inside}, {"_next_in": inside}, {}, before, after, "run")


def split_at_gaps(scan: OrderedScan, limit_km: float = V.MAX_CHORD_KM) -> DataFrame:
    """Cut a path at every leg above the limit; pieces of one point vanish."""
    next_km = haversine_km(F.col("lng"), F.col("lat"), F.col("_next_lng"), F.col("_next_lat"))
    before = F.coalesce(_leg_km() <= limit_km, F.lit(False))
    after = F.coalesce(next_km <= limit_km, F.lit(False))
    return number_pieces(scan, _previous(), {"_next_lng": F.col("lng"), "_next_lat": F.col("lat")}, {}, before, after, "piece")


def with_progress(scan: OrderedScan) -> OrderedScan:
    """Progress along the end-to-end axis, its running maximum and the drawdown from it."""
    ends = scan.extend(
        first={"lng0": F.col("lng"), "lat0": F.col("lat")}, last={"lng1": F.col("lng"), "lat1": F.col("lat")}
    )
    progress = axis_progress(*[F.col(c) for c in ("lng", "lat", "lng0", "lat0", "lng1", "lat1")])
    peaked = ends.with_columns({"progress_km": progress}).extend(running_max={"peak_km": F.col("progress_km")})
    return peaked.with_columns({"drawdown_km": F.col("peak_km") - F.col("progress_km")})


def loop_metrics(scan: OrderedScan) -> DataFrame:
    """Backtracking sum, largest drawdown and largest repeat separation per path.

    Along a path the length never falls, so the widest separation of a repeated position is
    between its first and last visit; that leaves one combinable aggregate per position.
    """
    keys = scan.keys
    ends = scan.extend(
        first={"lng0": F.col("lng"), "lat0": F.col("lat")}, last={"lng1": F.col("lng"), "lat1": F.col("lat")}
    )
    axis = [F.col(c) for c in ("lng0", "lat0", "lng1", "lat1")]
    measured = ends.extend(
        lag=_previous(), position="_pos",
        derived={
            "leg_km": _leg_km(),
            "progress_km": axis_progress(F.col("lng"), F.col("lat"), *axis),
            "_prev_km": axis_progress(F.col("prev_lng"), F.col("prev_lat"), *axis),
        },
        running_sum={"cum_km": F.col("leg_km")}, running_max={"peak_km": F.col("progress_km")},
    )
    visits = measured.df.groupBy(*keys, token(F.col("lng"), F.col("lat")).alias("token")).agg(
        F.min("_pos").alias("first_pos"), F.max("_pos").alias("last_pos"),
        F.min("cum_km").alias("first_km"), F.max("cum_km").alias("last_km"),
        F.sum(F.greatest(F.lit(0.0), F.col("_prev_km") - F.col("progress_km"))).alias("back_km"),
        F.max(F.col("peak_km") - F.col("progress_km")).alias("down_km"),
    )
    repeat = F.when(F.col("last_pos") - F.col("first_pos") > 2, F.col("last_km") - F.col("first_km"))
    return visits.groupBy(*keys).agg(
        F.coalesce(F.sum("back_km"), F.lit(0.0)).alias("backtracking_km"),
        F.max("down_km").alias("max_drawdown_km"),
        F.coalesce(F.max(repeat), F.lit(0.0)).alias("max_repeat_km"),
    )


def bounding_boxes(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    return points.groupBy(*keys).agg(
        F.min("lng").alias("west"), F.min("lat").alias("south"), F.max("lng").alias("east"), F.max("lat").alias("north")
    )


def segments(scan: OrderedScan) -> OrderedScan:
    """Consecutive point pairs with the undirected key of their tokens."""
    legs = with_legs(scan)
    a, b = token(F.col("prev_lng"), F.col("prev_lat")), token(F.col("lng"), F.col("lat"))
    return legs.with_columns({"from_token": a, "to_token": b, "segment": undirected_key(a, b)})


def ordered_points(points: DataFrame, keys: Sequence[str], seq: str = "ix", block: int = 10_000) -> DataFrame:
    """Point lists in (seq, lng, lat) order, one row per ``block`` of the sequence; parts concatenate in part order."""
    parts = points.withColumn("part", F.floor(F.col(seq) / F.lit(block)).cast("bigint"))
    listed = parts.groupBy(*keys, "part").agg(
        F.array_sort(F.collect_list(F.struct(F.col(seq).alias("seq"), *POINT))).alias("_pts")
    )
    return listed.select(*keys, "part", F.transform("_pts", lambda p: F.struct(p["lng"], p["lat"])).alias("points"))


def distinct_paths(points: DataFrame, route: str | Sequence[str], path: str, ix: str = "ix") -> DataFrame:
    """One path id per route and point sequence, the lowest; signatures fold before the shuffle."""
    keys = [route] if isinstance(route, str) else list(route)
    signed = points.groupBy(*keys, path).agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64(ix, "lng", "lat")).alias("sig_a"),
        F.bit_xor(F.xxhash64(F.lit("second"), "lat", ix, "lng")).alias("sig_b"),
    )
    return signed.groupBy(*keys, "n", "sig_a", "sig_b").agg(F.min(path).alias(path)).select(*keys, path, "n")
