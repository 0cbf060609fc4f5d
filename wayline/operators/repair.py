"""Long-gap repair from a table of cached road geometry, and its checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline import fixed_values as V
from wayline.functions.geo import array_path_km, haversine_km, in_box, request_signature, token
from wayline.functions.numbers import finite
from wayline.operators.ordered import OrderedScan, block_chunk
from wayline.operators.paths import loop_metrics, number_pieces, path_scan, segments

# cache row: segment string, signature string, audit_version string, points array<struct<lng,lat>>


def _end(points: Column, i: int) -> Column:
    return F.element_at(points, i)


def _endpoint_error(start: Column, end: Column, points: Column) -> Column:
    def far(p: Column, q: Column) -> Column:
        return haversine_km(p["lng"], p["lat"], q["lng"], q["lat"])

    first, final = _end(points, 1), _end(points, -1)
    return F.least(far(start, first) + far(end, final), far(start, final) + far(end, first))


def key_points(segment: Column) -> Column:
    """The two end points spelled in a segment key, null where the key is malformed."""
    part = r"driving:(-?[0-9.]+),(-?[0-9.]+)\|(-?[0-9.]+),(-?[0-9.]+)"
    number = [F.regexp_extract(segment, part, i).try_cast("double") for i in (1, 2, 3, 4)]
    pair = F.array(
        F.struct(number[0].alias("lng"), number[1].alias("lat")), F.struct(number[2].alias("lng"), number[3].alias("lat"))
    )
    return F.when(number[0].isNotNull() & number[1].isNotNull() & number[2].isNotNull() & number[3].isNotNull(), pair)


def road_partitions(cache: DataFrame, points: int = 250_000) -> int:
    """Parts of the exchange of all points of ``cache`` with about as many ``points`` each: a point repeats its keys."""
    total = cache.agg(F.sum(F.greatest(F.size("points"), F.lit(0)))).first()[0] or 0
    return max(cache.sparkSession.sparkContext.defaultParallelism, -(-total // points))


def validate_roads(cache: DataFrame, signature_controls: str | None = None, partitions: int | None = None, keys: Sequence[str] = ("segment",)) -> DataFrame:
    """Add ``routed_km``, ``direct_km`` and ``errors`` to every cached segment.

    ``keys`` must be unique in ``cache``: roads between the same end points have one segment key, and their points would form one path.
    """
    pts, keys = F.col("points"), list(keys)
    long_form = cache.select(*keys, F.posexplode("points").alias("ix", "p")).select(
        *keys, "ix", F.col("p.lng").alias("lng"), F.col("p.lat").alias("lat")
    )
    loops = loop_metrics(path_scan(long_form, keys, partitions=partitions))
    rows = cache.join(loops, keys, "left")
    ends = key_points(F.col("segment"))
    tokens = F.transform(pts, lambda p: token(p["lng"], p["lat"]))
    repeats = F.exists(
        F.zip_with(F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))),
                   F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: a == b),
        lambda same: same,
    )
    rows = rows.withColumns({"_ends": ends}).withColumns(
        {
            "routed_km": array_path_km(pts),
            "direct_km": haversine_km(F.col("_ends")[0]["lng"], F.col("_ends")[0]["lat"],
                                      F.col("_ends")[1]["lng"], F.col("_ends")[1]["lat"]),
            "_repeats": repeats,
        }
    )
    routed, direct = F.col("routed_km"), F.col("direct_km")
    checks = [
        (F.col("_ends").isNull(), "malformed key"),
        (F.size(pts) < 2, "fewer than two coordinates"),
        ((F.size(pts) >= 2) & (_endpoint_error(F.col("_ends")[0], F.col("_ends")[1], pts) > V.ENDPOINT_TOLERANCE_KM),
         "endpoints do not match"),
        (routed < direct * 0.9, "shorter than the gap"),
        (routed > direct * V.MAX_DETOUR_RATIO + V.MAX_DETOUR_ALLOWANCE_KM, "detour"),
        (F.col("_repeats"), "consecutive duplicates"),
        (F.col("max_repeat_km") > F.greatest(F.lit(5.0), direct * 0.02), "retraces"),
        ((F.col("backtracking_km") > F.greatest(F.lit(5.0), direct * 0.08))
         & (F.col("max_drawdown_km") > F.greatest(F.lit(5.0), direct * 0.03)), "backtracking"),
        (F.col("audit_version").isNull() | (F.col("audit_version") != V.ROAD_AUDIT_VERSION), "audit version"),
    ]
    if signature_controls is not None:
        expected = request_signature(V.ROUTING_VERSION, F.lit(signature_controls), F.col("segment"))
        checks.append((F.col("signature").isNull() | (F.col("signature") != expected), "signature"))
    errors = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for bad, name in checks]))
    return rows.withColumn("errors", errors).drop("_ends", "_repeats")


def find_gaps(scan: OrderedScan, limit_km: float = V.MAX_CHORD_KM) -> DataFrame:
    return segments(scan).df.where(F.col("leg_km") > limit_km)


def repair_gaps(scan: OrderedScan, cache: DataFrame, limit_km: float = V.MAX_CHORD_KM) -> DataFrame:
    """Replace long legs by valid cached geometry; a leg with none cuts the path.

    ``cache`` holds valid rows only (``segment``, ``points``). Only the long legs meet the
    cache; all other rows pass through. Result: keys, ``piece``, ``ix``, ``sub``, lng, lat,
    ``repaired``. Pieces of one point vanish.
    """
    return repair_legs(segments(scan).settle(), cache, limit_km)


def repair_legs(scan: OrderedScan, cache: DataFrame, limit_km: float = V.MAX_CHORD_KM) -> DataFrame:
    """``repair_gaps`` over rows that carry their segments already."""
    keys, legs = scan.keys, scan.df
    gap = F.coalesce(F.col("leg_km") > limit_km, F.lit(False))
    plain = legs.where(~gap).select(
        *keys, "ix", F.lit(0).alias("sub"), "lng", "lat", F.lit(False).alias("repaired"), F.lit(False).alias("cut")
    )
    found = legs.where(gap).join(cache.select("segment", F.col("points").alias("road")), "segment", "left")
    start = F.struct(F.col("prev_lng").alias("lng"), F.col("prev_lat").alias("lat"))
    road = F.col("road")

    def from_start(i: int) -> Column:
        p = _end(road, i)
        return haversine_km(start["lng"], start["lat"], p["lng"], p["lat"])

    turned = F.when(from_start(1) > from_start(-1), F.reverse(road)).otherwise(road)
    inner = F.slice(turned, F.lit(2), F.greatest(F.size(turned) - 2, F.lit(0)))
    point = F.struct("lng", "lat")
    refill = F.when(road.isNull(), F.array(point)).otherwise(F.concat(inner, F.array(point)))
    patched = found.withColumn("cut", road.isNull()).select(
        *keys, "ix", F.posexplode(refill).alias("sub", "p"), F.col("cut")
    ).select(*keys, "ix", "sub", "p.lng", "p.lat", (~F.col("cut")).alias("repaired"), "cut")
    joined = OrderedScan(plain.unionByName(patched), keys, ["ix", "sub"], block_chunk("ix"))
    before = F.col("_prev_lng").isNotNull() & ~F.col("cut")
    after = F.coalesce(~F.col("_next_cut"), F.lit(False))
    rows = number_pieces(joined, {"_prev_lng": F.col("lng")}, {"_next_cut": F.col("cut")}, {}, before, after, "piece")
    return rows.select(*keys, "piece", "ix", "sub", "lng", "lat", "repaired")


def missing_gaps(gaps: DataFrame, cache: DataFrame) -> DataFrame:
    """Long legs that no valid cached segment covers."""
    return gaps.join(cache, "segment", "left_anti")


def stale_segments(cache: DataFrame, gaps: DataFrame) -> DataFrame:
    """Cached segments that no gap uses."""
    return cache.join(gaps.select("segment").distinct(), "segment", "left_anti")


def segment_controls(definitions: DataFrame, corridors: DataFrame) -> DataFrame:
    """Controls of every segment in request order: corridors as listed, then via points.

    ``definitions(segment, reversed, corridors array<string>, via array<struct<lng,lat,bearing,range>>)``,
    ``corridors(corridor, controls array<struct<lng,lat,bearing,range>>)``. A reversed request walks the
    list backwards with bearings turned by half a circle.
    """
    listed = definitions.select("segment", "reversed", F.posexplode("corridors").alias("at", "corridor")).join(
        corridors, "corridor"
    ).select("segment", "reversed", "at", F.posexplode("controls").alias("sub", "c"))
    via = definitions.select("segment", "reversed", F.lit(1_000_000).alias("at"), F.posexplode("via").alias("sub", "c"))
    rows = listed.unionByName(via).select("segment", "reversed", "at", "sub", "c.lng", "c.lat", "c.bearing", "c.range")
    flip = F.when(F.col("reversed"), F.lit(-1)).otherwise(F.lit(1))
    turned = F.when(F.col("reversed"), F.pmod(F.col("bearing") + 180.0, F.lit(360.0))).otherwise(F.col("bearing"))
    control = F.struct((F.col("at") * flip).alias("a"), (F.col("sub") * flip).alias("b"), "lng", "lat", turned.alias("bearing"), "range")
    return rows.groupBy("segment").agg(F.array_sort(F.collect_list(control)).alias("c")).select(
        "segment", F.transform("c", lambda c: F.struct(c["lng"], c["lat"], c["bearing"], c["range"])).alias("controls")
    )


def validate_controls(controls: DataFrame, box=V.BUILD_BOX) -> DataFrame:
    """Add ``errors`` to control rows ``(lng, lat, bearing, range)``."""
    lng, lat, bearing, width = (F.col(c) for c in ("lng", "lat", "bearing", "range"))
    point_ok = F.coalesce(in_box(finite(lng), finite(lat), box), F.lit(False))
    bearing_ok = bearing.isNull() | F.coalesce((finite(bearing) >= 0) & (finite(bearing) < 360), F.lit(False))
    width_ok = width.isNull() | F.coalesce(
        bearing.isNotNull() & (finite(width) > 0) & (finite(width) <= 180), F.lit(False)
    )
    return controls.withColumn(
        "errors",
        F.array_compact(F.array(F.when(~point_ok, "coordinate"), F.when(~bearing_ok, "bearing"), F.when(~width_ok, "range"))),
    )


def audit_steps(steps: DataFrame) -> DataFrame:
    """Restricted-road audit of route steps ``(segment, name, ref, rotary_name, distance_m, points)``."""
    road = F.concat_ws(" · ", *[F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit("")) for c in ("name", "ref", "rotary_name")])
    lngs, lats = F.transform("points", lambda p: p["lng"]), F.transform("points", lambda p: p["lat"])
    km = F.coalesce(F.col("distance_m"), F.lit(0.0)) / 1000.0
    south, west = F.array_min(lats), F.array_min(lngs)
    outside = (
        west.isNull() | (south < V.RESTRICTED_REF_SOUTH) | (west < V.RESTRICTED_REF_WEST) | (km > V.RESTRICTED_REF_KM)
    )
    return steps.withColumns({"road": road, "distance_km": km, "west": west, "south": south}).withColumn(
        "violation",
        F.when(F.rlike("road", F.lit(V.RESTRICTED_ROAD)), "restricted road")
        .when(F.rlike("road", F.lit(V.RESTRICTED_REF)) & outside, "restricted reference"),
    )


def audit_cache(
    cache: DataFrame, controls_sha256: str, partitions: int | None = None, keys: Sequence[str] = ("segment",), least_points: int = 4
) -> DataFrame:
    """Integrity of stored road rows, as ``(*keys, error)``; ``keys`` as in ``validate_roads``.

    ``cache`` adds ``start``, ``end`` (points), ``distance_km``, ``direct_stored_km``, ``roads array<string>`` and
    ``ref_segments array<struct<distance_km, bbox array<double>>>`` to the columns of ``validate_roads``.
    """
    rows = validate_roads(cache, partitions=partitions, keys=keys).drop("errors")
    pts, ends = F.col("points"), key_points(F.col("segment"))

    def same(p: Column, q: Column) -> Column:
        return F.coalesce(token(p["lng"], p["lat"]) == token(q["lng"], q["lat"]), F.lit(False))

    legs = F.zip_with(
        F.slice(pts, F.lit(1), F.greatest(F.size(pts) - 1, F.lit(0))), F.slice(pts, F.lit(2), F.greatest(F.size(pts) - 1, F.lit(0))),
        lambda a, b: F.struct(haversine_km(a["lng"], a["lat"], b["lng"], b["lat"]).alias("km"), (token(a["lng"], a["lat"]) == token(b["lng"], b["lat"])).alias("same")),
    )
    first, final = _end(pts, 1), _end(pts, -1)
    direct = haversine_km(first["lng"], first["lat"], final["lng"], final["lat"])
    shaped = rows.withColumns({"_e": ends, "_legs": legs}).withColumns(
        {"_ok": F.col("_e").isNotNull() & (F.size(pts) >= least_points) & ~F.exists(pts, lambda p: finite(p["lng"]).isNull() | finite(p["lat"]).isNull()), "_d": direct}
    )
    d, routed = F.col("_d"), F.col("routed_km")
    back, down = F.col("backtracking_km") > F.greatest(F.lit(5.0), d * 0.08), F.col("max_drawdown_km") > F.greatest(F.lit(5.0), d * 0.03)
    excess = routed - d > F.greatest(F.lit(20.0), d * 0.35)
    repeated = F.col("max_repeat_km") > F.greatest(F.lit(5.0), d * 0.02)

    def bad_ref(s: Column) -> Column:
        box = s["bbox"]
        inside = (box[1] >= V.RESTRICTED_REF_SOUTH) & (box[0] >= V.RESTRICTED_REF_WEST) & (s["distance_km"] <= V.RESTRICTED_REF_KM)
        return ~F.coalesce((F.size(box) == 4) & ~F.exists(box, lambda v: finite(v).isNull()) & inside, F.lit(False))

    ok = F.col("_ok")
    signature = request_signature(V.ROUTING_VERSION, F.lit(controls_sha256), F.col("segment"))
    audited = (F.col("audit_version") == V.ROAD_AUDIT_VERSION) & (F.size("roads") > 0)
    checks = [
        (F.col("_e").isNull(), "malformed key"),
        (F.col("_e").isNotNull() & ~ok, "malformed coordinates"),
        (ok & ~F.col("signature").eqNullSafe(signature), "stale signature"),
        (ok & ~F.coalesce(audited, F.lit(False)), "missing road audit"),
        (ok & audited & F.exists("roads", lambda r: F.rlike(r, F.lit(V.RESTRICTED_ROAD))), "restricted road"),
        (ok & F.exists("ref_segments", bad_ref), "restricted reference"),
        (ok & ~(same(F.col("start"), first) & same(F.col("end"), final)), "from or to differs"),
        (ok & ~(same(F.col("_e")[0], first) & same(F.col("_e")[1], final)), "key differs"),
        (ok & ((F.abs(F.col("direct_stored_km") - d) > 0.05) | (F.abs(F.col("distance_km") - routed) > 0.1)), "stale distances"),
        (ok & F.exists("_legs", lambda leg: leg["same"]), "consecutive duplicates"),
        (ok & F.exists("_legs", lambda leg: leg["km"] > V.MAX_CHORD_CHECK_KM), "long chord"),
        (ok & (routed > d * V.MAX_DETOUR_RATIO + V.MAX_DETOUR_ALLOWANCE_KM), "detour"),
        (ok & (repeated | (back & down) | (excess & (back | down))), "loop or backtracking"),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for bad, name in checks]))
    return shaped.select(*keys, F.explode(found).alias("error"))
