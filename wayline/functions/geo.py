"""Planar and spherical expressions over lng/lat columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayline import fixed_values as V


def haversine_km(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    dlat = F.radians(lat2 - lat1)
    dlng = F.radians(lng2 - lng1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlng / 2), 2)
    return F.lit(2 * V.EARTH_RADIUS_KM) * F.asin(F.sqrt(F.when(h > 1, F.lit(1.0)).otherwise(h)))


def planar_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt(F.pow(x2 - x1, 2) + F.pow(y2 - y1, 2))


def segment_distance(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance in degrees from a point to the closest point of a segment."""
    dx, dy = bx - ax, by - ay
    length2 = dx * dx + dy * dy
    t = F.when(length2 == 0, F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - ax) * dx + (y - ay) * dy) / length2))
    )
    return planar_distance(x, y, ax + t * dx, ay + t * dy)


def planar_bearing(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(lng2 - lng1, lat2 - lat1)) + F.lit(360.0), F.lit(360.0))


def interpolate(a: Column, b: Column, fraction: Column) -> Column:
    return a + (b - a) * fraction


def axis_progress(lng: Column, lat: Column, lng0: Column, lat0: Column, lng1: Column, lat1: Column) -> Column:
    """Kilometres travelled along the straight axis from the first to the last point."""
    kx = F.lit(V.KM_PER_DEG_LNG) * F.cos(F.radians((lat0 + lat1) / 2))
    ky = F.lit(V.KM_PER_DEG_LAT)
    ex, ey = (lng1 - lng0) * kx, (lat1 - lat0) * ky
    norm = F.sqrt(ex * ex + ey * ey)
    norm = F.when(norm == 0, F.lit(1.0)).otherwise(norm)
    return ((lng - lng0) * kx * ex + (lat - lat0) * ky * ey) / norm


def token(lng: Column, lat: Column) -> Column:
    return F.format_string("%.5f,%.5f", lng, lat)


def undirected_key(from_token: Column, to_token: Column, mode: str = "driving") -> Column:
    return F.concat(F.lit(f"{mode}:"), F.least(from_token, to_token), F.lit("|"), F.greatest(from_token, to_token))


def in_box(lng: Column, lat: Column, box: tuple[float, float, float, float], inclusive: bool = True) -> Column:
    """``box`` is west, south, east, north."""
    west, south, east, north = box
    if inclusive:
        return lng.between(west, east) & lat.between(south, north)
    return (lng > west) & (lng < east) & (lat > south) & (lat < north)


def path_text(points: Column) -> Column:
    """Canonical text of one path (``array<struct<lng,lat>>``)."""
    parts = F.transform(points, lambda p: F.format_string("%.6f,%.6f", p["lng"], p["lat"]))
    return F.concat(F.lit("["), F.array_join(parts, "|"), F.lit("]"))


def multi_path_text(paths: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(paths, path_text), "|"), F.lit("]"))


def geometry_sha256(points: Column, nested: bool = False) -> Column:
    return F.sha2(multi_path_text(points) if nested else path_text(points), 256)


def text_sha256(text: Column) -> Column:
    """Hash of a text after line ends are normalised."""
    return F.sha2(F.replace(text, F.lit("\r\n"), F.lit("\n")), 256)


def request_signature(version: str, controls_sha256: Column, key: Column) -> Column:
    return F.concat_ws("|", F.lit(version), controls_sha256, key)


def array_path_km(points: Column) -> Column:
    """Length of a path held in one row."""
    legs = F.zip_with(
        F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))),
        F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))),
        lambda a, b: haversine_km(a["lng"], a["lat"], b["lng"], b["lat"]),
    )
    return F.aggregate(legs, F.lit(0.0), lambda acc, leg: acc + leg)
