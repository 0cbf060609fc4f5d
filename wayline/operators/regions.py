"""Region assignment: polygons, boxes, probe circles."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline import fixed_values as V
from wayline.functions.geo import haversine_km, segment_distance
from wayline.session import row_bound

EDGE_SCHEMA = "region string, poly int, ring int, x1 double, y1 double, x2 double, y2 double"
BAND_DEG = 0.02
CELL_DEG = 0.5
MAX_BROADCAST_ROWS = 1_000_000  # of a table after it was spread over bands or cells
SALTS = 16
_bound: ContextVar[int] = ContextVar("broadcast_bound", default=MAX_BROADCAST_ROWS)


def edges_from_rings(spark: SparkSession, rings: Sequence[tuple[str, int, int, Sequence[tuple[float, float]]]]) -> DataFrame:
    """Edge table of rings written as literals: (region, poly, ring, points)."""
    rows = []
    for region, poly, ring, pts in rings:
        for i, (x2, y2) in enumerate(pts):
            x1, y1 = pts[i - 1]
            rows.append((region, poly, ring, float(x1), float(y1), float(x2), float(y2)))
    return spark.createDataFrame(rows, EDGE_SCHEMA)


def box_rings(boxes: dict[str, tuple[float, float, float, float]]) -> list[tuple[str, int, int, list[tuple[float, float]]]]:
    return [
        (key, 0, 0, [(west, south), (east, south), (east, north), (west, north)])
        for key, (south, west, north, east) in boxes.items()
    ]


def edges_from_features(features: DataFrame) -> DataFrame:
    """Edge table from ``(region, polygons array<array<array<struct<lng,lat>>>>)``; rings close by wrap-around."""
    rings = features.select("region", F.posexplode("polygons").alias("poly", "rings")).select(
        "region", "poly", F.posexplode("rings").alias("ring", "pts")
    )
    shifted = F.concat(F.slice("pts", -1, 1), F.slice(F.col("pts"), F.lit(1), F.greatest(F.size("pts") - 1, F.lit(0))))
    edge = F.explode(F.arrays_zip(shifted.alias("a"), F.col("pts").alias("b"))).alias("e")
    return rings.where(F.size("pts") > 0).select("region", "poly", "ring", edge).select(
        "region", "poly", "ring",
        F.col("e.a.lng").alias("x1"), F.col("e.a.lat").alias("y1"), F.col("e.b.lng").alias("x2"), F.col("e.b.lat").alias("y2"),
    )


def _banded(edges: DataFrame, band_deg: float) -> DataFrame:
    sloped = edges.where(F.col("y1") != F.col("y2"))
    low = F.floor(F.least("y1", "y2") / F.lit(band_deg))
    high = F.floor(F.greatest("y1", "y2") / F.lit(band_deg))
    return sloped.withColumn("band", F.explode(F.sequence(low, high)))


def _crosses(e: Column, x: Column, y: Column) -> Column:
    straddles = (e["y1"] > y) != (e["y2"] > y)
    return straddles & (x < (e["x1"] - e["x2"]) * (y - e["y2"]) / (e["y1"] - e["y2"]) + e["x2"])


def _odd(edges: Column, x: Column, y: Column) -> Column:
    return F.size(F.filter(edges, lambda e: _crosses(e, x, y))) % 2 == 1


def region_bands(edges: DataFrame, band_deg: float = BAND_DEG) -> DataFrame:
    """One row per latitude band with the polygons whose edges pass through it."""
    edge = F.struct("x1", "y1", "x2", "y2")
    per_ring = _banded(edges, band_deg).groupBy("band", "region", "poly", "ring").agg(F.collect_list(edge).alias("edges"))
    per_poly = per_ring.groupBy("band", "region", "poly").agg(
        F.flatten(F.collect_list(F.when(F.col("ring") == 0, F.col("edges")))).alias("outer"),
        F.collect_list(F.when(F.col("ring") > 0, F.col("edges"))).alias("holes"),
    )
    return per_poly.groupBy("band").agg(F.collect_list(F.struct("region", "outer", "holes")).alias("polys"))


@contextmanager
def broadcast_bound(rows: int) -> Iterator[None]:
    """Bound of broadcast tables while plans are built; 0 forces the shuffled form everywhere."""
    token = _bound.set(rows)
    try:
        yield
    finally:
        _bound.reset(token)


def within_bound(table: DataFrame) -> bool:
    """Whether the table as it would be broadcast, that is after it was spread over bands or cells, keeps to the bound."""
    return row_bound(table, _bound.get())


def assign_regions(points: DataFrame, edges: DataFrame, lng: str = "lng", lat: str = "lat", band_deg: float = BAND_DEG) -> DataFrame:
    """Add ``regions``: sorted ids of the regions that contain the point (even-odd rule, holes subtract).

    Where the edges by band keep to the broadcast bound, points are not shuffled at all. Otherwise every position is looked
    up once: positions meet the edges of rings that reach over their cell of longitude in their band, crossings are counted
    per position, and the result is joined back on the position, so a place with very many rows costs one row here.
    """
    band = F.floor(F.col(lat) / F.lit(band_deg)).cast("bigint")
    x, y = F.col(lng), F.col(lat)
    banded = _banded(edges, band_deg)
    if within_bound(banded):
        joined = points.withColumn("band", band).join(F.broadcast(region_bands(edges, band_deg)), "band", "left")
        hits = F.filter(
            F.col("polys"),
            lambda p: _odd(p["outer"], x, y) & ~F.exists(p["holes"], lambda h: _odd(h, x, y)),
        )
        ids = F.array_sort(F.array_distinct(F.transform(hits, lambda p: p["region"])))
        return joined.withColumn("regions", F.coalesce(ids, F.array().cast("array<string>"))).drop("band", "polys")

    ring = ["band", "region", "poly", "ring"]
    reach = banded.groupBy(*ring).agg(F.min(F.least("x1", "x2")).alias("west"), F.max(F.greatest("x1", "x2")).alias("east"))
    cells = F.sequence(F.floor(F.col("west") / CELL_DEG), F.floor(F.col("east") / CELL_DEG))
    spread = banded.join(reach.select(*ring, F.explode(cells).alias("cell")), ring)
    places = points.select(x.alias("px"), y.alias("py")).where(F.col("px").isNotNull() & F.col("py").isNotNull()).distinct()
    placed = places.withColumns({"band": F.floor(F.col("py") / F.lit(band_deg)).cast("bigint"), "cell": F.floor(F.col("px") / CELL_DEG)})
    e = F.struct("x1", "y1", "x2", "y2")
    crossings = (
        placed.join(spread, ["band", "cell"])
        .where(_crosses(e, F.col("px"), F.col("py")))
        .groupBy("px", "py", "region", "poly", "ring").count()
        .where(F.col("count") % 2 == 1)
    )
    inside = (
        crossings.groupBy("px", "py", "region", "poly")
        .agg(F.max(F.col("ring") == 0).alias("in_outer"), F.max(F.col("ring") > 0).alias("in_hole"))
        .where(F.col("in_outer") & ~F.col("in_hole"))
        .groupBy("px", "py").agg(F.array_sort(F.collect_set("region")).alias("regions"))
    )
    return points.join(inside, (x == F.col("px")) & (y == F.col("py")), "left").drop("px", "py").withColumn(
        "regions", F.coalesce("regions", F.array().cast("array<string>"))
    )


def in_region(regions: Column, key: str) -> Column:
    """Membership; the parent region is any of the six states."""
    if key == "new-england":
        return F.arrays_overlap(regions, F.array(*[F.lit(s) for s in V.STATE_IDS]))
    return F.array_contains(regions, key)


def lists_region(regions: Column, key: str) -> Column:
    """Visibility of a feature that carries a region list; the parent region shows everything."""
    return F.lit(True) if key == "new-england" else F.coalesce(F.array_contains(regions, key), F.lit(False))


def ordered_regions(found: Column, declared: Column | None = None, append_declared: bool = False) -> Column:
    """Region list in the fixed order; falls back to, or appends, the declared ones."""
    order = F.array(*[F.lit(r) for r in V.REGION_LIST_ORDER])
    if declared is None:
        return F.filter(order, lambda r: F.array_contains(found, r))
    if not append_declared:
        used = F.when(F.size(found) > 0, found).otherwise(declared)
        return F.filter(order, lambda r: F.array_contains(used, r))
    union = F.array_union(found, declared)
    ordered = F.filter(order, lambda r: F.array_contains(union, r))
    return F.concat(ordered, F.array_except(declared, order))


def path_regions(points: DataFrame, edges: DataFrame, keys: Sequence[str], **options) -> DataFrame:
    """Regions that any vertex of a path falls in, one row per path that touches one."""
    hit = assign_regions(points, edges, **options).select(*keys, F.explode("regions").alias("region")).distinct()
    return hit.groupBy(*keys).agg(F.collect_set("region").alias("found"))


def paths_in_required_region(points: DataFrame, edges: DataFrame, keys: Sequence[str], required: str) -> DataFrame:
    """Drop a path that needs a region and touches none (``required`` is a boolean column)."""
    touching = assign_regions(points, edges).where(F.size("regions") > 0).select(*keys).distinct()
    free = points.where(~F.coalesce(F.col(required), F.lit(False)))
    bound = points.where(F.col(required)).join(touching, list(keys), "left_semi")
    return free.unionByName(bound)


def probe_table(spark: SparkSession) -> DataFrame:
    rows = [
        (region, ix, float(lat), float(lng), float(nm) * V.KM_PER_NAUTICAL_MILE)
        for region, probes in V.PROBES.items()
        for ix, (lat, lng, nm) in enumerate(probes)
    ]
    return spark.createDataFrame(rows, "region string, probe_ix int, lat0 double, lng0 double, radius_km double")


def within_radius(points: DataFrame, circles: DataFrame, cell_deg: float = 0.25) -> DataFrame:
    """Pairs of a point and a circle that contains it; circles reach points through cells of latitude and longitude."""
    up = F.col("radius_km") / F.lit(110.0)
    # a degree of longitude is shortest at the latitude of the circle that is farthest from the equator
    across = up / F.greatest(F.cos(F.radians(F.least(F.lit(89.0), F.abs(F.col("lat0")) + up))), F.lit(0.01))
    spread = _cells(circles, F.col("lng0") - across, F.col("lng0") + across, F.col("lat0") - up, F.col("lat0") + up, cell_deg)
    here = [F.floor(F.col(c) / F.lit(cell_deg)).alias(n) for c, n in (("lng", "cx"), ("lat", "cy"))]
    located = points.select("*", *here)
    if within_bound(spread):
        pairs = located.join(F.broadcast(spread), ["cx", "cy"])
    else:
        salted = spread.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pairs = located.withColumn("salt", F.pmod(F.xxhash64(*points.columns), F.lit(SALTS)).cast("int")).join(salted, ["cx", "cy", "salt"]).drop("salt")
    distance = haversine_km(F.col("lng0"), F.col("lat0"), F.col("lng"), F.col("lat"))
    return pairs.withColumn("distance_km", distance).where(F.col("distance_km") <= F.col("radius_km")).drop("cx", "cy")


def _cells(df: DataFrame, x_low: Column, x_high: Column, y_low: Column, y_high: Column, cell: float) -> DataFrame:
    """One row per grid cell that the box of a row touches."""
    def span(low: Column, high: Column) -> Column:
        return F.sequence(F.floor(low / F.lit(cell)), F.floor(high / F.lit(cell)))

    return df.withColumn("cx", F.explode(span(x_low, x_high))).withColumn("cy", F.explode(span(y_low, y_high)))


def edge_cells(edges: DataFrame, cell: float, pad: float = 0.0) -> DataFrame:
    return _cells(
        edges, F.least("x1", "x2") - pad, F.greatest("x1", "x2") + pad, F.least("y1", "y2") - pad, F.greatest("y1", "y2") + pad, cell
    )


def near_edges(points: DataFrame, edges: DataFrame, radius: float, name: str, ids: Sequence[str], cell: float = 0.05) -> DataFrame:
    """Add boolean ``name``: the point lies within ``radius`` degrees of an edge."""
    here = [F.floor(F.col(c) / F.lit(cell)).cast("bigint").alias(n) for c, n in (("lng", "cx"), ("lat", "cy"))]
    distance = lambda e: segment_distance(F.col("lng"), F.col("lat"), e["x1"], e["y1"], e["x2"], e["y2"])
    touched = edge_cells(edges, cell, radius)
    if within_bound(touched):
        per_cell = touched.groupBy("cx", "cy").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("_edges"))
        joined = points.select("*", *here).join(F.broadcast(per_cell), ["cx", "cy"], "left")
        hit = F.coalesce(F.exists("_edges", lambda e: distance(e) <= radius), F.lit(False))
        return joined.withColumn(name, hit).drop("_edges", "cx", "cy")
    salted = touched.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keyed = points.select(*ids, "lng", "lat", *here).withColumn("salt", F.pmod(F.hash(*ids), F.lit(SALTS)))
    e = F.struct("x1", "y1", "x2", "y2")
    close = keyed.join(salted, ["cx", "cy", "salt"]).where(distance(e) <= radius).select(*ids).distinct()
    return points.join(close.withColumn(name, F.lit(True)), list(ids), "left").withColumn(name, F.coalesce(name, F.lit(False)))
