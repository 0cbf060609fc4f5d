"""Line-over-land audit of water routes.

``edges`` is a region edge table whose ``region`` is a shoreline level (``L1`` land, ``L2`` lake,
``L3`` island in a lake, ``L4`` pond on it) or ``water`` (mapped hydrography). Land is
(L1 minus L2) plus (L3 minus L4), less everything within the buffer of mapped water.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline import fixed_values as V
from wayline.functions.geo import planar_distance, segment_distance
from wayline.operators.ordered import OrderedScan, block_chunk
from wayline.operators.regions import SALTS, _cells, assign_regions, edge_cells, near_edges, within_bound

CELL_DEG = 0.05


def _is_dry(regions: Column, near_water: Column) -> Column:
    def has(level: str) -> Column:
        return F.array_contains(regions, level)

    land = (has("L1") & ~has("L2")) | (has("L3") & ~has("L4"))
    return land & ~has("water") & ~near_water


def _cut_parameters(buffer: float) -> Column:
    """Fractions of a segment at which it meets an edge, or the buffer outline of a water edge."""
    px, py = F.col("sx"), F.col("sy")
    dx, dy = F.col("ex") - px, F.col("ey") - py
    ux, uy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    norm = F.sqrt(ux * ux + uy * uy)
    cross = dx * uy - dy * ux
    offset = (F.col("x1") - px) * uy - (F.col("y1") - py) * ux
    along = (F.col("x1") - px) * dy - (F.col("y1") - py) * dx
    hit = F.when(cross != 0, offset / cross)
    on_edge = F.when(cross != 0, along / cross).between(0.0, 1.0)

    def circle(cx: Column, cy: Column) -> list[Column]:
        a = dx * dx + dy * dy
        b = (px - cx) * dx + (py - cy) * dy
        c = (px - cx) * (px - cx) + (py - cy) * (py - cy) - F.lit(buffer * buffer)
        disc = b * b - a * c
        root = F.when((a > 0) & (disc >= 0), F.sqrt(F.greatest(disc, F.lit(0.0))))
        return [F.when(root.isNotNull(), (-b + s * root) / a) for s in (1, -1)]

    parallel = [F.when(cross != 0, (offset + s * F.lit(buffer) * norm) / cross) for s in (1, -1)]
    outline = [*circle(F.col("x1"), F.col("y1")), *circle(F.col("x2"), F.col("y2")), *parallel]
    crossing = F.array(F.when(on_edge, hit))
    cuts = F.when(F.col("region") == "water", F.concat(crossing, F.array(*outline))).otherwise(crossing)
    return F.filter(cuts, lambda t: t.isNotNull() & (t > 0.0) & (t < 1.0))


def dry_pieces(points: DataFrame, edges: DataFrame, keys: list[str], buffer: float = V.WATER_BUFFER_DEG, cell: float = CELL_DEG) -> OrderedScan:
    """Sub-segments of every path between its cuts, each flagged ``dry``."""
    scan = OrderedScan(points, keys, ["ix"], block_chunk("ix")).extend(
        lag={"sx": F.col("lng"), "sy": F.col("lat")}, first={"ax": F.col("lng"), "ay": F.col("lat")}, last={"bx": F.col("lng"), "by": F.col("lat")}
    )
    legs = scan.settle().df.where(F.col("sx").isNotNull()).withColumnsRenamed({"lng": "ex", "lat": "ey"})
    touched = edge_cells(edges, cell, buffer)
    located = _cells(legs, F.least("sx", "ex"), F.greatest("sx", "ex"), F.least("sy", "ey"), F.greatest("sy", "ey"), cell)
    if within_bound(touched):
        met = located.join(F.broadcast(touched), ["cx", "cy"])
    else:
        salted = touched.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = located.withColumn("salt", F.pmod(F.hash(*keys, "ix"), F.lit(SALTS))).join(salted, ["cx", "cy", "salt"]).drop("salt")
    shape = [*keys, "ix", "sx", "sy", "ex", "ey", "ax", "ay", "bx", "by"]
    cuts = met.select(*shape, "cx", "cy", F.explode(_cut_parameters(buffer)).alias("t"))
    # a segment and an edge may share several cells; the cell of the cut itself reports it
    cut_x, cut_y = (F.col(a) + (F.col(b) - F.col(a)) * F.col("t") for a, b in (("sx", "ex"), ("sy", "ey")))
    own_cell = (F.floor(cut_x / cell) == F.col("cx")) & (F.floor(cut_y / cell) == F.col("cy"))
    marks = cuts.where(own_cell).drop("cx", "cy").unionByName(legs.select(*shape, F.lit(0.0).alias("t")))
    ordered = OrderedScan(marks, keys, ["ix", "t"], block_chunk("ix")).extend(lead={"_next_ix": F.col("ix"), "_next_t": F.col("t")})
    until = F.when(F.col("_next_ix") == F.col("ix"), F.col("_next_t")).otherwise(1.0)
    span = lambda a, b, t: a + (b - a) * t
    sx, sy, ex, ey = (F.col(c) for c in ("sx", "sy", "ex", "ey"))
    half = (F.col("t") + F.col("u")) / 2
    pieces = ordered.with_columns({"u": until}).transform(lambda df: df.where(F.col("u") > F.col("t"))).with_columns(
        {
            "x0": span(sx, ex, F.col("t")), "y0": span(sy, ey, F.col("t")), "x1": span(sx, ex, F.col("u")), "y1": span(sy, ey, F.col("u")),
            "lng": span(sx, ex, half), "lat": span(sy, ey, half),
        }
    )
    ids = [*keys, "ix", "t"]
    water = edges.where(F.col("region") == "water")

    def classify(df: DataFrame) -> DataFrame:
        slim = df.drop("_next_ix", "_next_t", "sx", "sy", "ex", "ey")
        flagged = near_edges(assign_regions(slim, edges), water, buffer, "near_water", ids, cell)
        return flagged.withColumn("dry", _is_dry(F.col("regions"), F.col("near_water"))).drop("regions", "near_water", "lng", "lat", "u")

    return pieces.transform(classify).settle()


def dry_runs(points: DataFrame, edges: DataFrame, keys: list[str], **options) -> DataFrame:
    """Maximal dry stretches per path with planar length in degrees, terminal flag and verdict."""
    opens = F.when(F.col("dry") & ~F.coalesce("_was", F.lit(False)), F.lit(1)).otherwise(F.lit(0))
    rows = dry_pieces(points, edges, keys, **options).extend(
        lag={"_was": F.col("dry")}, derived={"_opens": opens}, running_sum={"run": F.col("_opens")}
    ).df.where("dry")
    reach = lambda x, y: segment_distance(F.col(x), F.col(y), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    runs = rows.groupBy(*keys, "run").agg(
        F.sum(planar_distance(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))).alias("length_deg"),
        F.min(F.least(reach("ax", "ay"), reach("bx", "by"))).alias("end_gap"),
    )
    terminal = F.col("end_gap") < V.TERMINAL_REACH_DEG
    limit = F.when(terminal, V.DRY_TERMINAL_DEG).otherwise(V.DRY_INTERIOR_DEG)
    return runs.withColumns({"terminal": terminal, "fails": F.col("length_deg") > limit}).drop("end_gap")


def failing_routes(runs: DataFrame, route: str) -> DataFrame:
    """Longest failing stretch and number of failing stretches per route, worst first."""
    return runs.where("fails").groupBy(route).agg(
        F.max("length_deg").alias("longest_deg"), F.count(F.lit(1)).alias("runs"), F.max_by("terminal", "length_deg").alias("terminal")
    ).orderBy(F.desc("longest_deg"), route)


def inland_controls(controls: DataFrame, edges: DataFrame, ids: list[str], margin: float = V.CONTROL_INLAND_DEG) -> DataFrame:
    """Control points on land and farther than ``margin`` from any shore."""
    water, shore = edges.where(F.col("region") == "water"), edges.where(F.col("region") != "water")
    rows = assign_regions(controls, edges)
    rows = near_edges(rows, water, V.WATER_BUFFER_DEG, "near_water", ids)
    rows = near_edges(rows, shore, margin, "near_shore", ids)
    rows = near_edges(rows, water, margin + V.WATER_BUFFER_DEG, "near_bank", ids)
    return rows.where(_is_dry(F.col("regions"), F.col("near_water")) & ~F.col("near_shore") & ~F.col("near_bank")).drop(
        "near_water", "near_shore", "near_bank"
    )
