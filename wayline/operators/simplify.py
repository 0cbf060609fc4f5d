"""Polyline simplification over all paths at once.

Paths of at most ``local_points`` points are simplified in Arrow batches. A longer one is split by
distributed rounds (one farthest-point aggregate per open span and round, checkpointed)
until every open span is that short, so no task ever holds a whole hot path.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline import fixed_values as V
from wayline.functions.geo import haversine_km, segment_distance
from wayline.operators.paths import path_scan
from wayline.session import cut_lineage, row_bound

LOCAL_POINTS = 20_000


def _haversine(a: np.ndarray, b: np.ndarray) -> float:
    (lng1, lat1), (lng2, lat2) = np.radians(a), np.radians(b)
    h = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lng2 - lng1) / 2) ** 2
    return float(2 * V.EARTH_RADIUS_KM * np.arcsin(np.sqrt(h)))


def kept_mask(xy: np.ndarray, tolerance: float, chord_km: float | None) -> np.ndarray:
    """Points kept in one span, worked off a stack of open sub-spans."""
    keep = np.zeros(len(xy), dtype=bool)
    keep[[0, -1]] = True
    stack = [(0, len(xy) - 1)]
    while stack:
        lo, hi = stack.pop()
        if hi - lo < 2:
            continue
        a, b, inner = xy[lo], xy[hi], xy[lo + 1 : hi]
        d = b - a
        length2 = float(d @ d)
        t = np.clip((inner - a) @ d / length2, 0.0, 1.0) if length2 else np.zeros(len(inner))
        gap = inner - (a + t[:, None] * d)
        dist = np.sqrt(gap[:, 0] ** 2 + gap[:, 1] ** 2)
        at = int(dist.argmax())
        if dist[at] > tolerance:
            cut = lo + 1 + at
        elif chord_km is not None and _haversine(a, b) > chord_km:
            cut = lo + (hi - lo + 1) // 2
        else:
            continue
        keep[cut] = True
        stack += [(lo, cut), (cut, hi)]
    return keep


def _simplify_groups(rows: pa.Table, starts: np.ndarray, tolerance: float, chord_km: float | None) -> pa.Table:
    """Kept rows of the whole groups in ``rows``, which begin at ``starts``."""
    xy = np.column_stack([rows["lng"].to_numpy(), rows["lat"].to_numpy()])
    keep = np.zeros(len(xy), dtype=bool)
    ends = np.append(starts[1:], len(xy))
    for a, b in zip(starts, ends):
        keep[a:b] = kept_mask(xy[a:b], tolerance, chord_km)
    # a span that is not the tail of its path leaves its end to the next span
    keep[ends - 1] = rows["tail"].to_numpy(zero_copy_only=False)[ends - 1]
    return rows.filter(pa.array(keep))


def _finish_locally(spans: DataFrame, keys: Sequence[str], tolerance: float, chord_km: float | None) -> DataFrame:
    """Simplify bounded spans, many per Arrow batch; only the last, unfinished span waits for the next batch."""
    group = [*keys, "lo"]
    out = [*keys, "ix", "lng", "lat"]
    schema = spans.select(*out).schema

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.Table | None = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = pa.Table.from_batches([batch])
            if waiting is not None:
                rows = pa.concat_tables([waiting, rows])
            change = np.zeros(rows.num_rows, dtype=bool)
            for name in group:
                values = rows[name].to_numpy()
                change[1:] |= values[1:] != values[:-1]
            starts = np.append(0, np.flatnonzero(change))
            waiting = rows.slice(int(starts[-1]))
            if len(starts) > 1:
                done = rows.slice(0, int(starts[-1]))
                yield from _simplify_groups(done, starts[:-1], tolerance, chord_km).select(out).combine_chunks().to_batches()
        if waiting is not None:
            yield from _simplify_groups(waiting, np.array([0]), tolerance, chord_km).select(out).combine_chunks().to_batches()

    ordered = spans.select(*group, "tail", "ix", "lng", "lat").repartition(*[F.col(c) for c in group]).sortWithinPartitions(*group, "ix")
    return ordered.mapInArrow(finish, schema)


def _point() -> Column:
    return F.struct(F.col("ix"), F.col("lng"), F.col("lat"))


def _rounds(big: DataFrame, keys: Sequence[str], tolerance: float, chord_km: float | None, local_points: int) -> Iterator[DataFrame]:
    """Yield span tables small enough for one batch, and the kept corners of spans that need no more cuts."""
    ends = big.groupBy(*keys).agg(F.min_by(_point(), "ix").alias("a"), F.max_by(_point(), "ix").alias("b"))
    open_spans = big.join(ends, list(keys)).withColumns({"lo": F.col("a.ix"), "hi": F.col("b.ix"), "tail": F.lit(True)})
    open_spans = cut_lineage(open_spans)
    while not row_bound(open_spans, 0):
        a, b = F.col("a"), F.col("b")
        inner = (F.col("ix") > F.col("lo")) & (F.col("ix") < F.col("hi"))
        dist = segment_distance(F.col("lng"), F.col("lat"), a["lng"], a["lat"], b["lng"], b["lat"])
        middle = F.col("lo") + F.floor((F.col("hi") - F.col("lo") + 1) / 2)
        measured = open_spans.withColumn("dist", F.when(inner, dist))
        choice = measured.groupBy(*keys, "lo").agg(
            F.max("dist").alias("far"),
            F.max_by(_point(), F.when(inner, F.struct(F.col("dist"), -F.col("ix")))).alias("far_point"),
            F.max(F.when(F.col("ix") == middle, _point())).alias("middle_point"),
        )
        joined = measured.drop("dist").join(choice, [*keys, "lo"])
        long_chord = F.lit(False)
        if chord_km is not None:
            long_chord = haversine_km(a["lng"], a["lat"], b["lng"], b["lat"]) > F.lit(chord_km)
        cut = F.when(F.col("far") > tolerance, F.col("far_point")).when(long_chord, F.col("middle_point"))
        joined = cut_lineage(joined.withColumn("cut", cut).drop("far", "far_point", "middle_point"))

        closed = joined.where(F.col("cut").isNull())
        corner = (F.col("ix") == F.col("lo")) | (F.col("tail") & (F.col("ix") == F.col("hi")))
        yield closed.where(corner).withColumn("done", F.lit(True))

        split = joined.where(F.col("cut").isNotNull())
        left = split.where(F.col("ix") <= F.col("cut.ix")).withColumns(
            {"b": F.col("cut"), "hi": F.col("cut.ix"), "tail": F.lit(False)}
        )
        right = split.where(F.col("ix") >= F.col("cut.ix")).withColumns({"a": F.col("cut"), "lo": F.col("cut.ix")})
        halves = left.unionByName(right).drop("cut")
        fits = F.col("hi") - F.col("lo") < local_points
        yield halves.where(fits).withColumn("done", F.lit(False))
        open_spans = halves.where(~fits)


def simplify(
    points: DataFrame,
    keys: Sequence[str] = ("path",),
    tolerance: float = V.SIMPLIFY_TOLERANCE_DEG,
    chord_km: float | None = None,
    local_points: int = LOCAL_POINTS,
    chunk: Column | None = None,
    dense: bool = False,
) -> DataFrame:
    """Keep the farthest point of a span while it is beyond ``tolerance``; ``chord_km`` also halves long chords.

    ``ix`` of the result numbers the points of the input path from 0; ``dense`` says that the
    input is numbered so already.
    """
    keys = list(keys)
    sizes = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    if not dense:
        points = path_scan(points, keys, chunk=chunk).extend(position="_pos").df.drop("ix").withColumnRenamed("_pos", "ix")
    dense_points = points.select(*keys, F.col("ix").cast("bigint").alias("ix"), F.col("lng").cast("double"), F.col("lat").cast("double"))
    oversized = sizes.where(F.col("n") > local_points).select(*keys)
    if row_bound(oversized, 0):
        spans = dense_points.withColumns({"lo": F.lit(0).cast("bigint"), "tail": F.lit(True)})
        return _finish_locally(spans, keys, tolerance, chord_km)

    small = dense_points.join(oversized, keys, "left_anti").withColumns({"lo": F.lit(0).cast("bigint"), "tail": F.lit(True)})
    kept = [_finish_locally(small, keys, tolerance, chord_km)]
    for part in _rounds(dense_points.join(oversized, keys, "left_semi"), keys, tolerance, chord_km, local_points):
        part_done = part.where("done").select(*keys, "ix", "lng", "lat")
        part_open = part.where(~F.col("done")).select(*keys, "lo", "tail", "ix", "lng", "lat")
        kept += [part_done, _finish_locally(part_open, keys, tolerance, chord_km)]
    result = kept[0]
    for part in kept[1:]:
        result = result.unionByName(part)
    return result


def simplify_bus(points: DataFrame, keys: Sequence[str] = ("path",), **options) -> DataFrame:
    return simplify(points, keys, chord_km=V.MAX_CHORD_KM, **options)
