"""Encoded polylines: decode and encode whole columns, map-side."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTS_TYPE = T.ArrayType(T.StructType([T.StructField("lng", T.DoubleType()), T.StructField("lat", T.DoubleType())]))


SLICE_BYTES = 1 << 18  # of the texts whose digits are held as numbers at a time


def _decode_texts(texts: list[str | None]) -> pa.Array:
    """Decode texts in one pass over their concatenated bytes.

    A text that ends inside a number, has an odd count of numbers, or holds a byte that the code does not have is null; its
    neighbours are not touched. A number has at most 12 digits of five bits.
    """
    raw = [t.encode() if t is not None else b"" for t in texts]
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    codes = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.int64) - 63
    borders = np.cumsum(sizes)
    row = np.repeat(np.arange(len(raw)), sizes)
    final = codes < 32
    broken = np.zeros(len(raw), dtype=bool)
    full = sizes > 0
    broken[full] = ~final[borders[full] - 1]
    broken[row[(codes < 0) | (codes > 63)]] = True
    stops = final.copy()
    stops[borders[full] - 1] = True  # no number goes on into the next text
    ends = np.flatnonzero(stops)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    run = np.arange(len(codes)) - np.repeat(starts, ends - starts + 1)
    broken[row[run > 11]] = True
    values = np.add.reduceat((codes & 31) << np.minimum(5 * run, 60), starts) if len(ends) else codes
    deltas = np.where(values & 1, ~(values >> 1), values >> 1)
    counts = np.bincount(row[ends], minlength=len(raw)) if len(ends) else np.zeros(len(raw), dtype=np.int64)
    broken |= (counts % 2 == 1) | np.array([t is None for t in texts], dtype=bool)
    numbers = deltas[np.repeat(~broken, counts)].reshape(-1, 2)
    points = np.where(broken, 0, counts // 2)
    offsets = np.concatenate([[0], np.cumsum(points)])
    run_up = np.concatenate([np.zeros((1, 2), dtype=np.int64), numbers.cumsum(axis=0)])
    pair = (run_up[1:] - np.repeat(run_up[offsets[:-1]], points, axis=0)) / 1e5
    lat_lng = pa.StructArray.from_arrays([pa.array(pair[:, 1]), pa.array(pair[:, 0])], names=["lng", "lat"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), lat_lng, mask=pa.array(broken))


def _decode_batch(texts: pa.Array) -> pa.Array:
    """Slice by slice, since a digit takes many times its byte while it is decoded; points never become Python objects."""
    rows = max(1, SLICE_BYTES * len(texts) // max(1, texts.nbytes))
    pieces = [_decode_texts(texts.slice(at, rows).to_pylist()) for at in range(0, max(1, len(texts)), rows)]
    return pa.concat_arrays(pieces)


@F.arrow_udf(POINTS_TYPE)
def decode_polyline(encoded: pa.Array) -> pa.Array:
    return _decode_batch(encoded)


def _encode_delta(delta: Column) -> Column:
    zigzag = F.when(delta < 0, F.bitwise_not(F.shiftleft(delta, 1))).otherwise(F.shiftleft(delta, 1))

    def digit(k: int) -> Column:
        rest = F.shiftright(zigzag, 5 * k)
        more = F.when(F.shiftright(zigzag, 5 * (k + 1)) > 0, 32).otherwise(0)
        return F.when((rest > 0) | F.lit(k == 0), F.char(rest.bitwiseAND(31) + more + F.lit(63))).otherwise("")

    return F.concat(*[digit(k) for k in range(12)])


def encode_polyline(points: Column) -> Column:
    """Encode ``array<struct<lng,lat>>`` at five decimals, latitude first."""
    whole = F.transform(
        points,
        lambda p: F.struct(
            F.floor(p["lat"] * 1e5 + 0.5).cast("bigint").alias("lat"), F.floor(p["lng"] * 1e5 + 0.5).cast("bigint").alias("lng")
        ),
    )
    zero = F.array(F.struct(F.lit(0).cast("bigint").alias("lat"), F.lit(0).cast("bigint").alias("lng")))
    before = F.slice(F.concat(zero, whole), F.lit(1), F.size(points))
    pieces = F.zip_with(
        whole, before, lambda a, b: F.concat(_encode_delta(a["lat"] - b["lat"]), _encode_delta(a["lng"] - b["lng"]))
    )
    return F.array_join(pieces, "")


def distinct_shapes(shapes, route: str = "route", encoded: str = "polyline"):
    """Distinct encoded shapes per route."""
    return shapes.select(route, encoded).distinct()


