"""Registry, table loading and the views that bind the given tables to mobility inputs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline import fixed_values as V
from wayline.operators.ordered import OrderedScan, time_chunk
from wayline.operators.regions import box_rings, broadcast_bound, edges_from_rings
from wayline.session import use_utc

NOW_TEXT = "2024-01-15 12:00:00"
NOW_S = 1705320000
START_US = 1704067200 * 1_000_000
TRIP_NOW_S = 897868800  # 1998-06-15


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    operators: tuple[str, ...]


REGISTRY: dict[str, Entry] = {}


def query(operators: str, sql: str | None = None) -> Callable:
    """Register a query under its function name; ``operators`` lists the inventory ids it covers."""
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(use_utc(spark), sf_dir.rstrip("/"))

        REGISTRY[fn.__name__] = Entry(run, sql, tuple(operators.split()))
        return run

    return register


def shuffled_form(name: str) -> None:
    """Register a query once more with the broadcast bound at 0, under the same SQL."""
    entry = REGISTRY[name]

    @wraps(entry.run)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with broadcast_bound(0):
            return entry.run(spark, sf_dir)

    REGISTRY[f"{name}_shuffled"] = Entry(run, entry.sql, entry.operators)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now() -> Column:
    return F.lit(NOW_TEXT).cast("timestamp")


def ratio(numerator: Column, denominator: int) -> Column:
    return numerator.cast("double") / F.lit(float(denominator))


def r6(x: Column) -> Column:
    return F.round(x, 6)


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("entity"), F.col("ts").cast("timestamp").alias("updated_at"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), F.col("event_type").alias("grp"),
        F.concat(F.lit("s"), (F.col("user_id") % 4).cast("string")).alias("source"),
        ratio(F.lit(-73800) + (F.col("event_id") * 7919) % 7200, 1000).alias("lng"),
        ratio(F.lit(40800) + (F.col("event_id") * 104729) % 6900, 1000).alias("lat"), F.col("value").alias("speed"), "props",
    )


FIX = """fix AS (SELECT event_id AS id, user_id AS entity, epoch_us(ts) AS ts_us, event_type AS grp, 's' || (user_id % 4) AS source,
  CAST(-73800 + (event_id * 7919) % 7200 AS DOUBLE) / 1000 AS lng, CAST(40800 + (event_id * 104729) % 6900 AS DOUBLE) / 1000 AS lat,
  value AS speed, props FROM events)"""


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path per user that drifts north-east with time on a grid of hundredths of a degree."""
    f = fixes(spark, sf_dir)
    minute = F.floor((F.col("ts_us") - F.lit(START_US)) / F.lit(60_000_000))
    return f.select(
        F.col("entity").alias("path"), "id", "ts_us",
        ratio(F.lit(-7300) + F.floor(minute * 500 / 43200) + (F.col("id") * 7919) % 5, 100).alias("lng"),
        ratio(F.lit(4150) + F.floor(minute * 400 / 43200) + (F.col("id") * 104729) % 5, 100).alias("lat"),
    )


TRACK = """track AS (SELECT user_id AS path, event_id AS id, epoch_us(ts) AS ts_us,
  CAST(-7300 + ((epoch_us(ts) - 1704067200000000) // 60000000) * 500 // 43200 + (event_id * 7919) % 5 AS DOUBLE) / 100 AS lng,
  CAST(4150 + ((epoch_us(ts) - 1704067200000000) // 60000000) * 400 // 43200 + (event_id * 104729) % 5 AS DOUBLE) / 100 AS lat
  FROM events)"""
WPATH = "PARTITION BY path ORDER BY ts_us, id"


def track_scan(spark: SparkSession, sf_dir: str) -> OrderedScan:
    return OrderedScan(track(spark, sf_dir), ["path"], ["ts_us", "id"], time_chunk("ts_us"))


def fix_scan(spark: SparkSession, sf_dir: str) -> OrderedScan:
    f = fixes(spark, sf_dir).select(F.col("entity").alias("path"), "id", "ts_us", "lng", "lat")
    return OrderedScan(f, ["path"], ["ts_us", "id"], time_chunk("ts_us"))


FIXPATH = "fixpath AS (SELECT entity AS path, id, ts_us, lng, lat FROM fix)"


def km(a_lng: str, a_lat: str, b_lng: str, b_lat: str) -> str:
    return (
        f"(2 * 6371.0 * asin(sqrt(pow(sin(radians({b_lat} - {a_lat}) / 2), 2) + cos(radians({a_lat})) * cos(radians({b_lat})) "
        f"* pow(sin(radians({b_lng} - {a_lng}) / 2), 2))))"
    )


# a concave polygon with a hole beside the region boxes
NOTCH_RINGS = [
    ("notch", 0, 0, [(-73.0, 41.0), (-69.0, 41.0), (-69.0, 45.0), (-71.0, 43.0), (-73.0, 45.0)]),
    ("notch", 0, 1, [(-71.5, 41.5), (-70.5, 41.5), (-70.5, 42.5), (-71.5, 42.5)]),
]
STATE_RINGS = box_rings({k: V.REGION_BOXES[k] for k in ["boston", *V.STATE_IDS]})
RINGS = [*STATE_RINGS, *NOTCH_RINGS]


def region_edges(spark: SparkSession) -> DataFrame:
    return edges_from_rings(spark, RINGS)


def edge_values(rings=None) -> str:
    rows = []
    for region, poly, ring, pts in rings or RINGS:
        for i, (x2, y2) in enumerate(pts):
            x1, y1 = pts[i - 1]
            rows.append(f"('{region}',{poly},{ring},{x1}::DOUBLE,{y1}::DOUBLE,{x2}::DOUBLE,{y2}::DOUBLE)")
    return f"edge(region, poly, ring, x1, y1, x2, y2) AS (VALUES {', '.join(rows)})"


def inside_cte(source: str, key: str = "id", name: str = "inside", edge: str = "edge") -> str:
    """(key, region) pairs by the even-odd rule over a brute-force product with the edges."""
    return f"""{name}_ring AS (SELECT {key}, region, poly, ring FROM {source}, {edge}
  WHERE (y1 > lat) != (y2 > lat) AND lng < (x1 - x2) * (lat - y2) / (y1 - y2) + x2
  GROUP BY {key}, region, poly, ring HAVING count(*) % 2 = 1),
{name} AS (SELECT DISTINCT {key}, region FROM {name}_ring a WHERE ring = 0 AND NOT EXISTS (
  SELECT 1 FROM {name}_ring h WHERE h.{key} = a.{key} AND h.region = a.region AND h.poly = a.poly AND h.ring > 0))"""


def stops_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").cast("string").alias("stop"), F.col("s_name").alias("name"),
        ratio(F.lit(-73500) + (F.col("s_suppkey") * 7919) % 6000, 1000).alias("lng"),
        ratio(F.lit(41000) + (F.col("s_suppkey") * 104729) % 5000, 1000).alias("lat"),
    )


STATION = """station AS (SELECT CAST(s_suppkey AS VARCHAR) AS stop, s_name AS name, CAST(-73500 + (s_suppkey * 7919) % 6000 AS DOUBLE) / 1000 AS lng,
  CAST(41000 + (s_suppkey * 104729) % 5000 AS DOUBLE) / 1000 AS lat FROM supplier)"""


STOP_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "time"]


def stop_times_view(spark: SparkSession, sf_dir: str) -> OrderedScan:
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(
        F.col("l_orderkey").alias("trip"), *[c for c in STOP_ORDER if c != "time"], F.col("l_suppkey").cast("string").alias("stop"),
        F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("time"),
    )
    chunk = F.col("l_linenumber").cast("bigint") * 10_000_000 + F.floor(F.col("l_partkey") / 1000).cast("bigint")
    return OrderedScan(rows, ["trip"], STOP_ORDER, chunk)


STOPTIME = """stoptime AS (SELECT l_orderkey AS trip, CAST(l_suppkey AS VARCHAR) AS stop, CAST(epoch(l_shipdate) AS BIGINT) AS time,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS seq
  FROM lineitem)"""


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One short path per vector, held in its row."""
    e = table(spark, sf_dir, "embeddings")
    dim = F.floor(F.size("embedding") / 2).cast("int")
    axis = lambda i: F.floor(F.get("embedding", i).cast("double") * 1000) / 1000
    pts = F.transform(F.sequence(F.lit(0), dim - 1), lambda i: F.struct((axis(2 * i) - 72).alias("lng"), (axis(2 * i + 1) + 43).alias("lat")))
    return e.select("vec_id", "label", pts.alias("points"))


SHAPE = """shape AS (SELECT vec_id, label, list_transform(range(0, len(embedding) // 2), lambda i: struct_pack(
  lng := floor(CAST(embedding[2 * i + 1] AS DOUBLE) * 1000) / 1000 - 72, lat := floor(CAST(embedding[2 * i + 2] AS DOUBLE) * 1000) / 1000 + 43)) AS points
  FROM embeddings)"""
SHAPEPT = "shapept AS (SELECT vec_id, i AS ix, points[i + 1].lng AS lng, points[i + 1].lat AS lat FROM shape, unnest(range(0, len(points))) AS u(i))"


def with_ctes(*parts: str, recursive: bool = False) -> str:
    *ctes, body = parts
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n" + body
