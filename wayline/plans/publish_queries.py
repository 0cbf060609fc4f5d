"""Guarded snapshots and incremental rebuilds."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wayline.operators.publish import Floor, Snapshots, rebuild, required_feeds
from wayline.operators.trips import select_routes
from wayline.plans.base import REGISTRY, query, table
from wayline.plans.trip_queries import feeds, gtfs
from wayline.session import scratch_folder


@query("AG20 QC03 QC07 SNK01", "SELECT CAST(p_partkey AS VARCHAR) AS ident, p_name AS name, 'kept' AS state FROM part")
def guarded_catalog(spark, sf):
    """A good catalog, then one that lost a required feed and a tenth of its rows: the first stays readable, the second is reported."""
    k = F.col("p_partkey")
    rows = table(spark, sf, "part").select(k.cast("string").alias("ident"), F.col("p_name").alias("name"), F.concat(F.lit("f"), (k % 5).cast("string")).alias("feed"))
    catalog = Snapshots(spark, f"{scratch_folder(spark)}/{uuid.uuid4().hex}")
    floors = {"catalog": Floor(F.count("ident"), least=1, share=0.9), **required_feeds(["f0", "f1"])}
    first = catalog.publish(rows, floors)
    second = catalog.publish(rows.where("feed <> 'f1'"), floors)
    state = "kept" if first.published and not second.published and len(second.failures) == 2 else "lost"
    return catalog.current().select("ident", "name", F.lit(state).alias("state"))


@query("GEO07 SNK01 GEO09", REGISTRY["selected_routes"].sql)
def rebuilt_routes(spark, sf):
    """Routes built feed by feed, then again after two feeds changed and one came: only these are built, and the table is the full build."""
    path, routes = f"{scratch_folder(spark)}/{uuid.uuid4().hex}", gtfs(spark, sf)["routes"]
    built = lambda inputs: select_routes(inputs["routes"], feeds(spark)).select("feed", "route_id", "kind", "label")
    earlier = routes.where("feed <> 'f4'").withColumn("route_long_name", F.when(F.col("feed").isin("f1", "f2"), "an older name").otherwise(F.col("route_long_name")))
    rebuild({"routes": earlier}, "feed", built, path)
    rebuild({"routes": routes}, "feed", built, path)
    return spark.read.schema("feed string, route_id string, kind int, label string").parquet(f"{path}/rows")
