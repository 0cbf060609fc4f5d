"""Counts and extents by source, group and region."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline import fixed_values as V
from wayline.operators.regions import assign_regions, in_region


def region_counts(fixes: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities and stale entities per region, source and group."""
    rows = assign_regions(fixes, edges).select(F.explode("regions").alias("region"), "source", "grp", "stale")
    return rows.groupBy("region", "source", "grp").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("stale")).alias("n_stale")
    )


def counts_in_region(fixes: DataFrame, edges: DataFrame, region: str) -> DataFrame:
    inside = assign_regions(fixes, edges).where(in_region(F.col("regions"), region))
    return inside.groupBy("source", "grp").agg(F.count(F.lit(1)).alias("n"))


def region_rollup(fixes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts per state and group with subtotals; a fix in two states counts once in the parent."""
    located = assign_regions(fixes, edges)
    states = F.array(*[F.lit(s) for s in V.STATE_IDS])
    marked = located.withColumn("states", F.array_intersect("regions", states)).where(F.size("states") > 0)
    leaf = marked.select(F.explode("states").alias("region"), "grp")
    per_state = leaf.rollup("region", "grp").agg(F.count(F.lit(1)).alias("n")).where(F.col("region").isNotNull())
    parent = marked.rollup("grp").agg(F.count(F.lit(1)).alias("n")).withColumn("region", F.lit("new-england"))
    return per_state.unionByName(parent.select("region", "grp", "n"))


def live_totals(counts: DataFrame) -> DataFrame:
    """Total per group over all sources; all-null stays null."""
    return counts.groupBy("grp").agg(F.sum("n").alias("live"))


def layer_groups(spark: SparkSession) -> DataFrame:
    rows = [(key, routes, kind, vehicle) for key, routes, kind, vehicle in V.LAYER_GROUPS]
    return spark.createDataFrame(rows, "grp string, routes array<string>, route_type int, is_vehicle boolean")


def group_members(groups: DataFrame, routes: DataFrame) -> DataFrame:
    """``(grp, route)`` of every layer group: named routes, or routes of its type that no group names."""
    named = groups.select("grp", F.explode("routes").alias("route"))
    typed = groups.where(F.col("route_type").isNotNull()).select("grp", F.col("route_type").alias("kind"))
    by_type = routes.where(~F.col("route").isin(*V.SILVER_ROUTES)).join(typed, "kind").select("grp", "route")
    return named.unionByName(by_type)


def vehicle_total(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """Grand total over groups that count as vehicles."""
    joined = counts.join(groups.select("grp", "is_vehicle"), "grp")
    return joined.agg(F.coalesce(F.sum(F.when(F.col("is_vehicle"), F.col("n"))), F.lit(0)).alias("total"))


def scheduled_routes(routes: DataFrame) -> DataFrame:
    """Distinct scheduled routes per group."""
    named = routes.where((F.coalesce("grp", F.lit("")) != "") & (F.coalesce("route", F.lit("")) != ""))
    return named.select("grp", "route").distinct().groupBy("grp").agg(F.count(F.lit(1)).alias("routes"))


def group_extent(layers: Sequence[DataFrame], key: str = "grp") -> DataFrame:
    """Bounding box per group from the first layer that has points for it."""
    stacked = None
    for rank, layer in enumerate(layers):
        part = layer.select(key, "lng", "lat", F.lit(rank).alias("rank"))
        stacked = part if stacked is None else stacked.unionByName(part)
    boxes = stacked.groupBy(key, "rank").agg(
        F.min("lng").alias("west"), F.min("lat").alias("south"), F.max("lng").alias("east"), F.max("lat").alias("north"),
    )
    box = F.struct("west", "south", "east", "north", "rank")
    return boxes.groupBy(key).agg(F.min_by(box, "rank").alias("b")).select(key, "b.*")


def visible(fixes: DataFrame, groups: Sequence[str], statuses: Sequence[str]) -> DataFrame:
    return fixes.where(
        F.col("grp").isin(*groups) & F.coalesce("data_status", F.lit("live")).isin(*statuses)
    )
