"""Registered queries: operators bound to the given tables, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayline.plans.base import REGISTRY, shuffled_form
from wayline.plans import (  # noqa: F401  (registration)
    alert_queries, asof_queries, catalog_queries, file_queries, fix_queries, gate_queries, path_queries, poll_queries, publish_queries, quality_queries, region_queries, route_queries,
    source_queries, stream_queries, text_queries, trip_queries,
)

for _name in ("region_counts", "path_regions", "required_region_paths", "alerts_in_region", "station_features", "probe_join", "inland_points"):
    shuffled_form(_name)


def query_functions() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: entry.run for name, entry in REGISTRY.items()}


def oracle_statements() -> dict[str, str]:
    return {name: entry.sql for name, entry in REGISTRY.items() if entry.sql}
