"""Data-quality jobs. Each returns offenders ``(check_id, key, detail)``; no row means pass."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline import fixed_values as V
from wayline.functions.numbers import finite, fixed_text
from wayline.functions.text import is_https, non_empty
from wayline.operators.ordered import OrderedScan
from wayline.operators.paths import long_legs


def _offenders(df: DataFrame, check: str, key: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check_id"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def all_checks(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def rule_breaks(df: DataFrame, check: str, key: Column, rules: dict[str, Column]) -> DataFrame:
    """One offender per row and broken rule; a rule that is null counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    rows = df.select(key.cast("string").alias("key"), F.explode(broken).alias("detail"))
    return rows.select(F.lit(check).alias("check_id"), "key", "detail")


def long_chords(scan: OrderedScan, key: Column, limit_km: float = V.MAX_CHORD_CHECK_KM) -> DataFrame:
    return _offenders(long_legs(scan, limit_km), "max_chord", key, F.concat(fixed_text(F.col("leg_km"), 1), F.lit(" km")))


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    dup = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return _offenders(dup, "unique_id", F.col(key), F.concat(F.lit("x"), F.col("n").cast("string")))


def required_set(df: DataFrame, column: str, required: DataFrame, exact: bool = True) -> DataFrame:
    """Missing required values, and with ``exact`` also the values that are not required."""
    have = df.select(F.col(column).alias("v")).distinct().withColumn("_have", F.lit(True))
    want = required.select(F.col(required.columns[0]).alias("v")).distinct().withColumn("_want", F.lit(True))
    both = have.join(want, "v", "full_outer" if exact else "right")
    detail = F.when(F.col("_have").isNull(), "missing").otherwise("unexpected")
    return _offenders(both.where(F.col("_have").isNull() | F.col("_want").isNull()), "required_set", F.col("v"), detail)


def literal_set(df: DataFrame, values: Sequence[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([(v,) for v in values], "v string")


def lineage(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Fields whose recorded value differs between two metadata tables."""
    a = left.select(key, *[F.col(f).alias(f"a_{f}") for f in fields])
    b = right.select(key, *[F.col(f).alias(f"b_{f}") for f in fields])
    return rule_breaks(a.join(b, key, "left"), "lineage", F.col(key), {f: F.col(f"a_{f}") == F.col(f"b_{f}") for f in fields})


def catalog_floor(df: DataFrame, name: str, floor: int, exact: bool = False) -> DataFrame:
    n = df.agg(F.count(F.lit(1)).alias("n"))
    bad = F.col("n") != floor if exact else F.col("n") < floor
    return _offenders(n.where(bad), "catalog_floor", F.lit(name), F.concat(F.col("n").cast("string"), F.lit(f" of {floor}")))


def point_validity(df: DataFrame, key: Column, group: str, status: str, extra: dict[str, Column] | None = None) -> DataFrame:
    rules = {
        "longitude": finite(F.col("lng")).isNotNull(), "latitude": finite(F.col("lat")).isNotNull(),
        "group": F.col("grp") == group, "data_status": F.col("data_status") == status, **(extra or {}),
    }
    return rule_breaks(df, "point_validity", key, rules)


def facility_rules() -> dict[str, Column]:
    return {"faa_id": non_empty(F.col("faa_id")).isNotNull(), "facility_use": F.col("facility_use").isin("public", "private")}


def crossing_rules() -> dict[str, Column]:
    return {
        "title": non_empty(F.col("title")).isNotNull(), "us_port": non_empty(F.col("us_port")).isNotNull(), "province": F.col("province").isin("NB", "QC"),
    }


def ferry_metadata(df: DataFrame, key: Column) -> DataFrame:
    return rule_breaks(
        df, "ferry_metadata", key,
        {
            "group": F.col("grp") == "ferry", "service_class": F.col("service_class").isin(*V.FERRY_SERVICE_CLASSES),
            "service_type": non_empty(F.col("service_type")).isNotNull(), "season": non_empty(F.col("season")).isNotNull(),
            "source_url": is_https(F.col("source_url")), "geometry": F.col("geom_type").isin("LineString", "MultiLineString"),
        },
    )


def air_metadata(df: DataFrame, key: Column) -> DataFrame:
    return rule_breaks(
        df, "air_metadata", key,
        {
            "group": F.col("grp") == "air-service", "data_status": F.coalesce("data_status", F.lit("scheduled")).isin("scheduled", "reference"),
            "service_type": non_empty(F.col("service_type")).isNotNull(), "season": non_empty(F.col("season")).isNotNull(),
            "geometry_note": non_empty(F.col("geometry_note")).isNotNull(), "source_url": is_https(F.col("source_url")),
            "geometry": F.col("geom_type") == "LineString",
        },
    )


def route_class(df: DataFrame, key: Column, pattern: str, expected: str) -> DataFrame:
    """Routes whose id matches ``pattern`` but whose group is not the expected one."""
    wrong = df.where(F.rlike("route", F.lit(pattern)) & ~F.col("grp").eqNullSafe(F.lit(expected)))
    return _offenders(wrong, "route_class", key, F.col("grp"))


def fingerprint_changes(actual: DataFrame, manifest: DataFrame, key: str, sha: str = "sha") -> DataFrame:
    """Changed, missing and extra geometry against the reviewed manifest."""
    a = actual.select(key, F.col(sha).alias("_actual"))
    m = manifest.select(key, F.col(sha).alias("_reviewed"))
    both = a.join(m, key, "full_outer")
    change = (
        F.when(F.col("_actual").isNull(), "missing").when(F.col("_reviewed").isNull(), "extra").when(F.col("_actual") != F.col("_reviewed"), "changed")
    )
    rows = both.withColumn("change", change).where(F.col("change").isNotNull())
    return _offenders(rows, "fingerprint", F.col(key), F.col("change"))


def road_cache_offenders(validated: DataFrame) -> DataFrame:
    """Errors of validated road-cache rows as offenders."""
    rows = validated.select("segment", F.explode("errors").alias("error"))
    return _offenders(rows, "road_cache", F.col("segment"), F.col("error"))
