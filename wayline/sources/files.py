"""File sources: GTFS folders and archives, GeoJSON, registries, catalogs; and the writers."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline import schemas as S
from wayline.operators.ordered import last_wins
from wayline.sources.records import headed_rows, numbered_lines, records

def gtfs_archives(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One GTFS table of every ``<feed>.zip`` under ``path``, with ``feed`` and the row number in its file.

    The member is found by its name in any folder and case and read as a stream; a byte-order mark is dropped; a missing
    member gives no rows. No archive is left out: one that Spark cannot hold as a row fails the job.
    """
    columns = [c.split()[0] for c in S.GTFS[table].split(", ")]
    schema = f"feed string, row_ix bigint, {S.GTFS[table]}"

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for feed, content in zip(batch["feed"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    member = next((n for n in archive.namelist() if n.rsplit("/", 1)[-1].lower() == f"{table}.txt"), None)
                    if member is None:
                        continue
                    with archive.open(member) as raw:
                        text = io.TextIOWrapper(raw, encoding="utf-8-sig", errors="replace", newline="")
                        reader = pd.read_csv(text, dtype=str, keep_default_na=False, chunksize=50_000, engine="c", quoting=csv.QUOTE_MINIMAL)
                        at = 0
                        for part in reader:
                            part = part.rename(columns=str.strip).reindex(columns=columns).astype(object)
                            part = part.where(part.notna(), None)
                            part.insert(0, "row_ix", range(at, at + len(part)))
                            part.insert(0, "feed", feed)
                            at += len(part)
                            yield part

    return archive_files(spark, path).select("feed", "content").repartition("feed").mapInPandas(rows, schema)


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    return files.withColumn("feed", F.regexp_extract("path", r"([^/]+)\.zip$", 1))


def gtfs_folder(spark: SparkSession, path: str, table: str, pattern: str | None = None) -> DataFrame:
    """One GTFS table of unpacked feeds at ``path/feed=<id>/<table>.txt``; columns go by each file's own header.

    Large files are read in ranges, quoted fields that span lines included (``records``); ``row_ix`` is the row's number in its
    file. ``pattern`` names the files where they are called otherwise.
    """
    columns = [c.split()[0] for c in S.GTFS[table].split(", ")]
    found = records(numbered_lines(spark, path, pattern or f"{table}.txt"))
    rows = headed_rows(found, columns)
    return rows.select(F.regexp_extract("file", "/feed=([^/]+)/", 1).alias("feed"), "row_ix", *columns)


def static_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.STATIC_FEED).json(path, multiLine=True).withColumnRenamed("id", "feed")


def realtime_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.REALTIME_FEED).json(path, multiLine=True).withColumnRenamed("id", "feed")


def region_features(spark: SparkSession, path: str) -> DataFrame:
    """``(region, polygons)`` of a boundary file; polygons and multi-polygons become one shape."""
    schema = "features array<struct<properties:struct<key:string>,geometry:struct<type:string,coordinates:string>>>"
    f = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    return polygons(f.select(F.col("f.properties.key").alias("region"), F.col("f.geometry.type").alias("geom_type"), F.col("f.geometry.coordinates").alias("coordinates")))


def polygons(rows: DataFrame) -> DataFrame:
    """``(region, polygons array<array<array<struct<lng,lat>>>>)`` from GeoJSON coordinate text."""
    ring = "array<array<double>>"
    multi = F.from_json("coordinates", f"array<array<{ring}>>")
    single = F.array(F.from_json("coordinates", f"array<{ring}>"))
    nested = F.when(F.col("geom_type") == "MultiPolygon", multi).otherwise(single)
    typed = F.transform(nested, lambda p: F.transform(p, lambda r: F.transform(r, lambda q: F.struct(q[0].alias("lng"), q[1].alias("lat")))))
    return rows.where(F.col("geom_type").isin("Polygon", "MultiPolygon")).select("region", typed.alias("polygons"))


def line_features(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Line features with typed properties and ``paths array<array<struct<lng,lat>>>``; one file or a folder of pages."""
    schema = f"features array<struct<id:string,geometry:struct<type:string,coordinates:string>,properties:struct<{properties}>>>"
    f = spark.read.schema(schema).json(path, multiLine=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode("features").alias("row_ix", "f"))
    line = F.array(F.from_json("f.geometry.coordinates", "array<array<double>>"))
    multi = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    nested = F.when(F.col("f.geometry.type") == "MultiLineString", multi).otherwise(line)
    typed = F.transform(nested, lambda r: F.transform(r, lambda q: F.struct(q[0].alias("lng"), q[1].alias("lat"))))
    return f.where(F.col("f.geometry.type").isin("LineString", "MultiLineString")).select(
        "file", "row_ix", F.col("f.id").alias("id"), F.col("f.geometry.type").alias("geom_type"), typed.alias("paths"), "f.properties.*"
    )


def source_counts(features: DataFrame) -> DataFrame:
    """Rows per file of a multi-file catalog."""
    return features.groupBy("file").agg(F.count(F.lit(1)).alias("routes"))


def explode_paths(features: DataFrame, key: str) -> DataFrame:
    """Long form ``(key, path_ix, ix, lng, lat)`` of features that hold their paths in the row."""
    return features.select(key, F.posexplode("paths").alias("path_ix", "pts")).select(
        key, "path_ix", F.posexplode("pts").alias("ix", "p")
    ).select(key, "path_ix", "ix", "p.lng", "p.lat")


def facilities_csv(spark: SparkSession, path: str) -> DataFrame:
    """Columns by header name, any others ignored."""
    raw = spark.read.option("header", True).csv(path)
    clean = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    return clean.select(*[F.coalesce(F.col(c.split()[0]), F.lit("")).alias(c.split()[0]) for c in S.AIRPORT.split(", ")])


def windows_1252(latin1: Column) -> Column:
    """Text of Windows-1252 bytes that were read as ISO-8859-1; only 0x80 to 0x9F differ."""
    pairs = [(chr(b), bytes([b]).decode("cp1252", errors="ignore")) for b in range(0x80, 0xA0)]
    pairs = [(a, b) for a, b in pairs if b]
    return F.translate(latin1, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))


def border_offices_csv(spark: SparkSession, path: str) -> DataFrame:
    names = {
        "Office Name": "office_name", "US port": "us_port", "Physical Address Province": "province", "Services": "services",
        "Travellers Hours Monday": "hours_weekday", "Travellers Hours Saturday": "hours_weekend", "Travellers Hours Seasonal": "seasonal",
        "Travellers Hours Notes": "notes",
    }
    raw = spark.read.option("header", True).option("encoding", "ISO-8859-1").option("multiLine", True).csv(path)
    return raw.select(*[F.coalesce(windows_1252(F.col(f"`{k}`")), F.lit("")).alias(v) for k, v in names.items()])


def station_map(stops: DataFrame) -> DataFrame:
    """Station coordinates, last row of a stop id wins. ``stops`` carries ``feed`` and ``row_ix``."""
    named = stops.select(
        "feed", F.col("stop_id").alias("stop"), "row_ix", F.coalesce(F.nullif("stop_name", F.lit("")), F.col("stop_id")).alias("name"),
        F.round(F.col("stop_lon").try_cast("double"), 6).alias("lng"), F.round(F.col("stop_lat").try_cast("double"), 6).alias("lat"),
    ).where(F.col("lng").isNotNull() & F.col("lat").isNotNull() & F.col("stop").isNotNull())
    return last_wins(named, ["feed", "stop"], ["row_ix"]).drop("row_ix")


def write_features(features: DataFrame, path: str, partition: Sequence[str] = ("grp",)) -> None:
    """Parquet by group; hot groups spread over many tasks because nothing is shuffled by it."""
    features.write.mode("overwrite").partitionBy(*partition).parquet(path)


def geojson_lines(features: DataFrame, paths: str | None = None) -> DataFrame:
    """One GeoJSON feature per row as text; ``paths`` names a column of nested points, else lng/lat make a point."""
    if paths is None:
        geometry = F.struct(F.lit("Point").alias("type"), F.array("lng", "lat").alias("coordinates"))
        rest = [c for c in features.columns if c not in ("lng", "lat")]
    else:
        lines = F.transform(paths, lambda p: F.transform(p, lambda q: F.array(q["lng"], q["lat"])))
        geometry = F.struct(F.lit("MultiLineString").alias("type"), lines.alias("coordinates"))
        rest = [c for c in features.columns if c != paths]
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*rest).alias("properties"))
    return features.select(F.to_json(feature).alias("feature"))


def write_metadata(metadata: DataFrame, path: str) -> None:
    metadata.coalesce(1).write.mode("overwrite").json(path)


def fingerprint_manifest(fingerprints: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Manifest rows and the ids that occur twice; a manifest may be written only when the second is empty."""
    counted = fingerprints.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max("sha").alias("sha"))
    return counted.where(F.col("n") == 1).select(key, "sha"), counted.where(F.col("n") > 1).select(key, "n")


def write_manifest(fingerprints: DataFrame, key: str, path: str) -> None:
    manifest, twice = fingerprint_manifest(fingerprints, key)
    if twice.limit(1).count():
        raise ValueError("duplicate ids cannot be audited")
    manifest.write.mode("overwrite").parquet(path)
