"""File sources read for real: files are written from the given tables into the session's shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline import schemas as S
from wayline.plans.base import query, table, with_ctes
from wayline.session import scratch_folder
from wayline.sources import files as L


def run_folder(spark: SparkSession) -> str:
    return f"{scratch_folder(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


ROWS_PER_FILE = 2_000


def write_files(lines: DataFrame, path: str, by: str) -> None:
    """Text files under ``path``, one folder per value of ``by``, from a column ``value``; ``ord`` orders the lines of a file."""
    lines.repartition(by).sortWithinPartitions(by, "ord").select(by, "value").write.partitionBy(by).text(path)


def quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(c.cast("string"), '"', '""'), F.lit('"'))


def csv_files(rows: DataFrame, columns: dict[str, Column], path: str, order: Column, by: Column, name: str = "feed", mark: str = "", end: str = "") -> None:
    """Files of bounded size, each with its own header."""
    body = rows.select(by.alias(name), F.concat_ws(",", *columns.values()).alias("value"), order.cast("long").alias("ord"))
    header = body.select(name).distinct().select(name, F.lit(mark + ",".join(columns)).alias("value"), F.lit(-1).cast("long").alias("ord"))
    write_files(header.unionByName(body).withColumn("value", F.concat("value", F.lit(end))), path, name)


def registry_files(rows: DataFrame, entry: Column, order: Column, path: str) -> None:
    """JSON arrays with an object per line, in files of bounded size."""
    by = F.floor(order / ROWS_PER_FILE).alias("part")
    body = rows.select(by, F.concat(F.lit(","), F.to_json(entry)).alias("value"), order.cast("long").alias("ord"))
    edge = lambda text, at: body.select("part").distinct().select("part", F.lit(text).alias("value"), F.lit(at).cast("long").alias("ord"))
    write_files(edge("[{}", -1).unionByName(body).unionByName(edge("]", 1 << 60)), path, "part")


def feed_of(k: Column) -> Column:
    return F.concat(F.when(k % 2 == 0, "even").otherwise("odd"), F.floor(k / ROWS_PER_FILE).cast("string"))


FEED = f"CASE k % 2 WHEN 0 THEN 'even' ELSE 'odd' END || (k // {ROWS_PER_FILE})"


@query("SRC01", with_ctes(f"s AS (SELECT s_suppkey AS k, s_name AS name, {FEED.replace('k ', 's_suppkey ')} AS feed FROM supplier)", """
SELECT feed, CAST(k AS VARCHAR) AS stop_id, CASE WHEN k % 2 = 0 THEN name || ', "A"' ELSE NULL END AS stop_name, CAST(k AS VARCHAR) AS stop_lat,
 row_number() OVER (PARTITION BY feed ORDER BY k) AS nth FROM s"""))
def gtfs_files_of_two_headers(spark, sf):
    """Feeds whose headers differ in order and columns; some have a byte-order mark, some lack a table."""
    folder, s = run_folder(spark), table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    even, odd = s.where(k % 2 == 0), s.where(k % 2 == 1)
    csv_files(even, {"stop_lat": k.cast("string"), "stop_id": quoted(k), "stop_name": quoted(F.concat("s_name", F.lit(', "A"')))}, f"{folder}/stops/a", k, feed_of(k), mark="\ufeff")
    csv_files(odd, {"stop_id": k.cast("string"), "other": F.lit("x"), "stop_lat": quoted(k)}, f"{folder}/stops/b", k, feed_of(k))
    csv_files(odd, {"route_id": k.cast("string")}, f"{folder}/routes", k, feed_of(k))
    rows = L.gtfs_folder(spark, f"{folder}/stops", "stops", "*.txt")
    return rows.select("feed", "stop_id", "stop_name", "stop_lat", (F.col("row_ix") + 1).alias("nth"))


@query("SRC01", with_ctes(f"d AS (SELECT doc_id AS k, text, {FEED.replace('k ', 'doc_id ')} AS feed FROM documents)", """
SELECT feed, CAST(k AS VARCHAR) AS stop_id, nullif(text, '') AS stop_name, CAST(length(coalesce(text, '')) AS VARCHAR) AS stop_code, row_number() OVER (PARTITION BY feed ORDER BY k) - 1 AS row_ix FROM d"""))
def gtfs_names_over_lines(spark, sf):
    """Whole texts as quoted names: commas, quotes and line ends in a field, CR LF at the end of every record."""
    folder, d = run_folder(spark), table(spark, sf, "documents")
    k, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    csv_files(d, {"stop_code": F.length(text).cast("string"), "stop_name": quoted(text), "stop_id": k.cast("string")}, f"{folder}/stops", k, feed_of(k), end="\r")
    return L.gtfs_folder(spark, f"{folder}/stops", "stops", "*.txt").select("feed", "stop_id", "stop_name", "stop_code", "row_ix")


@query("SRC03", "SELECT 'f' || s_suppkey AS feed, s_name AS agency, CASE WHEN s_suppkey % 3 = 0 THEN 'ct,ma' ELSE 'vt' END AS states, s_suppkey % 4 = 0 AS shape_only, CASE WHEN s_suppkey % 5 = 0 THEN 3 END AS route_type_override FROM supplier")
def static_registry_file(spark, sf):
    k = F.col("s_suppkey")
    states = F.when(k % 3 == 0, F.array(F.lit("ct"), F.lit("ma"))).otherwise(F.array(F.lit("vt")))
    entry = F.struct(F.concat(F.lit("f"), k).alias("id"), F.col("s_name").alias("agency"), states.alias("states"), (k % 4 == 0).alias("shape_only"), F.when(k % 5 == 0, 3).alias("route_type_override"))
    path = f"{run_folder(spark)}/registry"
    registry_files(table(spark, sf, "supplier"), entry, k, path)
    read = L.static_registry(spark, path).where(F.col("feed").isNotNull())
    return read.select("feed", "agency", F.array_join("states", ",").alias("states"), "shape_only", "route_type_override")


@query("SRC04", "SELECT 'r' || s_suppkey AS feed, s_name AS agency, s_suppkey % 2 = 0 AS has_key FROM supplier")
def realtime_registry_file(spark, sf):
    k = F.col("s_suppkey")
    entry = F.struct(F.concat(F.lit("r"), k).alias("id"), F.col("s_name").alias("agency"), F.when(k % 2 == 0, F.lit("key")).alias("authorization"))
    path = f"{run_folder(spark)}/registry"
    registry_files(table(spark, sf, "supplier"), entry, k, path)
    return L.realtime_registry(spark, path).where(F.col("feed").isNotNull()).select("feed", "agency", F.col("authorization").isNotNull().alias("has_key"))


@query("SRC17", "SELECT CAST(p_partkey AS VARCHAR) AS ident, p_name AS name FROM part")
def facilities_file(spark, sf):
    """A directory with a byte-order mark, other columns and another order."""
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    columns = [c.split()[0] for c in S.AIRPORT.split(", ")]
    path = f"{run_folder(spark)}/airports"
    given = {"unused": F.lit("u"), **{c: F.lit("") for c in reversed(columns)}}
    given[columns[0]], given[columns[1]] = k.cast("string"), quoted(F.col("p_name"))
    csv_files(p, given, path, k, F.floor(k / ROWS_PER_FILE), name="part", mark="\ufeff")
    rows = L.facilities_csv(spark, path)
    return rows.select(F.col(columns[0]).alias("ident"), F.col(columns[1]).alias("name"))
