"""Quoted text tables read in byte ranges: records that span lines are found although each range is read on its own.

Spark reads the lines of a file range by range, and nobody knows whether a range begins inside a quoted field. So every line is
scanned for both cases: where it would end, outside or inside quotes, had it begun outside, and had it begun inside. Such a line either
keeps the state, swaps it, or sets it whatever it was. A running count of swaps and the last setting line before give the state of
every line of a range for either beginning, and one row per range; a scan over these rows tells how each range did begin.

Rules are those of the usual csv reader: a field is quoted if it begins with a quote, doubled quotes stand for one, what follows the
closing quote up to the comma belongs to the field, a quote elsewhere is text. Lines end with LF or CR LF; empty lines are no records. A
quote that is never closed makes one record of the rest of its file; more than ``MOST_LINES`` lines are reported and not put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from wayline.operators.ordered import OrderedScan
from wayline.session import cut_lineage

MOST_LINES = 100_000
_INSIDE = r'[^"]*+(?:""[^"]*+)*+'  # quoted text up to its closing quote
_FIELD = rf'(?:"{_INSIDE}"[^,]*+|[^,"][^,]*+|)'
_OPEN = rf'^(?:{_FIELD},)*+"{_INSIDE}\z'  # whole fields, then one that is not closed


def _ends_inside(line: Column, begins_inside: bool) -> Column:
    if not begins_inside:
        return line.rlike(_OPEN)
    rest = F.regexp_replace(line, rf'^{_INSIDE}"[^,]*+(?:,|\z)', "")
    return line.rlike(rf"^{_INSIDE}\z") | rest.rlike(_OPEN)


def numbered_lines(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(file, range, place, value): the lines of all files under ``path``; (range, place) is their order in a file."""
    reader = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    lines = reader.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("place"), "value",
    )
    mark = F.when(F.col("range") == 0, F.regexp_replace("value", "^﻿", "")).otherwise(F.col("value"))
    return cut_lineage(lines.withColumn("value", mark))  # places are those of one reading


def _resolved(order: str, out: str, into: str, upto: WindowSpec) -> tuple[Column, Column]:
    """State after each row of ``upto`` if the first one began outside, and if it began inside; ``_swaps`` is added to rows first."""
    sets = F.max(F.when(F.col(out) == F.col(into), F.struct(order, F.col(out).alias("to"), F.col("_swaps").alias("swaps")))).over(upto)
    settled = (sets["to"] + F.col("_swaps") - sets["swaps"]) % 2
    return F.coalesce(settled, F.col("_swaps") % 2), F.coalesce(settled, (F.col("_swaps") + 1) % 2)


def records(lines: DataFrame) -> DataFrame:
    """(file, record, text, lines): records of ``numbered_lines``, numbered from 0 per file; text is null for one of too many lines."""
    group = ["file", "range"]
    inside = Window.partitionBy(*group).orderBy("place")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swaps = lambda out, into: F.when((F.col(out) == 1) & (F.col(into) == 0), 1).otherwise(0)
    rows = lines.withColumns({"_out": _ends_inside(F.col("value"), False).cast("int"), "_in": _ends_inside(F.col("value"), True).cast("int")})
    rows = rows.repartition("file", "range").withColumn("_swaps", F.sum(swaps("_out", "_in")).over(upto))
    out, into = _resolved("place", "_out", "_in", upto)
    rows = rows.withColumns({"_out": out, "_in": into})  # from here on: after the line, by where its range began
    rows = rows.withColumns({"_bo": F.lag("_out", 1, 0).over(inside), "_bi": F.lag("_in", 1, 1).over(inside)})
    rows = rows.withColumns({"_no": F.sum((F.col("_bo") == 0).cast("bigint")).over(upto), "_ni": F.sum((F.col("_bi") == 0).cast("bigint")).over(upto)})
    # one row per range: where it ends and how many records it begins, for both cases
    ranges = rows.groupBy(*group).agg(F.max_by(F.struct("_out", "_in", "_no", "_ni"), "place").alias("e")).select(*group, "e.*")
    over = Window.partitionBy("file").orderBy("range")
    ranges = ranges.withColumn("_swaps", F.sum(swaps("_out", "_in")).over(over.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    end, _ = _resolved("range", "_out", "_in", over.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranges = ranges.withColumn("_end", end).withColumn("_begin", F.lag("_end", 1, 0).over(over))
    begun = F.when(F.col("_begin") == 0, F.col("_no")).otherwise(F.col("_ni"))
    ranges = ranges.withColumn("_offset", F.coalesce(F.sum(begun).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.join(ranges.select(*group, "_begin", "_offset"), group)
    pick = lambda o, i: F.when(F.col("_begin") == 0, F.col(o)).otherwise(F.col(i))
    rows = rows.select("file", (F.col("_offset") + pick("_no", "_ni")).alias("record"), *group[1:], "place", "value", (pick("_bo", "_bi") == 0).alias("_first"), pick("_out", "_in").alias("_after"))
    alone = rows.where("_first and _after = 0").select("file", "record", F.regexp_replace("value", r"\r\z", "").alias("text"), F.lit(1).cast("bigint").alias("lines"))
    spanning = rows.where("not (_first and _after = 0)")
    sizes = spanning.groupBy("file", "record").agg(F.count(F.lit(1)).alias("lines"))
    bounded = spanning.join(sizes.where(F.col("lines") <= MOST_LINES), ["file", "record"])
    joined = bounded.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("range", "place", "value"))).alias("parts"), F.max_by("_after", F.struct("range", "place")).alias("open"), F.first("lines").alias("lines"))
    text = F.array_join(F.transform("parts", lambda p: p["value"]), "\n")
    # a field that the file does not close ends with the file
    together = joined.select("file", "record", F.when(F.col("open") == 1, F.concat(text, F.lit('"'))).otherwise(F.regexp_replace(text, r"\r\z", "")).alias("text"), "lines")
    endless = sizes.where(F.col("lines") > MOST_LINES).select("file", "record", F.lit(None).cast("string").alias("text"), "lines")
    found = alone.unionByName(together).unionByName(endless).where("text is null or text <> ''")
    return found.withColumn("record", F.col("record") - 1)


def fields(text: Column) -> Column:
    """Values of a record."""
    def value(raw: Column) -> Column:
        bare = F.regexp_replace(raw, ",\\z", "")
        quoted = F.regexp_replace(F.regexp_extract(raw, rf'^"({_INSIDE})"', 1), '""', '"')
        return F.when(raw.startswith('"'), F.concat(quoted, F.regexp_extract(raw, rf'^"{_INSIDE}"([^,]*+),\z', 1))).otherwise(bare)

    return F.transform(F.regexp_extract_all(F.concat(text, F.lit(",")), F.lit(f"{_FIELD},"), F.lit(0)), value)


def headed_rows(found: DataFrame, columns: list[str]) -> DataFrame:
    """(file, row_ix, columns...): values by the names in each file's first record; rows are numbered from 0, empty values are null."""
    # the header is carried over the blocks of its file, so the records are put together and exchanged once: without other columns the scan shares it
    found = found.where(F.col("text").isNotNull()).select("file", "record", "text")
    scan = OrderedScan(found, ["file"], ["record"], F.floor(F.col("record") / 1_000_000))
    numbered = scan.extend(first={"_header": F.col("text"), "_head": F.col("record")}, position="_place").df.where(F.col("record") > F.col("_head"))
    body = numbered.withColumn("row_ix", F.col("_place") - 1).withColumn("names", F.transform(fields(F.col("_header")), lambda n: F.trim(n)))
    # the last of equal names wins, values without a name are dropped
    pairs = F.filter(F.arrays_zip(F.col("names").alias("k"), fields(F.col("text")).alias("v")), lambda p: p["k"].isNotNull())
    value = lambda c: F.nullif(F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter("_pairs", lambda p: p["k"] == c), lambda p: p["v"])), -1), F.lit(""))
    return body.withColumn("_pairs", pairs).select("file", "row_ix", *[value(c).alias(c) for c in columns])
