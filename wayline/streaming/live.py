"""Live counts, last positions and dead letters as streaming jobs.

A replayed micro-batch overwrites its own folder or is recognised by its number; no job collects to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wayline.operators.ordered import last_wins
from wayline.sources.messages import dead_letters, good, parse
from wayline.streaming.upserts import UpsertTable

MOST_BYTES = 1 << 30  # of files per micro-batch


def table_stream(spark: SparkSession, folder: str, table: str, schema: str) -> DataFrame:
    """A Parquet table as a file stream; a backlog is read in micro-batches of bounded size."""
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").option("maxBytesPerTrigger", MOST_BYTES).parquet(folder)


def _start(df: DataFrame, mode: str, step: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return df.writeStream.outputMode(mode).foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def versioned_sink(df: DataFrame, path: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Write every micro-batch to its own ``version`` folder; a retry replaces the same folder."""
    def step(batch: DataFrame, version: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={version}")

    return _start(df, mode, step, checkpoint)


def newest_version(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    return last_wins(spark.read.option("basePath", path).parquet(path), keys, ["version"]).drop("version")


def live_counts(fixes: DataFrame) -> DataFrame:
    """Running count per source and group."""
    return fixes.groupBy("source", "grp").agg(F.count(F.lit(1)).alias("n"))


def present_counts(positions: DataFrame, now_us: Column, within_s: float) -> DataFrame:
    """Entities per source and group whose newest position is at most ``within_s`` old; one row per entity goes in."""
    fresh = positions.where(F.col("ts_us") >= now_us - F.lit(int(within_s * 1_000_000)))
    return fresh.groupBy("source", "grp").agg(F.count(F.lit(1)).alias("n"))


def positions_table(spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str], schema: str) -> UpsertTable:
    """Last position per entity, whatever order the fixes come in; readers merge no more than the live keys and a few micro-batches."""
    return UpsertTable(spark, path, keys, order, schema)


def deduped(fixes: DataFrame, keys: Sequence[str], at: str, within: str) -> DataFrame:
    """Fixes that arrive again within ``within`` of event time are one; the state holds the keys of that time and no more.

    Fixes later than that are dropped, and counted (``dropped_late``).
    """
    return fixes.withWatermark(at, within).dropDuplicatesWithinWatermark(list(keys))


def dropped_late(query: StreamingQuery) -> int:
    """Rows that the query's last run dropped because they came after the watermark."""
    return sum(int(o["numRowsDroppedByWatermark"]) for p in query.recentProgress for o in p["stateOperators"])


def state_rows(query: StreamingQuery) -> int:
    """Rows that the query's state held at the end of its last run."""
    return sum(int(o["numRowsTotal"]) for p in query.recentProgress[-1:] for o in p["stateOperators"])


def split_malformed(messages: DataFrame, schema: str, path: str, checkpoint: str) -> StreamingQuery:
    """Parsed rows to ``path/good``, text that does not parse to ``path/dead``; the stream goes on."""
    def step(batch: DataFrame, version: int) -> None:
        parsed = parse(batch, schema)
        good(parsed).write.mode("overwrite").parquet(f"{path}/good/version={version}")
        dead_letters(parsed).write.mode("overwrite").parquet(f"{path}/dead/version={version}")

    return _start(messages, "append", step, checkpoint)
