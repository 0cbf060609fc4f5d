"""Whole snapshots that arrive in pieces: polls of a source collected over micro-batches, fenced, compared and held.

A poll is a numbered request of a source. Its rows may arrive in several micro-batches and in any order; a mark says how many rows it has
(``end``) or that it failed (``fail``). A poll counts once all its rows are there. Then it is compared with the poll that counted before it,
becomes the current snapshot, and fences what is older: answers to earlier requests are dropped, finished or not. While polls fail,
the last good one is served for a limited time and its rows age.

Nothing of a poll sits in memory: open polls, current snapshots and the newest number per source are rows of one ``UpsertTable``, so
that one manifest switches all of them at once; each micro-batch settles its polls with joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wayline import fixed_values as V
from wayline.operators.ordered import last_wins
from wayline.operators.snapshots import hold_last_good, snapshot_diff
from wayline.session import cut_lineage
from wayline.streaming.upserts import UpsertTable, query_of

#: mark is ``row``, ``end`` (with the number of rows in n) or ``fail``; at_us is the time of the poll
EVENTS = "source string, poll bigint, mark string, entity string, lng double, lat double, at_us bigint, n bigint"
_STATE = f"kind string, slot bigint, {EVENTS}, gone boolean"
_KEY = ["kind", "source", "slot", "entity"]


class PollTable:
    def __init__(self, spark: SparkSession, path: str, hold_s: float = V.LAST_GOOD_HOLD_S, **table: int):
        self.spark, self.path, self.hold_s = spark, path.rstrip("/"), hold_s
        self.table = UpsertTable(spark, f"{self.path}/state", _KEY, ["_version"], _STATE, deleted="gone", **table)

    def start(self, events: DataFrame, checkpoint: str) -> StreamingQuery:
        def step(batch: DataFrame, number: int) -> None:
            self.settle(batch, query_of(batch), number)

        return events.writeStream.outputMode("append").foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def settle(self, events: DataFrame, query: str, number: int) -> None:
        """One micro-batch. Results are written before the state is switched, under the number of the micro-batch, so that it may run again."""
        if self.table.published(query, number):
            return
        columns = EVENTS.replace(",", "").split()[::2]
        state = cut_lineage(self.table.read())
        newest = state.where("kind = 'newest'").select("source", F.col("poll").alias("newest"), F.col("at_us").alias("newest_at"))
        arrived = events.select(*columns).where("source is not null and poll is not null").join(newest, "source", "left").where("newest is null or poll > newest")
        arrived = arrived.withColumn("kind", F.when(F.col("mark") == "row", "row").otherwise("mark")).withColumn("entity", F.coalesce("entity", F.lit("")))
        # a repeated row of a poll is one row; of an entity that comes twice, one of its positions
        open_rows = state.where("kind in ('row', 'mark')").select("kind", *columns).unionByName(arrived.select("kind", *columns))
        open_rows = cut_lineage(last_wins(open_rows, ["kind", "source", "poll", "entity"], ["at_us", "mark", "lng", "lat", "n"]))

        counts = open_rows.groupBy("source", "poll").agg(
            F.count_if(F.col("kind") == "row").alias("rows"), F.max(F.when(F.col("mark") == "end", F.col("n"))).alias("n"),
            F.max(F.when(F.col("mark") == "end", F.col("at_us"))).alias("end_at"), F.max(F.when(F.col("mark") == "fail", F.col("at_us"))).alias("fail_at"),
        )
        ok = F.coalesce(F.col("rows") >= F.col("n"), F.lit(False))
        settled = counts.where(ok | F.col("fail_at").isNotNull()).select("source", "poll", ok.alias("ok"), F.when(ok, F.col("end_at")).otherwise(F.col("fail_at")).alias("at_us"))
        settled = cut_lineage(settled)  # one row per poll
        good = settled.where("ok").select("source", "poll", "at_us")
        now = good.groupBy("source").agg(F.max("poll").alias("now"), F.max_by("at_us", "poll").alias("now_at"))

        self._changes(state, newest, open_rows, good).write.mode("overwrite").parquet(f"{self.path}/changes/batch={number}")
        known = newest.select("source", F.col("newest_at").alias("ts_us"), F.lit(True).alias("ok"), F.lit(True).alias("before"))
        polls = settled.select("source", F.col("at_us").alias("ts_us"), "ok", F.lit(False).alias("before"))
        served = hold_last_good(polls.unionByName(known), self.hold_s).where("not before").drop("before")
        served.write.mode("overwrite").parquet(f"{self.path}/served/batch={number}")

        kept = open_rows.join(settled.select("source", "poll", F.lit(True).alias("done")), ["source", "poll"], "left").join(now, "source", "left")
        over = F.col("done").isNotNull() | F.coalesce(F.col("poll") <= F.col("now"), F.lit(False))
        opened = kept.select("kind", F.col("poll").alias("slot"), *columns, over.alias("gone"))
        snapshot = open_rows.where("kind = 'row'").join(now.select("source", F.col("now").alias("poll")), ["source", "poll"], "left_semi")
        current = snapshot.select(F.lit("current").alias("kind"), F.lit(0).cast("bigint").alias("slot"), *columns, F.lit(False).alias("gone"))
        left = state.where("kind = 'current'").join(now, "source", "left_semi").join(snapshot, ["source", "entity"], "left_anti")
        left = left.select("kind", "slot", *columns, F.lit(True).alias("gone"))
        numbers = now.select(F.lit("newest").alias("kind"), F.lit(0).cast("bigint").alias("slot"), "source", F.col("now").alias("poll"), F.lit("").alias("entity"), F.col("now_at").alias("at_us"), F.lit(False).alias("gone"))
        following = opened.unionByName(current).unionByName(left).unionByName(numbers, allowMissingColumns=True)
        self.table.write(following.select("kind", "slot", *columns, "gone"), query, number)

    @staticmethod
    def _changes(state: DataFrame, newest: DataFrame, open_rows: DataFrame, good: DataFrame) -> DataFrame:
        """Every poll that now counts against the one before it, also where a poll has no rows."""
        position = ["source", "poll", "entity", "lng", "lat"]
        after = open_rows.where("kind = 'row'").join(good, ["source", "poll"], "left_semi").select(*position)
        index = good.select("source", "poll").unionByName(newest.select("source", F.col("newest").alias("poll")))
        follows = index.withColumn("next", F.lead("poll").over(Window.partitionBy("source").orderBy("poll"))).where("next is not null")  # a row per poll
        before = state.where("kind = 'current'").select(*position).unionByName(after)
        before = before.join(follows, ["source", "poll"]).withColumn("poll", F.col("next")).drop("next")
        return snapshot_diff(before, after, ["source", "poll", "entity"])

    def _results(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(f"{schema}, batch int").parquet(f"{self.path}/{name}").drop("batch")

    def changes(self) -> DataFrame:
        """(source, poll, entity, change) of every poll that counted."""
        return self._results("changes", "source string, poll bigint, entity string, change string")

    def served(self) -> DataFrame:
        """(source, ts_us, ok, served, served_us) of every poll: what answered it."""
        return self._results("served", "source string, ts_us bigint, ok boolean, served_us bigint, served string")

    def current(self) -> DataFrame:
        """Rows of the newest poll of every source."""
        return self.table.read().where("kind = 'current'").select("source", "poll", "entity", "lng", "lat", "at_us")

    def aged(self, now_us: Column, stale_s: float) -> DataFrame:
        """The current rows as they are shown at ``now_us``: gone once their poll is older than the hold, stale beyond ``stale_s``."""
        age = now_us - F.col("at_us")
        return self.current().where(age <= F.lit(self.hold_s * 1e6)).withColumn("stale", age > F.lit(stale_s * 1e6))


def poll_events(rows: DataFrame, at_us: Column, keep: Sequence[str] = ()) -> DataFrame:
    """Events of complete polls (source, poll, entity, lng, lat): a row each, and an end mark per poll with its number of rows."""
    typed = rows.select("source", "poll", F.lit("row").alias("mark"), F.col("entity").cast("string").alias("entity"), "lng", "lat", at_us.alias("at_us"), F.lit(None).cast("bigint").alias("n"), *keep)
    none = F.lit(None).cast("double")
    ends = typed.groupBy("source", "poll").agg(F.count(F.lit(1)).alias("n"), F.max("at_us").alias("at_us"), *[F.min(k).alias(k) for k in keep])
    return typed.unionByName(ends.select("source", "poll", F.lit("end").alias("mark"), F.lit(None).cast("string").alias("entity"), none.alias("lng"), none.alias("lat"), "at_us", "n", *keep))
