"""Polled snapshots: latest rows, differences, held results, feed status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline import fixed_values as V
from wayline.operators.ordered import OrderedScan


def snapshot_diff(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Class of every entity of two snapshots: new, moved, same, gone."""
    old = before.select(*keys, F.col("lng").alias("old_lng"), F.col("lat").alias("old_lat"))
    joined = old.join(after.select(*keys, "lng", "lat"), list(keys), "full_outer")
    same = (F.col("old_lng") == F.col("lng")) & (F.col("old_lat") == F.col("lat"))
    kind = (
        F.when(F.col("lng").isNull(), "gone").when(F.col("old_lng").isNull(), "new").when(same, "same").otherwise("moved")
    )
    return joined.withColumn("change", kind)


def consecutive_diffs(polls: DataFrame, source: str = "source", entity: str = "entity", poll: str = "poll") -> DataFrame:
    """Snapshot difference of every poll against the source's poll before it, whatever numbers were skipped between."""
    index = polls.select(source, poll).distinct()
    following = F.lead(poll).over(Window.partitionBy(source).orderBy(poll))  # a row per poll, not per entity
    nxt = index.select(source, poll, following.alias("_after")).where(F.col("_after").isNotNull())
    before = polls.join(nxt, [source, poll]).withColumn(poll, F.col("_after")).drop("_after")
    return snapshot_diff(before, polls, [source, poll, entity])


def hold_last_good(polls: DataFrame, hold_s: float = V.LAST_GOOD_HOLD_S, chunk: Column | None = None) -> DataFrame:
    """Which poll answers each poll: itself if good, else the last good one within ``hold_s``.

    ``polls(source, ts_us, ok)``; adds ``served_us`` (null when nothing can be served) and ``served``.
    """
    by_hour = F.floor(F.col("ts_us") / F.lit(3_600_000_000)).cast("bigint") if chunk is None else chunk
    scan = OrderedScan(polls, ["source"], ["ts_us"], by_hour).extend(running_max={"good_us": F.when(F.col("ok"), F.col("ts_us"))})
    age_s = (F.col("ts_us") - F.col("good_us")) / F.lit(1e6)
    served = F.when(age_s <= hold_s, F.col("good_us"))
    state = F.when(F.col("ok"), "live").when(served.isNotNull(), "last-good").otherwise("unavailable")
    return scan.df.withColumns({"served_us": served, "served": state}).drop("good_us")


def newest_generation(rows: DataFrame, source: str = "source", seq: str = "seq") -> DataFrame:
    """Keep rows of the newest request per source; answers to older requests are dropped."""
    newest = rows.groupBy(source).agg(F.max(seq).alias(seq))
    return rows.join(newest, [source, seq], "left_semi")


def failover(attempts: DataFrame, keys: Sequence[str] = ("poll", "probe")) -> DataFrame:
    """First successful provider per probe; a probe that every provider failed keeps null.

    ``attempts(…keys, priority, provider, ok, payload)``.
    """
    good = F.when(F.col("ok"), F.col("priority"))
    return attempts.groupBy(*keys).agg(
        F.min_by(F.struct("provider", "payload", "priority"), good).alias("win"), F.count_if(~F.col("ok")).alias("failures")
    ).select(*keys, "win.provider", "win.payload", "win.priority", "failures")


def probe_summary(results: DataFrame, poll: str = "poll", probe: str = "probe") -> DataFrame:
    """Failed probes and provider line (distinct, in probe order) per poll."""
    counts = results.groupBy(poll).agg(
        F.count(F.lit(1)).alias("probes"), F.count_if(F.col("provider").isNull()).alias("failed_probes")
    )
    firsts = results.where(F.col("provider").isNotNull()).groupBy(poll, "provider").agg(F.min(probe).alias("at"))
    line = firsts.groupBy(poll).agg(F.array_sort(F.collect_list(F.struct("at", "provider"))).alias("p")).select(
        poll, F.array_join(F.transform("p", lambda s: s["provider"]), " + ").alias("providers")
    )
    return counts.join(line, poll, "left").withColumn("providers", F.coalesce("providers", F.lit("")))


def feed_status(registry: DataFrame, results: DataFrame, rows: DataFrame) -> DataFrame:
    """State and row count of every registered feed.

    ``registry(feed, agency, needs_key, has_key)``, ``results(feed, ok)``, ``rows(feed, …)``.
    """
    counts = rows.groupBy("feed").agg(F.count(F.lit(1)).alias("n"))
    state = (
        F.when(F.col("needs_key") & ~F.col("has_key"), "needs-key").when(F.coalesce("ok", F.lit(False)), "live").otherwise("error")
    )
    joined = registry.join(results, "feed", "left").join(counts, "feed", "left").withColumn("state", state)
    return joined.select("feed", "agency", "state", F.when(F.col("state") == "live", F.coalesce("n", F.lit(0))).otherwise(0).cast("bigint").alias("count"))


def feeds_of_region(registry: DataFrame, region: str) -> DataFrame:
    if region == "boston":
        return registry.where(F.lit(False))
    if region == "new-england":
        return registry
    return registry.where(F.array_contains("states", region))


def serves_estimates(region: Column) -> Column:
    return region.isin("ct", "new-england")
