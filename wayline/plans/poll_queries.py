"""Polled snapshots, failover, held results and feed status."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayline.operators import snapshots as N
from wayline.operators.ordered import last_wins
from wayline.plans.base import FIX, fixes, query, table, with_ctes

POLL = "poll AS (SELECT *, (ts_us - 1704067200000000) // 86400000000 AS poll FROM fix)"


def polls(spark, sf):
    """Daily polls: the newest position of every entity of a day."""
    f = fixes(spark, sf).withColumn("poll", F.floor((F.col("ts_us") - F.lit(1704067200000000)) / 86_400_000_000).cast("bigint"))
    newest = last_wins(f.select("source", "entity", "poll", "ts_us", "id", "lng", "lat"), ["source", "entity", "poll"], ["ts_us", "id"])
    return newest.select("source", "poll", "entity", F.round("lng", 0).alias("lng"), F.round("lat", 0).alias("lat"))


SNAP = """snap AS (SELECT source, entity, poll, round(lng) AS lng, round(lat) AS lat FROM poll QUALIFY row_number() OVER (PARTITION BY source, entity, poll ORDER BY ts_us DESC, id DESC) = 1),
nxt AS (SELECT source, poll, lead(poll) OVER (PARTITION BY source ORDER BY poll) AS after FROM (SELECT DISTINCT source, poll FROM snap)),
bef AS (SELECT s.source, s.entity, n.after AS poll, s.lng AS ol, s.lat AS oa FROM snap s JOIN nxt n ON n.source = s.source AND n.poll = s.poll WHERE n.after IS NOT NULL)"""


@query("SS03 WN09", with_ctes(FIX, POLL, SNAP, """
SELECT source, poll, entity, CASE WHEN n.lng IS NULL THEN 'gone' WHEN b.ol IS NULL THEN 'new' WHEN b.ol = n.lng AND b.oa = n.lat THEN 'same' ELSE 'moved' END AS change
FROM bef b FULL OUTER JOIN snap n USING (source, poll, entity)"""))
def snapshot_diff(spark, sf):
    return N.consecutive_diffs(polls(spark, sf)).select("source", "poll", "entity", "change")


@query("SS03 WN09", with_ctes(FIX, POLL, SNAP.replace("ts_us DESC, id DESC) = 1)", "ts_us DESC, id DESC) = 1 AND poll % 3 != 1)"), """
SELECT source, poll, entity, CASE WHEN n.lng IS NULL THEN 'gone' WHEN b.ol IS NULL THEN 'new' WHEN b.ol = n.lng AND b.oa = n.lat THEN 'same' ELSE 'moved' END AS change
FROM bef b FULL OUTER JOIN snap n USING (source, poll, entity)"""))
def snapshot_diff_skipped_polls(spark, sf):
    """Every third poll is missing: differences go to the poll before the gap."""
    return N.consecutive_diffs(polls(spark, sf).where(F.col("poll") % 3 != 1)).select("source", "poll", "entity", "change")


@query("SS04", with_ctes(FIX, "p AS (SELECT source, ts_us, min(grp) != 'error' AS ok FROM fix GROUP BY source, ts_us)", """
SELECT source, ts_us, CASE WHEN ok THEN 'live' WHEN ts_us - good <= 7200000000 THEN 'last-good' ELSE 'unavailable' END AS served, CASE WHEN ts_us - good <= 7200000000 THEN good END AS served_us
FROM (SELECT *, max(CASE WHEN ok THEN ts_us END) OVER (PARTITION BY source ORDER BY ts_us) AS good FROM p)"""))
def last_good(spark, sf):
    p = fixes(spark, sf).groupBy("source", "ts_us").agg((F.min("grp") != "error").alias("ok"))
    return N.hold_last_good(p, hold_s=7200).select("source", "ts_us", "served", "served_us")


@query("SS05 PRJ20", with_ctes(FIX, "p AS (SELECT source, ts_us, min(grp) != 'error' AS ok FROM fix GROUP BY source, ts_us)", """
SELECT source, count(*) AS held, count(*) FILTER (WHERE ts_us - good > 300000000) AS stale
FROM (SELECT *, max(CASE WHEN ok THEN ts_us END) OVER (PARTITION BY source ORDER BY ts_us) AS good FROM p) WHERE NOT ok AND good IS NOT NULL GROUP BY source"""))
def retained_rows(spark, sf):
    """Rows held through failed polls age by the time of their last success."""
    p = fixes(spark, sf).groupBy("source", "ts_us").agg((F.min("grp") != "error").alias("ok"))
    held = N.hold_last_good(p, hold_s=float("inf")).where((~F.col("ok")) & F.col("served_us").isNotNull())
    return held.groupBy("source").agg(F.count(F.lit(1)).alias("held"), F.count_if(F.col("ts_us") - F.col("served_us") > 300_000_000).alias("stale"))


@query("SS06", with_ctes("d AS (SELECT source, doc_id % 7 AS seq, doc_id FROM documents)", "SELECT source, seq, doc_id FROM d WHERE seq = (SELECT max(seq) FROM d x WHERE x.source = d.source)"))
def newest_generation(spark, sf):
    d = table(spark, sf, "documents").select("source", (F.col("doc_id") % 7).alias("seq"), "doc_id")
    return N.newest_generation(d)


ATT = """att AS (SELECT o_orderkey // 4 AS poll, o_orderkey % 4 AS probe, CASE l_linenumber % 2 WHEN 0 THEN 'backup' ELSE 'main' END AS provider, 1 - l_linenumber % 2 AS priority,
 min(l_suppkey) AS payload, min(l_partkey) % 3 != 0 AS ok FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
best AS (SELECT poll, probe, min(priority) FILTER (WHERE ok) AS pr, count(*) FILTER (WHERE NOT ok) AS failures FROM att GROUP BY poll, probe),
res AS (SELECT b.poll, b.probe, a.provider, a.payload, b.failures FROM best b LEFT JOIN att a ON a.poll = b.poll AND a.probe = b.probe AND a.priority = b.pr)"""


def attempts(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").cast("bigint").alias("line"))
    odd = F.col("line") % 2
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return li.join(o, "l_orderkey", "left_semi").groupBy(
        F.floor(F.col("l_orderkey") / 4).cast("bigint").alias("poll"), (F.col("l_orderkey") % 4).alias("probe"),
        F.when(odd == 0, "backup").otherwise("main").alias("provider"), (1 - odd).alias("priority"),
    ).agg(F.min("l_suppkey").alias("payload"), (F.min("l_partkey") % 3 != 0).alias("ok"))


@query("JN23", with_ctes(ATT, "SELECT * FROM res"))
def failover(spark, sf):
    return N.failover(attempts(spark, sf)).drop("priority")


@query("AG19 AG22", with_ctes(ATT, """, f AS (SELECT poll, provider, min(probe) AS fp FROM res WHERE provider IS NOT NULL GROUP BY poll, provider)
SELECT poll, count(*) AS probes, count(*) FILTER (WHERE provider IS NULL) AS failed_probes,
 coalesce((SELECT string_agg(provider, ' + ' ORDER BY fp, provider) FROM f WHERE f.poll = res.poll), '') AS providers FROM res GROUP BY poll""").replace("\n, f AS", ", f AS"))
def probe_summary(spark, sf):
    return N.probe_summary(N.failover(attempts(spark, sf)))


@query("JN22 AG07", with_ctes("""reg AS (SELECT CAST(s_suppkey AS VARCHAR) AS feed, s_name AS agency, s_suppkey % 5 = 0 AS needs_key, s_suppkey % 10 = 0 AS has_key, s_suppkey FROM supplier),
cnt AS (SELECT CAST(l_suppkey AS VARCHAR) AS feed, count(*) AS n FROM lineitem GROUP BY 1)""", """
SELECT feed, agency, CASE WHEN needs_key AND NOT has_key THEN 'needs-key' WHEN s_suppkey % 7 != 3 THEN 'live' ELSE 'error' END AS state,
 CASE WHEN NOT (needs_key AND NOT has_key) AND s_suppkey % 7 != 3 THEN coalesce(n, 0) ELSE 0 END AS count FROM reg LEFT JOIN cnt USING (feed)"""))
def feed_status(spark, sf):
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    registry = s.select(k.cast("string").alias("feed"), F.col("s_name").alias("agency"), (k % 5 == 0).alias("needs_key"), (k % 10 == 0).alias("has_key"))
    results = s.where(k % 7 != 5).select(k.cast("string").alias("feed"), (k % 7 != 3).alias("ok")).unionByName(
        s.where(k % 7 == 5).select(k.cast("string").alias("feed"), F.lit(True).alias("ok"))
    )
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("feed"))
    return N.feed_status(registry, results, rows)


@query("JN17 SRC04", """SELECT s_suppkey AS feed, 'ct' AS region FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey, 'new-england' FROM supplier""")
def region_feeds(spark, sf):
    k = F.col("s_suppkey")
    states = F.when(k % 3 == 0, F.array(F.lit("ct"), F.lit("ma"))).otherwise(F.array(F.lit("vt")))
    registry = table(spark, sf, "supplier").select(k.alias("feed"), states.alias("states"))
    parts = [N.feeds_of_region(registry, r).select("feed", F.lit(r).alias("region")) for r in ("ct", "new-england", "boston")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
