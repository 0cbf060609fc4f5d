"""As-of joins of fixes, errors and polls."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayline.operators.asof import asof_join
from wayline.plans.base import FIX, fixes, query, with_ctes

KIND = "{0} AS (SELECT entity, ts_us, max(id) AS id FROM fix WHERE grp = '{1}' GROUP BY entity, ts_us)"
DAY_US = 86_400_000_000


def _marks(spark, sf, grp, name):
    f = fixes(spark, sf).where(F.col("grp") == grp)
    return f.select("entity", F.col("ts_us").alias(f"{name}_us"), F.col("id").alias(f"{name}_id"))


@query("JN09 WN09", with_ctes(FIX, KIND.format("err", "error"), """
SELECT f.id, f.entity, f.ts_us, CASE WHEN f.ts_us - e.ts_us <= 86400000000 THEN e.ts_us END AS error_us, CASE WHEN f.ts_us - e.ts_us <= 86400000000 THEN e.id END AS error_id
FROM fix f ASOF LEFT JOIN err e ON f.entity = e.entity AND f.ts_us >= e.ts_us"""))
def asof_last_error(spark, sf):
    """Every fix with the last error of its entity, itself included, up to a day back."""
    f = fixes(spark, sf).select("id", "entity", "ts_us")
    return asof_join(f, _marks(spark, sf, "error", "error"), ["entity"], "ts_us", right_on="error_us", tolerance=DAY_US, ties=["error_id"])


@query("JN09", with_ctes(FIX, KIND.format("buy", "purchase"), """
SELECT f.id, f.entity, f.ts_us, b.ts_us AS purchase_us, b.id AS purchase_id FROM fix f ASOF JOIN buy b ON f.entity = b.entity AND f.ts_us < b.ts_us WHERE f.grp = 'click'"""))
def asof_next_purchase(spark, sf):
    """Clicks with the next later purchase of their entity; clicks without one drop out."""
    f = fixes(spark, sf).where("grp = 'click'").select("id", "entity", "ts_us")
    return asof_join(f, _marks(spark, sf, "purchase", "purchase"), ["entity"], "ts_us", right_on="purchase_us", direction="forward", exact=False, how="inner", ties=["purchase_id"])


@query("JN09", with_ctes(FIX, KIND.format("err", "error"), """, b AS (SELECT f.id, f.entity, f.ts_us, e.ts_us AS before_us, e.id AS before_id FROM fix f ASOF LEFT JOIN err e ON f.entity = e.entity AND f.ts_us > e.ts_us),
x AS (SELECT b.*, e.ts_us AS after_us, e.id AS after_id, coalesce(e.ts_us - b.ts_us < b.ts_us - before_us, e.ts_us IS NOT NULL) AS later FROM b ASOF LEFT JOIN err e ON b.entity = e.entity AND b.ts_us < e.ts_us)
SELECT id, entity, ts_us, CASE WHEN later THEN after_us ELSE before_us END AS error_us, CASE WHEN later THEN after_id ELSE before_id END AS error_id FROM x""").replace("\n, b AS", ", b AS"))
def asof_nearest_other_error(spark, sf):
    """Every fix with the nearest error of its entity at another instant, the earlier one where two are as near."""
    f = fixes(spark, sf).select("id", "entity", "ts_us")
    return asof_join(f, _marks(spark, sf, "error", "error"), ["entity"], "ts_us", right_on="error_us", direction="nearest", exact=False, ties=["error_id"])


POLL_OK = "p AS (SELECT source, ts_us, min(grp) != 'error' AS ok FROM fix GROUP BY source, ts_us)"


@query("JN09 SS04 SS05 PRJ20", with_ctes(FIX, POLL_OK, """
SELECT source, ts_us, good AS served_us, ts_us - good > 300000000 AS stale
FROM (SELECT *, max(CASE WHEN ok THEN ts_us END) OVER (PARTITION BY source ORDER BY ts_us) AS good FROM p) WHERE NOT ok AND ts_us - good <= 7200000000"""))
def asof_retained_polls(spark, sf):
    """Failed polls answered by the last good one of their source within two hours, aged by its time."""
    p = fixes(spark, sf).groupBy("source", "ts_us").agg((F.min("grp") != "error").alias("ok"))
    good = p.where("ok").select("source", F.col("ts_us").alias("served_us"))
    held = asof_join(p.where("not ok").drop("ok"), good, ["source"], "ts_us", right_on="served_us", tolerance=7_200_000_000, how="inner")
    return held.withColumn("stale", F.col("ts_us") - F.col("served_us") > 300_000_000)
