"""Guarded snapshots, rebuilds of what changed, mergeable distinct counts and bounded dedupe."""

import random

import pytest
from pyspark.sql import functions as F

from test_streams import write_in_order
from wayline.operators import publish as P
from wayline.operators import sketches as K
from wayline.streaming import live

ROWS = "feed string, x long"


def test_a_missed_floor_keeps_the_old_snapshot(spark, tmp_path):
    s = P.Snapshots(spark, str(tmp_path / "t"), keep=1)
    rows = spark.createDataFrame([(f, i) for i, f in enumerate("aaabbc")], ROWS)
    floors = {"rows in all": P.Floor(F.count("x"), least=2, share=0.8), **P.required_feeds(["a", "b"])}
    assert s.current() is None
    bad = s.publish(rows.where("feed = 'a'"), floors)
    assert not bad.published and bad.failures == ["feed b: 0 of at least 1"] and s.current() is None
    first = s.publish(rows, floors)
    assert first.published and first.metrics == {"rows": 6.0, "rows in all": 6.0, "feed a": 3.0, "feed b": 2.0}
    again = s.publish(rows.where("feed <> 'c' and x > 1"), floors)
    assert not again.published and len(again.failures) == 1 and s.current().count() == 6
    assert not s.publish(rows.where("x < 0"), floors).published and s.current().count() == 6
    for _ in range(3):
        assert s.publish(rows.where("x > 0"), floors).published
    assert s.current().count() == 5 and len(list((tmp_path / "t/rows").iterdir())) == 2


def test_only_changed_feeds_are_built(spark, tmp_path):
    path, seen = str(tmp_path / "t"), []

    def build(inputs):
        seen.append({r["feed"] for r in inputs["a"].unionByName(inputs["b"]).select("feed").distinct().collect()})
        return inputs["a"].groupBy("feed").agg(F.sum("x").alias("total"))

    a = [("f", 1), ("f", 2), ("g", 3), ("h", 4), (None, 9)]
    b = [("f", 1), ("g", 1)]
    run = lambda a, b: {(r["feed"], r["change"]) for r in P.rebuild({"a": spark.createDataFrame(a, ROWS).repartition(3), "b": spark.createDataFrame(b, ROWS)}, "feed", build, path).collect()}
    table = lambda: {tuple(r) for r in spark.read.schema("feed string, total long").parquet(f"{path}/rows").select("feed", "total").collect()}
    files = lambda: {f.relative_to(tmp_path): f.stat().st_mtime_ns for f in (tmp_path / "t/rows").rglob("*.parquet")}
    assert run(a, b) == {("f", "new"), ("g", "new"), ("h", "new")} and table() == {("f", 3), ("g", 3), ("h", 4)}
    before = files()
    assert run(a[::-1], b) == set() and files() == before and len(seen) == 1  # another order is no change
    assert run([("f", 1), ("f", 2), ("g", 5), ("h", 4)], b) == {("g", "changed")} and table() == {("f", 3), ("g", 5), ("h", 4)}
    assert {f for f in files() if "feed=g" not in str(f)} == {f for f in before if "feed=g" not in str(f)} and seen[-1] == {"g"}
    assert run([("f", 1), ("f", 2), ("g", 5), ("i", 1)], [("f", 2), ("g", 1)]) == {("f", "changed"), ("h", "gone"), ("i", "new")}
    assert table() == {("f", 3), ("g", 5), ("i", 1)}
    assert run([("g", 5)], [("f", 2), ("g", 1)]) == {("i", "gone"), ("f", "changed")} and table() == {("g", 5)}  # f has inputs and no result


@pytest.mark.parametrize("lg_k", [8, 12])
def test_sketches_merge_within_the_stated_error(spark, lg_k):
    rng = random.Random(1)
    rows = [(rng.choice("rst"), rng.choice("gh"), rng.randint(0, 23), rng.randint(0, 30_000)) for _ in range(60_000)] + [("r", "g", 1, None), ("u", "g", 1, None)]
    df = spark.createDataFrame(rows, "region string, grp string, hour int, id long")
    table = K.sketch_table(df, ["region", "grp", "hour"], F.col("id"), lg_k)
    day = K.with_parents(K.united(table, ["region", "grp"]), "region", {"all": ["r", "s", "t"]})
    got = {(r["region"], r["grp"]): r for r in K.estimated(day, lg_k).collect()}
    for (region, grp), r in got.items():
        exact = len({i for a, g, _, i in rows if g == grp and (region == "all" or a == region) and i is not None})
        assert r["low"] <= exact <= r["high"] and abs(r["estimate"] - exact) <= K.relative_error(lg_k) * exact
    assert len(got) == 8 and K.sketch_table(df.limit(0), ["region"], F.col("id")).count() == 0
    # appended hours give the same as one pass
    parts = K.sketch_table(df.where("hour < 9"), ["grp"], F.col("id"), lg_k).unionByName(K.sketch_table(df.where("hour >= 9"), ["grp"], F.col("id"), lg_k))
    one = {r["grp"]: r["estimate"] for r in K.estimated(K.sketch_table(df, ["grp"], F.col("id"), lg_k), lg_k).collect()}
    two = {r["grp"]: r["estimate"] for r in K.estimated(K.united(parts, ["grp"]), lg_k).collect()}
    assert all(abs(one[g] - two[g]) <= K.relative_error(lg_k) * one[g] for g in one)


def test_dedupe_holds_no_more_than_the_lateness(spark, tmp_path):
    minute, start, sizes, late = 60, 1_700_000_000, [], 0
    at = lambda m: start + m * minute
    for i in range(6):
        rows = [(k, at(10 * i + k)) for k in range(10)] + ([(k, at(10 * (i - 1) + k)) for k in range(10)] if i else [])  # each part is sent again with the next
        rows = [(t, t) for _, t in rows] + ([(1, at(0)), (2, at(1))] if i == 5 else [])  # two rows far too late
        df = spark.createDataFrame(rows, "id long, s long").withColumn("at", F.timestamp_seconds("s"))
        write_in_order(df, tmp_path / "in", i)
        source = spark.readStream.schema("id long, s long, at timestamp").parquet(str(tmp_path / "in/part=*"))
        out = live.deduped(source, ["id"], "at", "20 minutes")
        query = out.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"), format="parquet")
        query.awaitTermination()
        sizes.append(live.state_rows(query))
        late += live.dropped_late(query)
    got = [r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == [at(m) for m in range(60)]  # every fix once
    assert late == 2 and sizes[3:] == [max(sizes)] * 3  # no growth once the lateness is full
