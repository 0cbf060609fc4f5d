"""The chunked scan against plain windows, with chunks far smaller than a key."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wayline.operators.ordered import OrderedScan, chunk_width, first_wins, last_wins

ROUND = 6


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = []
    for key, n in (("hot", 400), ("warm", 37), ("one", 1), ("two", 2)):
        at = 0
        for _ in range(n):
            at += rng.choice([1, 1, 2, 9])
            data.append((key, at, rng.randint(-5, 5), rng.random() < 0.5))
    return spark.createDataFrame(data, "k string, ix bigint, v int, flag boolean").cache()


@pytest.mark.parametrize("width", [1, 3, 10, 100_000])
def test_scan_equals_window(rows, width):
    step = F.col("v") - F.coalesce("p", F.lit(0)) * 2
    opens = F.when(F.col("flag") & ~F.coalesce("pf", F.lit(False)) & F.coalesce("nf", F.lit(False)), 1).otherwise(0)
    scan = OrderedScan(rows, ["k"], ["ix"], F.floor(F.col("ix") / width)).extend(
        lag={"p": F.col("v"), "pf": F.col("flag")}, lead={"nf": F.col("flag"), "nv": F.col("v") * 3},
        derived={"step": step, "opens": opens}, running_sum={"total": F.col("step"), "run": F.col("opens")},
        running_max={"peak": F.col("step") + F.coalesce("nv", F.lit(0))}, max_before={"earlier": F.when(F.col("flag"), F.col("step"))},
        first={"v0": F.col("v")}, last={"v1": F.col("v")}, position="pos",
    )
    w = Window.partitionBy("k").orderBy("ix")
    upto, before, whole = (w.rowsBetween(Window.unboundedPreceding, e) for e in (0, -1, Window.unboundedFollowing))
    plain = rows.withColumns(
        {"p": F.lag("v").over(w), "pf": F.lag("flag").over(w), "nf": F.lead("flag").over(w), "nv": F.lead(F.col("v") * 3).over(w)}
    ).withColumns({"step": step, "opens": opens}).withColumns(
        {
            "total": F.sum("step").over(upto), "run": F.sum("opens").over(upto), "peak": F.max(F.col("step") + F.coalesce("nv", F.lit(0))).over(upto),
            "earlier": F.max(F.when(F.col("flag"), F.col("step"))).over(before), "v0": F.first("v").over(whole), "v1": F.last("v").over(whole),
            "pos": F.row_number().over(w) - 1,
        }
    )
    columns = ["k", "ix", "p", "pf", "nf", "nv", "step", "total", "run", "peak", "earlier", "v0", "v1", "pos"]
    got = sorted(map(tuple, scan.df.select(columns).collect()), key=str)
    want = sorted(map(tuple, plain.select(columns).collect()), key=str)
    assert got == want


def test_rows_are_exchanged_once(spark, rows, tmp_path):
    rows.write.parquet(str(tmp_path / "rows"))
    scan = OrderedScan(spark.read.parquet(str(tmp_path / "rows")), ["k"], ["ix"], F.floor(F.col("ix") / 8)).extend(
        lag={"p": F.col("v")}, running_sum={"s": F.col("v")}
    )
    df = scan.df
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final


def test_chunk_width_splits_the_densest_key(rows):
    width = chunk_width(rows, ["k"], "ix", target_rows=50)
    chunks = rows.where("k = 'hot'").groupBy(F.floor(F.col("ix") / width)).count()
    assert chunks.agg(F.max("count")).first()[0] <= 75
    assert chunk_width(rows, ["k"], "ix", target_rows=10_000) is None


def test_last_and_first_wins(spark):
    df = spark.createDataFrame([("a", 1, 2, "x"), ("a", 2, 1, "y"), ("b", 1, 1, None)], "k string, probe int, pos int, v string")
    assert {tuple(r) for r in last_wins(df, ["k"], ["probe", "pos"]).select("k", "v").collect()} == {("a", "y"), ("b", None)}
    assert {tuple(r) for r in first_wins(df, ["k"], ["probe", "pos"]).select("k", "v").collect()} == {("a", "x"), ("b", None)}


def test_rows_dealt_into_a_given_number_of_parts_are_not_broadcast(spark):
    from pyspark.sql import functions as F

    from wayline.operators import paths, repair

    cache = spark.createDataFrame([(f"s{i}", [(0.0, 0.0)] * 7) for i in range(9)] + [("none", None)], "segment string, points array<struct<lng:double,lat:double>>")
    assert repair.road_partitions(cache, 3) == max(21, spark.sparkContext.defaultParallelism)
    points = cache.select("segment", F.posexplode("points").alias("ix", "p")).select("segment", "ix", F.col("p.lng").alias("lng"), F.col("p.lat").alias("lat"))
    metrics = lambda n: paths.loop_metrics(paths.path_scan(points, ["segment"], partitions=n))
    plan = metrics(21)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert sorted(map(tuple, metrics(21).collect())) == sorted(map(tuple, metrics(None).collect()))
