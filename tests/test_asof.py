"""As-of joins against a plain search, at chunk widths from 1 to more than the whole range."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wayline.operators.asof import asof_join

LEFT, RIGHT = "k string, t long, n int", "k string, t long, v string, m map<string,int>"


def tables(seed=5):
    rng = random.Random(seed)
    key = lambda: rng.choice(["a", "a", "a", "b", "c", "d"])
    left = [(key(), rng.randint(-50, 300), i) for i in range(240)] + [(None, 3, 900), ("a", None, 901), ("none", 5, 902), ("b", 7, 903), ("b", 7, 903)]
    right = [(k, rng.randint(0, 250), f"v{i:03d}", {"i": i}) for i in range(120) if (k := key()) != "d"] + [(None, 3, "no", None), ("a", None, "no", None), ("e", 1, "no", None)]
    return left, right + right[:5]


def plain(left, right, direction, tolerance, exact):
    out = []
    for k, t, n in left:
        best = None
        for rk, rt, v, _ in right:
            if None in (k, t, rk, rt) or rk != k or (rt == t and not exact):
                continue
            if (direction == "backward" and rt > t) or (direction == "forward" and rt < t) or (tolerance is not None and abs(rt - t) > tolerance):
                continue
            rank = (abs(rt - t), rt > t, -int(v[1:]))
            best = min(best, (rank, rt, v)) if best else (rank, rt, v)
        out.append((k, t, n, best[1] if best else None, best[2] if best else None))
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("chunk", [1, 30, 100_000])
@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
def test_every_direction(spark, chunk, direction):
    left, right = tables()
    l, r = spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)
    for tolerance, exact in ((None, True), (4, False)):
        got = asof_join(l, r, ["k"], "t", direction=direction, tolerance=tolerance, exact=exact, ties=["v"], chunk=chunk)
        assert got.columns == ["k", "t", "n", "t_right", "v", "m"]
        assert rows(got.drop("m")) == plain(left, right, direction, tolerance, exact)


def test_inner_drops_rows_without_partner(spark):
    left, right = tables()
    got = asof_join(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["k"], "t", how="inner", tolerance=3)
    assert rows(got.drop("m")) == [r for r in plain(left, right, "backward", 3, True) if r[4] is not None]


def test_dense_key_is_cut_into_chunks(spark, monkeypatch):
    from wayline.operators import asof

    monkeypatch.setattr(asof, "ROWS_PER_CHUNK", 10)
    left, right = tables()
    got = asof_join(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["k"], "t", ties=["v"])
    assert rows(got.drop("m")) == plain(left, right, "backward", None, True)
    same = asof_join(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["k"], "t", ties=["v"], tolerance=0)
    assert rows(same.drop("m")) == plain(left, right, "backward", 0, True)


def test_times_days_and_no_keys(spark):
    day = datetime(2024, 1, 1)
    left = spark.createDataFrame([(day + timedelta(hours=h), float(h)) for h in (0, 5, 30)], "t timestamp, x double")
    right = spark.createDataFrame([(day + timedelta(hours=h), f"r{h}") for h in (1, 4, 29)], "t timestamp, v string")
    assert [r["v"] for r in asof_join(left, right, [], "t", chunk=3.6e9).orderBy("t").collect()] == [None, "r4", "r29"]
    assert [r["v"] for r in asof_join(left, right, [], "t", tolerance=3.5e9).orderBy("t").collect()] == [None, None, None]
    dates = left.withColumn("t", F.to_date("t"))
    assert [r["v"] for r in asof_join(dates, right, [], "t", direction="nearest").orderBy("x").collect()] == ["r1", "r1", "r29"]
    odd = spark.createDataFrame([(float("nan"), 1), (float("inf"), 2), (2.5, 3)], "t double, x int")
    numbers = spark.createDataFrame([(2.0, "two"), (float("-inf"), "low")], "t double, v string")
    assert {r["x"]: r["v"] for r in asof_join(odd, numbers, [], "t").collect()} == {1: None, 2: None, 3: "two"}
    with pytest.raises(TypeError):
        asof_join(left.withColumn("t", F.lit("x")), right, [], "t")


def test_empty_tables_clashes_and_dots(spark):
    left = spark.createDataFrame([("a", 1, 2)], "k string, t long, `a.b` int")
    right = spark.createDataFrame([("a", 0, 5, 6)], "k string, t long, `a.b` int, _at int")
    assert rows(asof_join(left, right, ["k"], "t")) == [("a", 1, 2, 0, 5, 6)]
    assert rows(asof_join(left, right.limit(0), ["k"], "t")) == [("a", 1, 2, None, None, None)]
    assert rows(asof_join(left.limit(0), right, ["k"], "t")) == []
    with pytest.raises(ValueError):
        asof_join(left.withColumn("t_right", F.lit(1)), right, ["k"], "t")
    with pytest.raises(ValueError):
        asof_join(left, right, ["k"], "t", direction="sideways")


def test_rows_are_exchanged_once(spark):
    left, right = tables()
    got = asof_join(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["k"], "t", chunk=10)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") <= 2  # both uses of the events read one exchange or repeat its text


def test_retained_markers_age_while_polls_fail(spark):
    """A marker that was fresh at its poll is stale six minutes on, when later polls failed; one just polled is not."""
    polled = spark.createDataFrame([("train", datetime(2026, 8, 19, 22, 0)), ("other", datetime(2026, 8, 19, 22, 5))], "source string, at timestamp")
    failed = spark.createDataFrame([("train", datetime(2026, 8, 19, 22, 4)), ("train", datetime(2026, 8, 19, 22, 6)), ("other", datetime(2026, 8, 19, 22, 6))], "source string, at timestamp")
    held = asof_join(failed, polled, ["source"], "at")
    got = held.select("source", (F.unix_seconds("at") - F.unix_seconds("at_right") > 300).alias("stale"))
    assert rows(got) == [("other", False), ("train", False), ("train", True)]
