"""Threshold joins against all products, and hard negatives against a plain evaluation of their definition."""

import numpy as np
import pytest

from wayline.llm import mining, queries

ROWS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("width", [0, 1, 7, 8, 20])
def test_join_is_every_product_in_the_range(width):
    rng = np.random.default_rng(width)
    x, y = rng.integers(-30, 30, (9, width)), rng.integers(-30, 30, (200, width))
    y[:5] = 0
    whole = x @ y.T
    for least, most in ((-np.inf, np.inf), (0, np.inf), (500, 2000), (2500, np.inf), (10**6, np.inf), (-500, -100)):
        lows = np.full(9, float(least)) + (np.arange(9) if np.isfinite(least) else 0)
        a, b, score = mining.join(x, y, lows, np.full(9, float(most)))
        want = {(i, j, whole[i, j]) for i, j in np.argwhere((whole >= lows[:, None]) & (whole <= most))}
        assert len(a) == len(want) and set(zip(a, b, score, strict=True)) == want


def plain(rows, positives=5, negatives=3):
    kept = {}
    for i, v, z in rows:
        if i is None or z is None or v is None or any(c is None or not np.isfinite(c) for c in v):
            continue
        z = (z + 1) % 10 if i % 7 == 0 else z
        kept[i, z, tuple(int(np.floor(256 * float(np.float32(c)))) for c in v)] = None
    out = []
    for i, z, v in kept:
        if i % 50:
            continue
        scored = [(-sum(p * q for p, q in zip(v, w, strict=False)), j, u) for j, u, w in kept if j != i]
        for s, j, _ in sorted(r for r in scored if r[2] == z)[:positives]:
            inside = sorted(r for r in scored if r[2] != z and 50 * -s <= 100 * -r[0] <= 95 * -s)[:negatives]
            out += [(i, j, k + 1, r[1], -s, -r[0]) for k, r in enumerate(inside)]
    return out


def table(n=700, width=16, seed=1):
    rng = np.random.default_rng(seed)
    v = rng.normal(0, 0.2, (n, width)).astype(np.float32).round(2)
    rows = [(i, [float(c) for c in v[i % 600]], int(rng.choice([0, 0, 1, 2, 3]))) for i in range(n)]  # equal vectors under several ids
    rows += [(700, [0.0] * width, 1), (750, [0.0] * width, 1), (800, [], 2), (801, [], 2), (802, [0.5] * 3, 2), (850, [0.5] * 3, 2), (900, [float(c) for c in v[5]], 9)]
    rows += [(None, [0.1] * width, 1), (1000, None, 1), (1001, [0.1] * width, None), (1050, [float("nan")] * width, 1), (1051, [None, 0.1], 1), (1052, [float("inf")], 1)]
    return rows + rows[:3] + rows[50:51] * 4


LIMITS = [{}, {"BLOCK_VECTORS": 20, "LINE": 3, "ANCHOR_BYTES": 600, "STEP": 3}]


@pytest.mark.parametrize("limits", LIMITS)
def test_query_is_exact(spark, tmp_path, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(mining, name, value)
    rows = table() if not limits else table(240)
    spark.createDataFrame(rows, ROWS).repartition(5).write.parquet(str(tmp_path / "embeddings.parquet"))
    found = queries.QUERIES["op11_threshold_negatives"](spark, str(tmp_path))
    assert dict(found.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}
    got = sorted(tuple(r) for r in found.collect())
    assert got == sorted(plain(rows)) and len(got) > 50


def test_nothing_to_mine(spark):
    rows = spark.createDataFrame([(1, [0.5], 1), (2, [0.5], 2)], ROWS)
    alone = spark.createDataFrame([(50, [0.5], 1), (2, [0.5], 2)], ROWS)
    for some in (rows, rows.limit(0), alone):
        found = mining.hard_negatives(mining.scaled(some))
        assert found.count() == 0 and found.columns[0] == "anchor_id"


def test_clashing_columns(spark):
    rows = spark.createDataFrame([(50, [0.5], 1, 1, 1, 1), (2, [0.5], 1, 1, 1, 1), (3, [0.3], 2, 1, 1, 1)], f"{ROWS}, v int, `a.b` int, rank int")
    assert [tuple(r) for r in mining.hard_negatives(mining.scaled(rows)).collect()] == [(50, 2, 1, 3, 128 * 128, 128 * 76)]
