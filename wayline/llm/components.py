"""Connected components of an edge table by rounds of joins; no node's neighbours are ever gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import discard, staged


def _smallest(pairs: DataFrame) -> DataFrame:
    """u -> the smallest of u and its neighbours; combinable, so a node with many neighbours shrinks before the shuffle."""
    return pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    pairs = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return pairs.join(_smallest(pairs), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _smallest(down)
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def component_roots(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b); the root is the smallest node of its component and maps to itself.

    Alternates large-star and small-star until the edges stay the same, which takes about as many rounds as the logarithm of
    the number of nodes. Loops and repeated edges are allowed; an empty table gives no rows.
    """
    edges = staged(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v").distinct())
    before = _mark(edges)
    while True:
        following = staged(_small_star(_large_star(edges)))
        discard(edges)
        edges, after = following, _mark(following)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
