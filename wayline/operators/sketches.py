"""Distinct counts that merge: sketches by key and period, unions for parents and longer periods, with a stated error.

A sketch is one small binary value per key and period (at most about 2^lg_k bytes), built by a combinable aggregate; new periods are
appended and nothing is counted again. With k = 2^lg_k the standard error of a union is at most 1.04 / sqrt(k), so ``ERRORS`` of them
bound nearly every estimate; small sets are counted exactly.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K, ERRORS = 12, 4.0


def relative_error(lg_k: int = LG_K) -> float:
    """Share of the true count that estimates stay within, but for about one in ten thousand."""
    return ERRORS * 1.04 / math.sqrt(2**lg_k)


def sketch_table(rows: DataFrame, keys: Sequence[str], entity: Column, lg_k: int = LG_K) -> DataFrame:
    """(keys, sketch): distinct ``entity`` values per key; null entities count nowhere, keys without any have no row."""
    return rows.where(entity.isNotNull()).groupBy(*keys).agg(F.hll_sketch_agg(entity, F.lit(lg_k)).alias("sketch"))


def united(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sketches of fewer ``keys``: an entity that occurs under several of the finer ones counts once."""
    return sketches.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"))


def with_parents(sketches: DataFrame, column: str, parents: Mapping[str, Sequence[str]]) -> DataFrame:
    """Sketches with those of each parent's members added under the parent's name."""
    rest = [c for c in sketches.columns if c not in (column, "sketch")]
    above = [united(sketches.where(F.col(column).isin(list(members))), rest).withColumn(column, F.lit(parent)) for parent, members in parents.items()]
    out = sketches
    for rows in above:
        out = out.unionByName(rows)
    return out


def estimated(sketches: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """The keys with ``estimate`` and the range ``low`` to ``high`` of the true count."""
    error = relative_error(lg_k)
    e = F.hll_sketch_estimate("sketch")
    rows = sketches.withColumn("estimate", e).drop("sketch")
    return rows.withColumns({"low": F.floor(F.col("estimate") / (1 + error)), "high": F.ceil(F.col("estimate") / (1 - error))})
