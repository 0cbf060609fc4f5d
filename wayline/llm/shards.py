"""Sharding by jump consistent hashing: the stable key and the number of shards alone decide a row's shard, without a ring table.

Appending shards moves rows only into the new ones, and no more than the even share of these: from n to n + 1 shards about one row
in n + 1 moves. Everything is DataFrame functions. Rows of a shard carry a slot, gapless from 0, in the order in which the input
was read; slots are numbered in blocks of the input, so neither a shard nor a key that holds a third of all rows meets in one task.

Null keys hash like any other value and share one shard. Repeated rows are rows of their own, in the same shard and in different
slots. An empty table gives no rows. Input columns may have any names; one named like an output column gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import staged
from wayline.operators.ordered import OrderedScan

STEPS = 64  # jumps that one lambda call walks through; more follow where the shards are more
BLOCK_BITS = 20  # rows of an input partition that are numbered together, as a power of two
# the multiplier of the published hash, 2862933555777941757, as two halves of 32 bits
_HIGH, _LOW = divmod(2862933555777941757, 1 << 32)
_MASK = (1 << 32) - 1


def column(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def _next_state(high: Column, low: Column) -> tuple[Column, Column]:
    """state * multiplier + 1 modulo 2^64 on 32-bit halves; every product fits a signed 64-bit number, as ANSI mode asks."""
    low_part, high_part = F.lit(_LOW), F.lit(_HIGH)
    first = low.bitwiseAND(F.lit(0xFFFF)) * low_part + F.lit(1)
    second = F.shiftrightunsigned(low, 16) * low_part + F.shiftrightunsigned(first, 16)
    new_low = F.shiftleft(second.bitwiseAND(F.lit(0xFFFF)), 16).bitwiseOR(first.bitwiseAND(F.lit(0xFFFF)))
    from_high = high.bitwiseAND(F.lit(0xFFFF)) * low_part + F.shiftleft((F.shiftrightunsigned(high, 16) * low_part).bitwiseAND(F.lit(0xFFFF)), 16)
    new_high = (from_high.bitwiseAND(F.lit(_MASK)) + (low * high_part).bitwiseAND(F.lit(_MASK)) + F.shiftrightunsigned(second, 16)).bitwiseAND(F.lit(_MASK))
    return new_high, new_low


def jump_shard(key: Column, shards: int) -> Column:
    """Shard 0 to ``shards`` - 1 of a 64-bit key: the last jump below ``shards``.

    A key jumps at most ``shards`` times, and about the logarithm of that on average, so blocks of steps that a key does not
    need any more are passed over.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    wide = "bigint"
    start = F.struct(
        F.shiftrightunsigned(key.cast(wide), 32).alias("high"), key.cast(wide).bitwiseAND(F.lit(_MASK)).alias("low"),
        F.lit(-1).cast(wide).alias("last"), F.lit(0).cast(wide).alias("next"),
    )

    def hashed(s: Column, _: Column) -> Column:
        high, low = _next_state(s["high"], s["low"])
        return F.struct(high.alias("high"), low.alias("low"), s["next"].alias("last"), s["next"].alias("next"))

    def jumped(s: Column) -> Column:
        to = F.floor((s["last"] + 1) * (F.lit(float(1 << 31)) / (F.shiftrightunsigned(s["high"], 1) + 1).cast("double")))
        return F.struct(s["high"].alias("high"), s["low"].alias("low"), s["last"].alias("last"), to.cast(wide).alias("next"))

    def step(s: Column, i: Column) -> Column:
        # the new state is bound by a lambda of its own, so the jump reads it instead of computing it again
        moved = F.get(F.transform(F.array(hashed(s, i)), jumped), 0)
        return F.when(s["next"] < shards, moved).otherwise(s)

    def steps(s: Column, n: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(n)), s, step)

    if shards <= STEPS:
        return steps(start, shards)["last"].cast("int")
    blocks = F.sequence(F.lit(1), F.lit(-(-shards // STEPS)))
    return F.aggregate(blocks, start, lambda s, _: F.when(s["next"] < shards, steps(s, STEPS)).otherwise(s))["last"].cast("int")


def stable_key(names: Iterable[str]) -> Column:
    """64-bit hash of the key columns, the same in every session."""
    return F.xxhash64(*[column(n) for n in names])


def sharded(rows: DataFrame, keys: Iterable[str], shards: int, append: int = 1) -> DataFrame:
    """``rows`` with shard int, slot long and grown_shard int: the shard once ``append`` more shards are there."""
    added = {"shard", "slot", "grown_shard"}
    kept = [n for n in rows.columns if n.lower() not in added]
    key = stable_key(keys)
    placed = rows.select(
        F.struct(*[column(n).alias(n) for n in kept], F.lit(True).alias("_")).alias("row"), jump_shard(key, shards).alias("shard"),
        jump_shard(key, shards + append).alias("grown_shard"), F.monotonically_increasing_id().alias("place"),
    )
    # written once: a task that runs again reads the same places
    placed = staged(placed)
    scan = OrderedScan(placed, ["shard"], ["place"], F.shiftright("place", BLOCK_BITS)).extend(position="slot").df
    return scan.select(*[F.col("row").getField(n).alias(n) for n in kept], "shard", F.col("slot").cast("bigint").alias("slot"), "grown_shard")


def write_shards(placed: DataFrame, folder: str, rows_per_file: int = 1_000_000) -> None:
    """One folder per shard under ``folder`` with files of consecutive slots; a file's task holds ``rows_per_file`` rows at most."""
    part = F.floor(F.col("slot") / rows_per_file)
    placed.repartition(F.col("shard"), part).sortWithinPartitions("shard", "slot").write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(folder)


def moving(placed: DataFrame) -> DataFrame:
    """The rows that leave their shard when the shards are appended; all of them go to new shards."""
    return placed.filter(F.col("shard") != F.col("grown_shard"))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` as (doc_id, size, text_crc32): UTF-8 bytes of the text plus 1 and its unsigned checksum; a null text has no bytes."""
    whole = F.coalesce(column(text), F.lit(""))
    return docs.select("doc_id", (F.octet_length(whole) + F.lit(1)).cast("bigint").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"))
