"""As-of join: for every left row the right row of the same keys that is nearest in an ordered value, in a given direction.

Both tables become one ordered table of events, cut into chunks of the ordered value per key (``OrderedScan`` does the same on one
table). Inside ``(keys, chunk)`` a window fills the last right row forward; each chunk passes on its last right row; what came before a
chunk is joined back on ``(keys, chunk)``. A key that holds a third of all rows is so spread over its chunks. Right rows of one key
and value are reduced to one by a combinable aggregate before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.operators.ordered import chunk_width

BACKWARD, FORWARD, NEAREST = "backward", "forward", "nearest"
ROWS_PER_CHUNK = 1_000_000


def order_value(column: Column, kind: T.DataType) -> Column:
    """Numbers as they are; times in microseconds, days in whole days' microseconds; null where not finite."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(column.cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("bigint") * F.lit(86_400_000_000)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(column) & (F.abs(column) < F.lit(float("inf"))), column.cast("double"))
    if isinstance(kind, T.NumericType):
        return column
    raise TypeError(f"an as-of join needs numbers, times or days, not {kind.simpleString()}")


def _named(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def asof_join(
    left: DataFrame, right: DataFrame, by: Sequence[str], on: str, *, right_on: str | None = None, direction: str = BACKWARD, tolerance: float | None = None,
    exact: bool = True, how: str = "left", ties: Sequence[str] = (), suffix: str = "_right", chunk: float | None = None,
) -> DataFrame:
    """``left`` with the columns of the right row that is nearest in ``on`` among those of the same ``by``.

    ``backward`` takes the right row with the highest value up to the left one, ``forward`` that with the lowest from it on, ``nearest`` the
    nearer of both, the earlier one where they are as near. ``exact=False`` leaves out equal values. ``tolerance`` is the largest difference
    (microseconds for times and days). Of right rows with equal keys and value the highest in ``ties`` is taken, else the highest in
    all its columns that can be compared. Left rows without a partner keep nulls, or go with ``how="inner"``. Null keys and null,
    NaN or infinite values match nothing. Repeated left rows stay. Right columns whose name the left has get ``suffix``;
    the ordered value of the partner is among them. ``chunk`` is the width of a chunk in ``on``; by default no chunk of the densest key
    has many more than ``ROWS_PER_CHUNK`` rows.
    """
    if direction not in (BACKWARD, FORWARD, NEAREST) or how not in ("left", "inner"):
        raise ValueError(f"direction {direction!r} or how {how!r} is not known")
    right_on = right_on or on
    kinds = {f.name: f.dataType for f in right.schema}
    payload = [c for c in right.columns if c not in by]
    taken = {c.lower() for c in left.columns}
    names = [f"{c}{suffix}" if c.lower() in taken else c for c in payload]
    if len({n.lower() for n in names} | taken) < len(names) + len(taken):
        raise ValueError(f"columns {sorted(names)} clash with those of the left table; give another suffix")

    keys = [f"_k{i}" for i in range(len(by))]
    usable = [_named(k).alias(n) for k, n in zip(by, keys, strict=True)]
    at_left, at_right = order_value(_named(on), left.schema[on].dataType), order_value(_named(right_on), kinds[right_on])
    seen = left.select(*usable, at_left.alias("_at"), F.struct(*[_named(c).alias(f"c{i}") for i, c in enumerate(left.columns)]).alias("_left"))
    whole = F.col("_at").isNotNull()
    for k in keys:
        whole = whole & F.col(k).isNotNull()

    row = F.struct(*[_named(c).alias(f"c{i}") for i, c in enumerate(payload)])
    comparable = [c for c in (ties or payload) if not isinstance(kinds[c], (T.MapType, T.VariantType))]
    given = right.select(*usable, at_right.alias("_at"), row.alias("_right"), F.struct(*[_named(c).alias(f"t{i}") for i, c in enumerate(comparable)]).alias("_tie")).where(whole)
    given = given.groupBy(*keys, "_at").agg(F.max_by("_right", "_tie").alias("_right"))

    if chunk is None:
        # narrow reads of both sides; a width is only needed where some key is dense
        both = seen.where(whole).select(*keys, "_at").unionAll(given.select(*keys, "_at"))
        chunk = chunk_width(both.withColumn("_at", F.col("_at").cast("double")), keys, "_at", ROWS_PER_CHUNK) if keys else None
    part = F.floor(F.col("_at") / F.lit(float(chunk))).cast("bigint") if chunk else F.lit(0).cast("bigint")

    none_left, none_right = F.lit(None).cast(seen.schema["_left"].dataType), F.lit(None).cast(given.schema["_right"].dataType)
    mark = F.struct(F.col("_at").alias("at"), F.col("_right").alias("row"))
    events = seen.where(whole).select(*keys, "_at", "_left", none_right.alias("_right"), F.lit(True).alias("_asks")).unionAll(
        given.select(*keys, "_at", none_left.alias("_left"), "_right", F.lit(False).alias("_asks"))
    ).withColumn("_chunk", part).repartition(*[F.col(k) for k in keys], F.col("_chunk"))

    def filled(rows: DataFrame, name: str, forward: bool) -> DataFrame:
        """``rows`` with the last right row before (after) each, over chunks."""
        group = [*keys, "_chunk"]
        # at equal values a right row comes before the left ones that may take it
        side = F.col("_asks").asc() if exact else F.col("_asks").desc()
        inside = Window.partitionBy(*group).orderBy(F.col("_at").desc() if forward else F.col("_at"), side)
        upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        gives = F.when(~F.col("_asks"), F.col("_at"))
        borders = rows.groupBy(*group).agg((F.min_by if forward else F.max_by)(mark, gives).alias("_border"))
        over = Window.partitionBy(*keys).orderBy(F.col("_chunk").desc() if forward else F.col("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
        carry = borders.select(*group, F.last("_border", ignorenulls=True).over(over).alias("_carry"))
        local = rows.withColumn(name, F.last(F.when(~F.col("_asks"), mark), ignorenulls=True).over(upto))
        return local.join(carry, group).withColumn(name, F.coalesce(name, "_carry")).drop("_carry")

    before, after = direction != FORWARD, direction != BACKWARD
    if before:
        events = filled(events, "_before", False)
    if after:
        events = filled(events, "_after", True)
    asked = events.where("_asks")
    if before and after:
        nearer_after = F.col("_after").isNotNull() & (F.col("_before").isNull() | (F.col("_after.at") - F.col("_at") < F.col("_at") - F.col("_before.at")))
        asked = asked.withColumn("_found", F.when(nearer_after, F.col("_after")).otherwise(F.col("_before")))
    else:
        asked = asked.withColumn("_found", F.col("_before" if before else "_after"))
    if tolerance is not None:
        asked = asked.withColumn("_found", F.when(F.abs(F.col("_found.at") - F.col("_at")) <= F.lit(tolerance), F.col("_found")))
    asked = asked.select("_left", F.col("_found.row").alias("_right"))
    if how == "inner":
        asked = asked.where(F.col("_right").isNotNull())
    else:
        asked = asked.unionAll(seen.where(~F.coalesce(whole, F.lit(False))).select("_left", none_right.alias("_right")))
    return asked.select(*[F.col("_left").getField(f"c{i}").alias(c) for i, c in enumerate(left.columns)], *[F.col("_right").getField(f"c{i}").alias(n) for i, n in enumerate(names)])
