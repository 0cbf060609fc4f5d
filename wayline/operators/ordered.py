"""Ordered computations per key that do not put a whole key into one task.

A key (a path, a source, a trip) may hold a large share of all rows, so a plain
``Window.partitionBy(key)`` is not safe. ``OrderedScan`` cuts every key into
chunks of its order (an hour of fixes, a block of point numbers), runs the window
inside ``(key, chunk)``, folds each chunk to one summary row, carries the
summaries forward over the chunks of the key and joins the carry back on
``(key, chunk)``. Rows are exchanged once, on ``(key, chunk)``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.session import cut_lineage

CHUNK = "_chunk"


def time_chunk(ts_micros: str, seconds: int = 3600) -> Column:
    return F.floor(F.col(ts_micros) / F.lit(seconds * 1_000_000)).cast("bigint")


def block_chunk(ix: str, size: int = 65_536) -> Column:
    return F.floor(F.col(ix) / F.lit(size)).cast("bigint")


class OrderedScan:
    """``chunk`` must not decrease along ``order``; ``order`` must be unique per key. Rows without a key are dropped.

    ``partitions`` fixes the number of parts of the exchange and merges the carry there, for rows that take many times their stored
    size in memory: Spark may take them for small, join them by broadcast and sort all of them in a few tasks.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, _prepared: bool = False, partitions: int | None = None):
        self.keys, self.order = list(keys), list(order)
        self._chunk, self._partitions = chunk, partitions
        if _prepared:
            self._rows = df
        else:
            # the join on (key, chunk) needs both; filtering here keeps its two inputs one exchange
            df = df.withColumn(CHUNK, chunk)
            for c in [*self.keys, CHUNK]:
                df = df.where(F.col(c).isNotNull())
            self._rows = df.repartition(*([partitions] if partitions else []), *[F.col(k) for k in self.keys], F.col(CHUNK))

    @property
    def df(self) -> DataFrame:
        return self._rows.drop(CHUNK)

    def select(self, *columns: Column | str) -> OrderedScan:
        return self._next(self._rows.select(CHUNK, *columns))

    def with_columns(self, columns: Mapping[str, Column]) -> OrderedScan:
        return self._next(self._rows.withColumns(dict(columns)))

    def transform(self, fn: Callable[[DataFrame], DataFrame]) -> OrderedScan:
        """Apply a row-wise step (filter, map-side join) that keeps the columns of the scan."""
        return self._next(fn(self._rows))

    def settle(self) -> OrderedScan:
        """Materialise the rows in the checkpoint folder, so later passes do not repeat costly steps."""
        return self._next(cut_lineage(self._rows))

    def _next(self, rows: DataFrame) -> OrderedScan:
        return OrderedScan(rows, self.keys, self.order, self._chunk, _prepared=True, partitions=self._partitions)

    def extend(
        self,
        *,
        lag: Mapping[str, Column] | None = None,
        lead: Mapping[str, Column] | None = None,
        derived: Mapping[str, Column] | None = None,
        running_sum: Mapping[str, Column] | None = None,
        running_max: Mapping[str, Column] | None = None,
        max_before: Mapping[str, Column] | None = None,
        first: Mapping[str, Column] | None = None,
        last: Mapping[str, Column] | None = None,
        position: str | None = None,
    ) -> OrderedScan:
        """Add ordered columns in one pass.

        ``derived`` may use the row, ``lag`` and ``lead``; the running columns may use all of these.
        ``first``, ``last`` and ``position`` are ready only after the pass. Neighbours across a chunk
        border are known on the summaries, so border rows are re-evaluated there and left out of the
        sums inside the chunk.
        """
        lag, lead, derived = dict(lag or {}), dict(lead or {}), dict(derived or {})
        sums, maxes, befores = dict(running_sum or {}), dict(running_max or {}), dict(max_before or {})
        first, last = dict(first or {}), dict(last or {})
        bordered = bool(lag or lead)
        columns = [c for c in self._rows.columns if c != CHUNK]
        own = [c for c in columns if c not in self.keys]

        group = [*self.keys, CHUNK]
        inside = Window.partitionBy(*group).orderBy(*self.order)
        upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
        order = F.struct(*self.order)

        rows = self._rows
        numbered: dict[str, Column] = {}
        if bordered or position:
            numbered["_rn"] = F.row_number().over(inside)
        if lead:
            numbered["_final"] = F.lead(F.lit(True)).over(inside).isNull()
        numbered |= {n: F.lag(e).over(inside) for n, e in lag.items()}
        numbered |= {n: F.lead(e).over(inside) for n, e in lead.items()}
        if numbered:
            rows = rows.withColumns(numbered)
        if derived:
            rows = rows.withColumns(derived)
        is_inner = F.lit(True)
        if bordered:
            is_inner = F.col("_rn") > 1
        if lead:
            is_inner = is_inner & ~F.col("_final")

        def term(e: Column) -> Column:
            return F.coalesce(e, F.lit(0))

        # the head keeps every column, so both uses of the rows share one exchange
        head = [F.col(c) for c in columns] + [F.col(n).alias(f"_x_{n}") for n in lead] + [e.alias(f"_e_{n}") for n, e in {**lead, **first}.items()]
        folds = [F.min_by(F.struct(*head), order).alias("_head"), F.count(F.lit(1)).alias("_n")]
        if lag or lead or last:
            tail = [F.col(c) for c in own] + [F.col(n).alias(f"_x_{n}") for n in lag] + [e.alias(f"_e_{n}") for n, e in {**lag, **last}.items()]
            folds.append(F.max_by(F.struct(*tail), order).alias("_tail"))
        folds += [F.sum(F.when(is_inner, term(e))).alias(f"_s_{n}") for n, e in sums.items()]
        folds += [F.max(F.when(is_inner, e)).alias(f"_m_{n}") for n, e in {**maxes, **befores}.items()]
        summary = rows.groupBy(*group).agg(*folds)

        over = Window.partitionBy(*self.keys).orderBy(CHUNK)
        before = over.rowsBetween(Window.unboundedPreceding, -1)
        whole = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        across = {f"_c_{n}": F.lag(F.col("_tail")[f"_e_{n}"]).over(over) for n in lag}
        across |= {f"_c_{n}": F.lead(F.col("_head")[f"_e_{n}"]).over(over) for n in lead}
        across |= {f"_c_{n}": F.first(F.col("_head")[f"_e_{n}"]).over(whole) for n in first}
        across |= {f"_c_{n}": F.last(F.col("_tail")[f"_e_{n}"]).over(whole) for n in last}
        carry = summary.withColumns(across) if across else summary

        running = {**sums, **maxes, **befores}
        if bordered and running:
            head_row = {c: F.col("_head")[c] for c in own} | {n: F.col(f"_c_{n}") for n in lag}
            head_row |= {n: F.when(F.col("_n") == 1, F.col(f"_c_{n}")).otherwise(F.col("_head")[f"_x_{n}"]) for n in lead}
            carry = carry.withColumns(head_row)
            carry = (carry.withColumns(derived) if derived else carry).withColumns({f"_a_{n}": e for n, e in running.items()})
            if lead:
                tail_row = {c: F.col("_tail")[c] for c in own} | {n: F.col("_tail")[f"_x_{n}"] for n in lag} | {n: F.col(f"_c_{n}") for n in lead}
                carry = carry.withColumns(tail_row)
                carry = (carry.withColumns(derived) if derived else carry).withColumns(
                    {f"_z_{n}": F.when(F.col("_n") > 1, e) for n, e in running.items()}
                )
        borders = (["_a_"] if bordered else []) + (["_z_"] if lead else [])
        totals: dict[str, Column] = {}
        for n in sums:
            total = term(F.col(f"_s_{n}"))
            for b in borders:
                total = total + term(F.col(f"{b}{n}"))
            totals[f"_p_{n}"] = F.sum(total).over(before)
        for n in [*maxes, *befores]:
            parts = [F.col(f"_m_{n}"), *[F.col(f"{b}{n}") for b in borders]]
            totals[f"_p_{n}"] = F.max(F.greatest(*parts) if len(parts) > 1 else parts[0]).over(before)
        if position:
            totals["_p_position"] = F.sum("_n").over(before)
        kept = [*across, *totals, *([f"_a_{n}" for n in running] if bordered else [])]
        carry = (carry.withColumns(totals) if totals else carry).select(*group, *kept)

        local = {f"_l_{n}": F.sum(F.when(is_inner, term(e)).otherwise(F.lit(0))).over(upto) for n, e in sums.items()}
        local |= {f"_l_{n}": F.max(F.when(is_inner, e)).over(upto) for n, e in maxes.items()}
        local |= {f"_l_{n}": F.max(F.when(is_inner, e)).over(earlier) for n, e in befores.items()}
        rows = (rows.withColumns(local) if local else rows).join(carry.hint("merge") if self._partitions else carry, group)

        result = {n: F.when(F.col("_rn") == 1, F.col(f"_c_{n}")).otherwise(F.col(n)) for n in lag}
        result |= {n: F.when(F.col("_final"), F.col(f"_c_{n}")).otherwise(F.col(n)) for n in lead}
        result |= {n: F.col(f"_c_{n}") for n in [*first, *last]}
        if position:
            result[position] = F.coalesce(F.col("_p_position"), F.lit(0)) + F.col("_rn") - 1
        rows = rows.withColumns(result) if result else rows
        if derived:
            rows = rows.withColumns(derived)
        at_end = (F.col("_final") & (F.col("_rn") > 1)) if lead else F.lit(False)
        final: dict[str, Column] = {}
        for n, e in sums.items():
            value = F.coalesce(F.col(f"_p_{n}"), F.lit(0)) + F.col(f"_l_{n}")
            if bordered:
                value = value + term(F.col(f"_a_{n}")) + F.when(at_end, term(e)).otherwise(F.lit(0))
            final[n] = value
        for n, e in maxes.items():
            parts = [F.col(f"_p_{n}"), F.col(f"_l_{n}")]
            if bordered:
                parts += [F.col(f"_a_{n}"), F.when(at_end, e)]
            final[n] = F.greatest(*parts)
        for n in befores:
            parts = [F.col(f"_p_{n}"), F.col(f"_l_{n}")]
            if bordered:
                parts.append(F.when(F.col("_rn") > 1, F.col(f"_a_{n}")))
            final[n] = F.greatest(*parts)
        rows = rows.withColumns(final) if final else rows
        helpers = [c for c in rows.columns if c in {"_rn", "_final", *local, *kept}]
        return self._next(rows.drop(*helpers))


def chunk_width(df: DataFrame, keys: Sequence[str], order_value: str, target_rows: int = 1_000_000) -> float | None:
    """Order-value width that keeps chunks of the densest key near ``target_rows``; one aggregate, one row back."""
    per_key = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), (F.max(order_value) - F.min(order_value)).cast("double").alias("span")
    )
    dense = per_key.where(F.col("n") > target_rows)
    return dense.agg(F.min(F.col("span") * F.lit(float(target_rows)) / F.col("n")).alias("w")).first()["w"]


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the highest in ``order``; a combinable aggregate, so hot keys shrink before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)
