"""Keyed vessel state: batch fold and stateful stream with the same rules.

A position replaces the state and keeps the known ship type; a static message only enriches a vessel
that has a position; a vessel silent for the prune time is forgotten.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from wayline import fixed_values as V
from wayline.operators.ordered import last_wins
from wayline.streaming.upserts import VERSION, Folder, UpsertTable, query_of

# message row: mmsi, at_us, is_static, lng, lat, name, sog, heading, ship_type
STATE = "lng double, lat double, name string, sog double, heading double, ship_type double, at_us bigint"
OUTPUT = f"mmsi bigint, {STATE}"


def fold_vessels(messages: DataFrame, prune_s: float = V.VESSEL_PRUNE_S, chunk: Column | None = None, now_us: Column | None = None) -> DataFrame:
    """State of every vessel after all its messages; ``at_us`` must be unique per vessel.

    Only the last session of a vessel counts, and no session ends inside a span as long as the prune time: the ends of the positions in
    each span tell where it begins. Then at most four spans of a vessel are read again. ``messages`` are thus read twice; ``chunk`` cuts
    spans finer. ``now_us`` is the clock at the end: vessels that are silent for longer than the prune time by then are forgotten too.
    """
    prune_us = int(prune_s * 1_000_000)
    at, static = F.col("at_us"), F.col("is_static")
    keys = ["mmsi", "_span", *(["_cut"] if chunk is not None else [])]
    rows = messages.withColumn("_span", at - F.pmod(at, F.lit(max(prune_us, 1)))).where(F.col("mmsi").isNotNull() & at.isNotNull())
    if chunk is not None:
        rows = rows.withColumn("_cut", chunk).where(F.col("_cut").isNotNull())
    # numbers alone, so the fold keeps no rows and sorts none
    spans = rows.groupBy(*keys).agg(
        F.min(F.when(~static, at)).alias("_first"), F.max(F.when(~static, at)).alias("_last"),
        F.min(F.when(static, at)).alias("_static"), F.min(F.when(static & F.col("name").isNotNull(), at)).alias("_named"),
    )
    over = Window.partitionBy("mmsi").orderBy(*keys[1:])
    whole = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.max("_last").over(over.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("_joined", F.coalesce(F.col("_first") - before <= prune_us, F.lit(False)))
    spans = spans.withColumns({"_session": F.max(F.when(~F.col("_joined"), F.col("_first"))).over(whole), "_until": F.max("_last").over(whole) + prune_us})
    newest = lambda c: F.max(F.when(F.col(c) <= F.col("_until"), F.col(c))).over(whole)
    spans = spans.withColumns({"_static_from": newest("_static"), "_named_from": newest("_named")}).where(
        (F.col("_first") == F.col("_session")) | (F.col("_last") + prune_us == F.col("_until"))
        | (F.col("_static") == F.col("_static_from")) | (F.col("_named") == F.col("_named_from"))
    )
    if now_us is not None:
        spans = spans.where(F.col("_until") >= now_us)
    when_position, when_static = F.when(~static, at), F.when(static, at)
    when_named = F.when(F.col("name").isNotNull(), when_static)
    folded = rows.join(spans.select(*keys, "_session", "_until"), keys).where(at.between(F.col("_session"), F.col("_until"))).groupBy("mmsi").agg(
        F.max_by(F.struct("lng", "lat", "sog", "heading", "name", "at_us"), when_position).alias("p"),
        F.min_by("ship_type", when_position).alias("first_type"),
        F.max_by(F.struct("ship_type"), when_static).alias("s"),
        F.max_by("name", when_named).alias("static_name"), F.max(when_named).alias("static_name_at"),
    )
    renamed = F.coalesce(F.col("static_name_at") > F.col("p.at_us"), F.lit(False))
    return folded.select(
        "mmsi", "p.lng", "p.lat", F.when(renamed, F.col("static_name")).otherwise(F.col("p.name")).alias("name"), "p.sog", "p.heading",
        F.when(F.col("s").isNotNull(), F.col("s.ship_type")).otherwise(F.col("first_type")).alias("ship_type"), "p.at_us",
    )


def _clean(value: Any) -> Any:
    return None if value is None or (isinstance(value, float) and pd.isna(value)) else value


class Track:
    """Sessions of one vessel whose messages may come in any order: positions at most the prune time apart are one session.

    Holds one summary per session, not its messages, and the static messages that no position precedes yet. Sessions that nothing
    on time can reach any more are dropped, so their number is bounded by the lateness over the prune time.
    """

    def __init__(self, prune_us: int, held: str | None = None):
        self.prune_us = prune_us
        self.sessions, self.waiting = json.loads(held) if held else ([], [])

    def held(self) -> str:
        return json.dumps((self.sessions, self.waiting))

    def position(self, at: int, kind: float | None, fields: list) -> None:
        one = {"start": at, "end": at, "first": kind, "fields": fields, "static": None, "named": None}
        before = [s for s in self.sessions if s["end"] < at - self.prune_us]
        after = [s for s in self.sessions if s["start"] > at + self.prune_us]
        for s in self.sessions[len(before) : len(self.sessions) - len(after)]:
            one = self._joined(*sorted((s, one), key=lambda x: x["start"])) if s["end"] < at or at < s["start"] else s
        self.sessions = [*before, one, *after]
        if self.waiting:
            waiting, self.waiting = self.waiting, []
            for static in waiting:
                self.static(*static)

    @staticmethod
    def _joined(a: dict, b: dict) -> dict:
        later = b if b["end"] >= a["end"] else a
        latest = lambda name: max((x[name] for x in (a, b) if x[name]), key=lambda m: m[0], default=None)
        return {"start": a["start"], "end": later["end"], "first": a["first"], "fields": later["fields"], "static": latest("static"), "named": latest("named")}

    def static(self, at: int, kind: float | None, name: str | None) -> None:
        for s in reversed(self.sessions):
            if s["start"] <= at <= s["end"] + self.prune_us:
                if s["static"] is None or at >= s["static"][0]:
                    s["static"] = [at, kind]
                if name is not None and (s["named"] is None or at >= s["named"][0]):
                    s["named"] = [at, name]
                return
        self.waiting.append([at, kind, name])

    def settle(self, watermark_us: int) -> None:
        """Forgets what messages from the watermark on cannot reach."""
        self.sessions = [s for i, s in enumerate(self.sessions) if i == len(self.sessions) - 1 or s["end"] + self.prune_us >= watermark_us]
        self.waiting = [w for w in self.waiting if w[0] >= watermark_us]

    def row(self) -> list | None:
        """lng, lat, name, sog, heading, ship_type, at_us of the last session."""
        if not self.sessions:
            return None
        s = self.sessions[-1]
        lng, lat, name, sog, heading = s["fields"]
        renamed = s["named"] is not None and s["named"][0] > s["end"]
        return [lng, lat, s["named"][1] if renamed else name, sog, heading, s["static"][1] if s["static"] else s["first"], s["end"]]


class VesselProcessor(StatefulProcessor):
    """Keeps a ``Track`` per vessel; an event-time timer takes a silent vessel out of the state and tells the sink."""

    def __init__(self, prune_s: float = V.VESSEL_PRUNE_S):
        self.prune_us = int(prune_s * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("vessel", "held string")

    def _arm(self, track: Track) -> None:
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if track.sessions:
            self.handle.registerTimer((track.sessions[-1]["end"] + self.prune_us) // 1000 + 1)
        elif track.waiting:
            self.handle.registerTimer(max(w[0] for w in track.waiting) // 1000 + 1)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        stored = self.state.get()
        track = Track(self.prune_us, stored[0] if stored is not None else None)
        for frame in rows:  # one Arrow batch after the other
            for m in frame.sort_values("at_us", kind="stable").itertuples(index=False):
                if m.is_static:
                    track.static(int(m.at_us), _clean(m.ship_type), _clean(m.name))
                else:
                    track.position(int(m.at_us), _clean(m.ship_type), [_clean(v) for v in (m.lng, m.lat, m.name, m.sog, m.heading)])
        track.settle(timerValues.getCurrentWatermarkInMs() * 1000)
        self.state.update((track.held(),))
        self._arm(track)
        row = track.row()
        if row is not None:
            yield self._frame(key, [*row, False])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        stored = self.state.get()
        if stored is None:
            return
        track = Track(self.prune_us, stored[0])
        row = track.row()
        track.sessions = []
        track.settle(timerValues.getCurrentWatermarkInMs() * 1000)
        if track.waiting:  # a late position may still come before them
            self.state.update((track.held(),))
            self._arm(track)
        else:
            self.state.clear()
        if row is not None:
            yield self._frame(key, [None, None, None, None, None, None, row[-1], True])

    @staticmethod
    def _frame(key: Any, row: list) -> pd.DataFrame:
        columns = ["mmsi", "lng", "lat", "name", "sog", "heading", "ship_type", "at_us", "gone"]
        return pd.DataFrame([[int(key[0]), *row]], columns=columns).astype({c: "float64" for c in ("lng", "lat", "sog", "heading", "ship_type")} | {"name": "object"})

    def close(self) -> None:
        pass


def vessel_stream(messages: DataFrame, late: str = "1 minute", prune_s: float = V.VESSEL_PRUNE_S) -> DataFrame:
    """Changes of the vessel state in update mode: the newest row of a vessel, or ``gone`` once it was silent for the prune time.

    Messages may come in any order up to ``late``; later ones are dropped. A vessel is taken out when the watermark, which is
    ``late`` behind the newest message, has passed its last position by the prune time. Needs the RocksDB state store (``use_rocksdb``).
    """
    timed = messages.withColumn("at", F.timestamp_micros("at_us")).withWatermark("at", late)
    return timed.groupBy("mmsi").transformWithStateInPandas(
        statefulProcessor=VesselProcessor(prune_s), outputStructType=f"{OUTPUT}, gone boolean", outputMode="Update", timeMode="EventTime"
    )


def vessel_table(spark: SparkSession, path: str) -> UpsertTable:
    """Sink of ``vessel_stream``: one row per vessel that has not been taken out."""
    return UpsertTable(spark, path, ["mmsi"], [VERSION, "at_us", "gone"], f"{OUTPUT}, gone boolean", deleted="gone")


HELD = """mmsi bigint, start bigint, end bigint, first double, fields struct<lng:double,lat:double,name:string,sog:double,heading:double>,
static struct<at:bigint,kind:double>, named struct<at:bigint,name:string>, touched boolean"""


class VesselSessions:
    """The rules of ``vessel_stream`` for many vessels: every micro-batch folds its messages into a table of sessions, without Python per vessel.

    A row is a session, a static message that no position precedes yet (``start`` is null) or the newest time seen so far (``mmsi`` is null).
    Micro-batch ``n`` reads the table of the one before and writes its own before the sink publishes, so a micro-batch that runs again gives
    the same tables. Sessions that nothing on time can reach leave the table, which holds the vessels of the lateness and the prune time.
    """

    def __init__(self, sink: UpsertTable, path: str, late_s: float, prune_s: float = V.VESSEL_PRUNE_S):
        self.sink, self.spark, self.path = sink, sink.spark, path.rstrip("/")
        self.late_us, self.prune_us = int(late_s * 1_000_000), int(prune_s * 1_000_000)
        self.folder = Folder(self.spark, path)

    def _held(self, query: str, batch: int) -> tuple[DataFrame, int | None]:
        """Table of the micro-batch before ``batch`` and the newest time that it has seen."""
        before = [int(n) for n in self.folder.names(query) if int(n) < batch]
        if not before:
            return self.spark.createDataFrame([], HELD), None
        held = self.spark.read.schema(HELD).parquet(f"{self.path}/{query}/{max(before):020d}")
        return held, held.agg(F.max(F.greatest("end", "static.at"))).first()[0]

    def _reachable(self, seen: int | None) -> Column:
        """Rows that messages from the watermark on can still change; all of a vessel that was taken out are not."""
        if seen is None:
            return F.lit(True)
        watermark = F.lit(seen - self.late_us)
        return F.when(F.col("start").isNull(), F.col("static.at") >= watermark).otherwise(F.col("end") + self.prune_us >= watermark)

    def _folded(self, held: DataFrame, messages: DataFrame) -> DataFrame:
        """Sessions and waiting static messages of ``held`` and ``messages``."""
        static, at = F.col("is_static"), F.col("at_us")
        types = {f.name: f.dataType for f in self.spark.createDataFrame([], HELD).schema.fields}
        new = messages.select(
            "mmsi", F.when(~static, at).alias("start"), F.when(~static, at).alias("end"), F.when(~static, F.col("ship_type")).alias("first"),
            F.when(~static, F.struct("lng", "lat", "name", "sog", "heading")).alias("fields"),
            F.when(static, F.struct(at.alias("at"), F.col("ship_type").alias("kind"))).alias("static"),
            F.when(static & F.col("name").isNotNull(), F.struct(at.alias("at"), F.col("name").alias("name"))).alias("named"), F.lit(True).alias("touched"),
        ).select(*[F.col(n).cast(t).alias(n) for n, t in types.items()])
        rows = held.where(F.col("mmsi").isNotNull()).withColumn("touched", F.lit(False)).unionByName(new)
        track = Window.partitionBy("mmsi").orderBy(F.coalesce("start", "static.at"), F.col("start").isNull())
        position = F.col("start").isNotNull()
        rows = rows.withColumn("_before", F.max("end").over(track.rowsBetween(Window.unboundedPreceding, -1)))
        fresh = F.coalesce(F.coalesce("start", "static.at") - F.col("_before") <= self.prune_us, F.lit(False))
        begun = F.max(F.when(position & ~fresh, F.col("start"))).over(track.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        # static messages that wait stay rows of their own
        rows = rows.withColumns({"_session": F.when(position | fresh, begun), "_waits": F.when(~position & ~fresh, F.col("static.at"))})
        return rows.groupBy("mmsi", "_session", "_waits").agg(
            F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("first", "start").alias("first"), F.max_by("fields", "end").alias("fields"),
            F.max_by("static", "static.at").alias("static"), F.max_by("named", "named.at").alias("named"), F.max("touched").alias("touched"),
        ).drop("_session", "_waits")

    def step(self, messages: DataFrame, query: str, batch: int) -> None:
        """Folds one micro-batch and publishes its changes; nothing happens where it is published already."""
        if self.sink.published(query, batch):
            return
        held, seen = self._held(query, batch)
        late = F.lit(True) if seen is None else F.col("at_us") >= F.lit(seen - self.late_us)
        rows = self._folded(held.where(self._reachable(seen)), messages.where(late & F.col("mmsi").isNotNull()))
        clock = self.spark.range(1).select(*[(F.lit(seen) if f.name == "end" else F.lit(None)).cast(f.dataType).alias(f.name) for f in held.schema.fields])
        rows.unionByName(clock).write.mode("overwrite").parquet(f"{self.path}/{query}/{batch:020d}")
        held, seen = self._held(query, batch + 1)
        self.sink.write(self._changes(held, seen), query, batch)
        for old in self.folder.names(query):
            if int(old) < batch:
                self.folder.delete(f"{query}/{old}")

    def _changes(self, held: DataFrame, seen: int | None) -> DataFrame:
        """Newest row of the vessels that sent something, or ``gone`` for those that the watermark has left behind."""
        last = last_wins(held.where(F.col("start").isNotNull()).withColumn("gone", ~self._reachable(seen)), ["mmsi"], ["start"])
        renamed = F.coalesce(F.col("named.at") > F.col("end"), F.lit(False))
        return last.where(F.col("touched") | F.col("gone")).select(
            "mmsi", "fields.lng", "fields.lat", F.when(renamed, F.col("named.name")).otherwise(F.col("fields.name")).alias("name"), "fields.sog", "fields.heading",
            F.when(F.col("static").isNotNull(), F.col("static.kind")).otherwise(F.col("first")).alias("ship_type"), F.col("end").alias("at_us"), "gone",
        )

    def start(self, messages: DataFrame, checkpoint: str) -> StreamingQuery:
        """The stream that keeps the sink; what has arrived is processed and the query ends."""
        def step(batch: DataFrame, number: int) -> None:
            self.step(batch, query_of(batch), number)

        return messages.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def present(vessels: DataFrame, now_us: Column, prune_s: float = V.VESSEL_PRUNE_S) -> DataFrame:
    """Vessels of the table that the clock has not left behind; the table itself lags by the lateness."""
    return vessels.where(F.col("at_us") >= now_us - F.lit(int(prune_s * 1_000_000)))


def use_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
