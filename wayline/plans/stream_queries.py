"""Streaming jobs replayed over the given tables, and the batch operators with the same rules."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wayline.operators.regions import assign_regions, in_region
from wayline.plans.base import FIX, REGISTRY, START_US, edge_values, fixes, inside_cte, query, region_edges, table, with_ctes
from wayline.plans.poll_queries import polls as daily_polls
from wayline.plans.source_queries import VMSG, malformed_payloads, vessel_messages
from wayline.session import cut_lineage, scratch_folder
from wayline.sources.messages import vessel_rows
from wayline.streaming import live, polls, vessels

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
PRUNE = 86400


FOLD = f"""p AS (SELECT *, max(CASE WHEN NOT st THEN at_us END) OVER (PARTITION BY mmsi ORDER BY at_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM vm),
f AS (SELECT *, coalesce(at_us - prev <= {PRUNE}000000, FALSE) AS fresh FROM p),
s AS (SELECT *, max(CASE WHEN NOT st AND NOT fresh THEN at_us END) OVER (PARTITION BY mmsi ORDER BY at_us) AS session FROM f WHERE NOT st OR fresh),
last AS (SELECT * FROM s WHERE session = (SELECT max(session) FROM s x WHERE x.mmsi = s.mmsi)),
pos AS (SELECT * FROM last WHERE NOT st QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY at_us DESC) = 1),
fst AS (SELECT * FROM last WHERE NOT st QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY at_us) = 1),
sta AS (SELECT * FROM last WHERE st QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY at_us DESC) = 1),
nam AS (SELECT mmsi, name, at_us FROM last WHERE st AND name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY at_us DESC) = 1)"""
FOLDED = """SELECT pos.mmsi, pos.lng, CASE WHEN nam.at_us > pos.at_us THEN nam.name ELSE pos.name END AS name, pos.heading, CASE WHEN sta.mmsi IS NOT NULL THEN sta.kind ELSE fst.kind END AS ship_type, pos.at_us
FROM pos JOIN fst USING (mmsi) LEFT JOIN sta USING (mmsi) LEFT JOIN nam USING (mmsi)"""


def _parsed_messages(spark, sf):
    """Parsed once: the fold reads its rows twice, the clock once more."""
    return cut_lineage(vessel_rows(vessel_messages(spark, sf), "at_us"))


@query("SS01", with_ctes(FIX, VMSG, FOLD, FOLDED))
def vessel_fold(spark, sf):
    return vessels.fold_vessels(_parsed_messages(spark, sf), prune_s=PRUNE).select("mmsi", "lng", "name", "heading", "ship_type", "at_us")


CLOCK = "(SELECT max(at_us) FROM vm)"


def _clocked(spark, sf):
    rows = _parsed_messages(spark, sf)
    end = rows.agg(F.max("at_us")).first()[0]
    return vessels.fold_vessels(rows, prune_s=PRUNE, now_us=F.lit(end))


@query("SS01 SS02", with_ctes(FIX, VMSG, FOLD, f"SELECT * FROM ({FOLDED}) WHERE at_us >= {CLOCK} - {PRUNE}000000"))
def vessels_at_the_end(spark, sf):
    """The fold with a clock: vessels silent for the prune time at the end are gone."""
    return _clocked(spark, sf).select("mmsi", "lng", "name", "heading", "ship_type", "at_us")


@query("SS07", with_ctes(FIX, VMSG, FOLD, f"seen AS (SELECT pos.mmsi, pos.lng, pos.lat, pos.at_us FROM pos WHERE pos.at_us >= {CLOCK} - {PRUNE}000000)", edge_values(), inside_cte("seen", key="mmsi"),
                         "SELECT DISTINCT mmsi, lng, lat FROM seen JOIN inside USING (mmsi) WHERE region = 'me'"))
def vessels_in_region(spark, sf):
    """The region filters what is shown and not the state behind it."""
    rows = assign_regions(_clocked(spark, sf), region_edges(spark))
    return rows.where(in_region(F.col("regions"), "me")).select("mmsi", "lng", "lat")


def _event_stream(spark, sf):
    e = live.table_stream(spark, sf, "events", EVENTS)
    return e.select(
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), F.concat(F.lit("s"), (F.col("user_id") % 4).cast("string")).alias("source"),
        F.col("event_type").alias("grp"), F.col("user_id").alias("entity"), F.col("event_id").alias("id"), F.col("value").alias("speed"),
    )


@query("SS08", with_ctes(FIX, "SELECT source, grp, count(*) AS n FROM fix GROUP BY source, grp"))
def live_counts(spark, sf):
    folder = f"{scratch_folder(spark)}/{uuid.uuid4().hex}"
    live.versioned_sink(live.live_counts(_event_stream(spark, sf)), f"{folder}/out", f"{folder}/cp").awaitTermination()
    return live.newest_version(spark, f"{folder}/out", ["source", "grp"]).select("source", "grp", "n")


def _positions(spark, sf, columns):
    folder = f"{scratch_folder(spark)}/{uuid.uuid4().hex}"
    fixes = _event_stream(spark, sf).select(*columns)
    table = live.positions_table(spark, f"{folder}/table", ["entity"], ["ts_us", "id"], ", ".join(f"{n} {t}" for n, t in fixes.dtypes))
    table.start(fixes, f"{folder}/cp").awaitTermination()
    return table.read()


@query("SS10 WN09", with_ctes(FIX, "SELECT entity, id, ts_us FROM fix QUALIFY row_number() OVER (PARTITION BY entity ORDER BY ts_us DESC, id DESC) = 1"))
def last_positions(spark, sf):
    return _positions(spark, sf, ["entity", "id", "ts_us"])


@query("SS08", with_ctes(FIX, "newest AS (SELECT * FROM fix QUALIFY row_number() OVER (PARTITION BY entity ORDER BY ts_us DESC, id DESC) = 1)",
                         "SELECT source, grp, count(*) AS n FROM newest WHERE ts_us >= (SELECT max(ts_us) FROM fix) - 86400000000 GROUP BY source, grp"))
def present_entities(spark, sf):
    """Entities now present, from the streamed last positions."""
    now = _positions(spark, sf, ["entity", "id", "ts_us", "source", "grp"])
    end = now.agg(F.max("ts_us")).first()[0]
    return live.present_counts(now, F.lit(end), 86400)


@query("AG01 SS10", REGISTRY["ordered_dedupe"].sql)
def fixes_sent_twice(spark, sf):
    """Every third fix arrives again a part later; within the lateness it is one, and the newest per entity stays."""
    folder = f"{scratch_folder(spark)}/{uuid.uuid4().hex}"
    rows = fixes(spark, sf).select("entity", (F.col("id") % 3).alias("probe"), F.col("id").alias("pos"), "lng", "ts_us")
    part = F.floor((F.col("ts_us") - F.lit(START_US)) / F.lit(PART_S * 1_000_000)).cast("int")
    sent = cut_lineage(rows.withColumn("part", part).unionByName(rows.where("probe = 0").withColumn("part", part + 1)))
    kept = live.positions_table(spark, f"{folder}/table", ["entity"], ["probe", "pos"], "entity bigint, probe bigint, pos bigint, lng double")
    for i in range((sent.agg(F.max("part")).first()[0] or 0) + 1):
        sent.where(F.col("part") == i).drop("part").write.parquet(f"{folder}/in/part={i}")
        arriving = spark.readStream.schema("entity bigint, probe bigint, pos bigint, lng double, ts_us bigint").option("maxBytesPerTrigger", live.MOST_BYTES).parquet(f"{folder}/in/part=*")
        once = live.deduped(arriving.withColumn("at", F.timestamp_micros("ts_us")), ["entity", "pos"], "at", f"{2 * PART_S} seconds")
        kept.start(once.select("entity", "probe", "pos", "lng"), f"{folder}/cp").awaitTermination()
    return kept.read()


# a vessel per user and digit: most are silent for days
PART_S = 10 * 86400
MANY = VMSG.replace("entity AS mmsi", "entity * 10 + id % 10 AS mmsi")


def _arrivals(rows, at_us, folder, part_s=PART_S):
    """``rows`` by time of arrival: an iterator that writes one part after the other into ``folder``, each as large as it is."""
    part = F.floor((at_us - F.lit(START_US)) / F.lit(part_s * 1_000_000)).cast("int")
    last = rows.agg(F.max(part)).first()[0]
    for i in range(0 if last is None else last + 1):
        rows.where(part == i).write.parquet(f"{folder}/part={i}")
        yield i


@query("SS01 SS02", with_ctes(FIX, MANY, FOLD, f"""SELECT *, at_us >= {CLOCK} - {PRUNE}000000 AS present FROM ({FOLDED}) WHERE at_us >= {CLOCK} - {PRUNE + PART_S}000000"""))
def vessels_streamed(spark, sf):
    """Messages replayed part by part through the table of sessions into the upsert table; ``present`` by the clock of the last message.

    The stream ends and starts again from its checkpoint for every part. Within a part messages come in any order, which is the lateness;
    vessels silent for longer than that and the prune time have been taken out of the table.
    """
    folder = f"{scratch_folder(spark)}/{uuid.uuid4().hex}"
    sent = vessel_messages(spark, sf, F.col("entity") * 10 + F.col("id") % 10)
    table = vessels.vessel_table(spark, f"{folder}/table")
    sessions = vessels.VesselSessions(table, f"{folder}/sessions", late_s=PART_S, prune_s=PRUNE)
    for _ in _arrivals(sent, F.col("at_us"), f"{folder}/in"):
        arriving = spark.readStream.schema("at_us bigint, payload string").option("maxBytesPerTrigger", live.MOST_BYTES).parquet(f"{folder}/in/part=*")
        sessions.start(vessel_rows(arriving, "at_us"), f"{folder}/cp").awaitTermination()
    end = sent.agg(F.max("at_us")).first()[0]
    now = table.read().select("mmsi", "lng", "name", "heading", "ship_type", "at_us")
    return now.withColumn("present", F.col("at_us") >= F.lit(end) - F.lit(PRUNE * 1_000_000))


def _polled(spark, events, arrives, hold_s=300.0):
    """The poll table after ``events`` arrived in parts (``arrives``), with the stream started again for each."""
    folder = f"{scratch_folder(spark)}/{uuid.uuid4().hex}"
    table = polls.PollTable(spark, f"{folder}/table", hold_s=hold_s)
    events = cut_lineage(events.withColumn("_part", arrives))
    for i in range((events.agg(F.max("_part")).first()[0] or 0) + 1):
        events.where(F.col("_part") == i).drop("_part").write.parquet(f"{folder}/in/part={i}")
        arriving = spark.readStream.schema(polls.EVENTS).option("maxBytesPerTrigger", live.MOST_BYTES).parquet(f"{folder}/in/part=*")
        table.start(arriving, f"{folder}/cp").awaitTermination()
    return table


@query("SS03 WN09", REGISTRY["snapshot_diff"].sql)
def polls_streamed(spark, sf):
    """Daily polls whose rows arrive half in time and half a part later: the same changes as over whole snapshots."""
    events = polls.poll_events(daily_polls(spark, sf), F.col("poll") * 86_400_000_000)
    late = F.when((F.col("mark") == "row") & (F.col("entity").cast("bigint") % 2 == 1), 1).otherwise(0)
    table = _polled(spark, events, (F.floor(F.col("poll") / 11) + late).cast("int"))
    return table.changes().withColumn("entity", F.col("entity").cast("bigint"))


@query("SS04", REGISTRY["last_good"].sql)
def polls_served(spark, sf):
    """Good and failed polls as marks: what answers each of them."""
    p = fixes(spark, sf).groupBy("source", "ts_us").agg((F.min("grp") != "error").alias("ok"))
    none = F.lit(None)
    events = p.select("source", F.col("ts_us").alias("poll"), F.when(F.col("ok"), "end").otherwise("fail").alias("mark"), none.cast("string").alias("entity"),
                      none.cast("double").alias("lng"), none.cast("double").alias("lat"), F.col("ts_us").alias("at_us"), F.when(F.col("ok"), F.lit(0)).cast("bigint").alias("n"))
    table = _polled(spark, events, F.floor((F.col("at_us") - F.lit(START_US)) / F.lit(PART_S * 1_000_000)).cast("int"), hold_s=7200)
    return table.served().select("source", "ts_us", "served", "served_us")


@query("SS06", REGISTRY["newest_generation"].sql)
def generations_streamed(spark, sf):
    """Seven requests of every source whose answers come newest first and last: the older ones are fenced."""
    d = table(spark, sf, "documents").select("source", (F.col("doc_id") % 7).alias("poll"), F.col("doc_id").alias("entity"), F.lit(0.0).alias("lng"), F.lit(0.0).alias("lat"))
    events = polls.poll_events(d, F.col("poll") * 1_000_000)
    return _polled(spark, events, ((F.col("poll") + 1) % 2).cast("int")).current().select("source", F.col("poll").alias("seq"), F.col("entity").cast("bigint").alias("doc_id"))


@query("SS09", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'dead' ELSE 'good' END AS outcome FROM documents")
def malformed_stream(spark, sf):
    """Messages arrive as files; those that do not parse go to the dead-letter side and the stream goes on."""
    from wayline import schemas as S

    folder = f"{scratch_folder(spark)}/{uuid.uuid4().hex}"
    malformed_payloads(spark, sf).write.parquet(f"{folder}/in.parquet")
    sent = spark.readStream.schema("doc_id bigint, payload string").option("maxBytesPerTrigger", live.MOST_BYTES).parquet(f"{folder}/in.parquet")
    live.split_malformed(sent, S.VEHICLE_MESSAGE, f"{folder}/out", f"{folder}/cp").awaitTermination()
    read = lambda side: spark.read.parquet(f"{folder}/out/{side}").select("doc_id", F.lit(side).alias("outcome"))
    return read("good").unionByName(read("dead"))
