"""Streams replayed from files equal the batch operators."""

import os
import random

import pytest
from pyspark.sql import functions as F

from wayline import schemas as S
from wayline.streaming import live, polls, upserts, vessels

MESSAGE = "mmsi bigint, at_us bigint, is_static boolean, lng double, lat double, name string, sog double, heading double, ship_type double"


def write_in_order(df, folder, i):
    """One file per micro-batch, with modification times that keep their order."""
    df.coalesce(1).write.parquet(str(folder / f"part={i}"))
    for f in (folder / f"part={i}").glob("*.parquet"):
        os.utime(f, (1_700_000_000 + i * 60,) * 2)


def messages(n=400):
    rng = random.Random(9)
    rows, at = [], 1_700_000_000_000_000
    for i in range(n):
        at += rng.choice([5, 60, 200, 700]) * 1_000_000 + 1
        static = rng.random() < 0.3
        kind = float(rng.randint(50, 70)) if rng.random() < 0.6 else None
        name = rng.choice(["Alpha", "Beta", None]) if static else rng.choice(["Alpha", ""])
        rows.append((rng.randint(1, 6), at, static, None if static else -71.0 + i / 1e4, None if static else 42.0, name, None if static else 3.0, None if static else 90.0, kind))
    return rows


def plain_state(rows, prune_us):
    """Arrival-order rules on a dictionary."""
    state = {}
    for m, at, static, lng, lat, name, sog, heading, kind in rows:
        old = state.get(m)
        if old and at - old["at"] > prune_us:
            old = None
        if static:
            if old:
                old["kind"] = kind
                old["name"] = name if name is not None else old["name"]
        else:
            state[m] = {"lng": lng, "name": name, "kind": old["kind"] if old else kind, "at": at}
    return {(m, s["lng"], s["name"], s["kind"], s["at"]) for m, s in state.items()}


@pytest.mark.parametrize("width_s", [60, 3600, 10**7])
def test_fold_matches_arrival_order(spark, width_s):
    rows = messages()
    folded = vessels.fold_vessels(spark.createDataFrame(rows, MESSAGE), 600, F.floor(F.col("at_us") / (width_s * 1_000_000)))
    assert {tuple(r) for r in folded.select("mmsi", "lng", "name", "ship_type", "at_us").collect()} == plain_state(rows, 600_000_000)


@pytest.mark.parametrize("prune_s", [1, 90, 600, 7200, 10**6])
def test_fold_reads_few_spans_and_sorts_none_of_its_messages(spark, prune_s):
    rows = [r for seed in range(3) for r in [(r[0] + 10 * seed, *r[1:]) for r in messages(300)][seed * 7 :]]
    random.Random(prune_s).shuffle(rows)
    # a vessel with static messages alone, and messages without a vessel or a time
    rows += [(99, 1_700_000_000_000_000 + i, True, None, None, "Alpha", None, None, 1.0) for i in range(3)]
    sent = spark.createDataFrame([*rows, (None, *rows[0][1:]), (rows[0][0], None, *rows[0][2:])], MESSAGE)
    got = lambda df: {tuple(r) for r in df.select("mmsi", "lng", "name", "ship_type", "at_us").collect()}
    want, end = plain_state(sorted(rows, key=lambda r: r[1]), prune_s * 1_000_000), max(r[1] for r in rows)
    folded = vessels.fold_vessels(sent, prune_s)
    assert got(folded) == want
    assert got(vessels.fold_vessels(sent, prune_s, now_us=F.lit(end))) == {s for s in want if end - s[4] <= prune_s * 1_000_000}

    def nodes(node):
        yield node
        for i in range(node.children().size()):
            yield from nodes(node.children().apply(i))

    windows = [n.output().mkString(" ") for n in nodes(folded._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "Window"]
    assert windows and not any("lng" in w or "is_static" in w for w in windows)


def test_stream_matches_fold(spark, tmp_path):
    rows = messages(240)
    rng = random.Random(2)
    vessels.use_rocksdb(spark)
    # arrival is out of order by up to an hour; a fifth of the vessels only ever send static messages
    rows = [(m + 100, *r[:1], True, None, None, r[4], None, None, r[7]) if m == 3 else (m, *r) for m, *r in rows]
    arrival = sorted(rows, key=lambda r: r[1] + rng.randint(0, 3_500_000_000))
    table = vessels.vessel_table(spark, str(tmp_path / "table"))
    for i in range(4):
        write_in_order(spark.createDataFrame(arrival[i * 60 : (i + 1) * 60], MESSAGE), tmp_path / "in", i)
    source = spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/part=*"))
    table.start(vessels.vessel_stream(source, late="1 hour"), str(tmp_path / "cp"), mode="update").awaitTermination()
    end, state = max(r[1] for r in rows), plain_state(rows, 600_000_000)
    got = lambda df: {tuple(r) for r in df.select("mmsi", "lng", "name", "ship_type", "at_us").collect()}
    # the table has taken out whoever was silent beyond the lateness and the prune time; the clock at the end goes further
    lag = 3_600_000_000
    want = {s for s in state if s[4] >= end - lag - 600_000_000}
    assert got(table.read()) == want
    assert got(vessels.present(table.read(), F.lit(end))) == {s for s in state if end - s[4] <= 600_000_000}


def test_silent_vessels_leave_the_table(spark, tmp_path):
    vessels.use_rocksdb(spark)
    minute, start = 60_000_000, 1_700_000_000_000_000
    one = lambda m, at: (m, start + at * minute, False, -71.0, 42.0, "x", 1.0, 2.0, None)
    parts = [[one(1, 0), one(2, 0)], [one(2, 30)], [one(2, 60), one(3, 60)], [one(1, 90)]]
    table, seen = vessels.vessel_table(spark, str(tmp_path / "table")), []
    for i, part in enumerate(parts):
        write_in_order(spark.createDataFrame(part, MESSAGE), tmp_path / "in", i)
        source = spark.readStream.schema(MESSAGE).parquet(str(tmp_path / "in/part=*"))
        table.start(vessels.vessel_stream(source), str(tmp_path / "cp"), mode="update").awaitTermination()
        seen.append({r["mmsi"] for r in table.read().collect()})
    assert seen == [{1, 2}, {2}, {2, 3}, {1}]


@pytest.mark.parametrize("seed", range(6))
def test_track_in_any_order(seed):
    rng = random.Random(seed)
    rows = [r for r in messages(60) if r[0] <= 2]
    for vessel in (1, 2):
        mine = [r for r in rows if r[0] == vessel]
        shuffled = mine[:]
        rng.shuffle(shuffled)
        track = vessels.Track(600_000_000)
        for m, at, static, lng, lat, name, sog, heading, kind in shuffled:
            track = vessels.Track(600_000_000, track.held())
            if static:
                track.static(at, kind, name)
            else:
                track.position(at, kind, [lng, lat, name, sog, heading])
        row = track.row()
        assert {(vessel, row[0], row[2], row[5], row[6])} == plain_state(mine, 600_000_000)


def test_upsert_table_stays_as_small_as_its_live_keys(spark, tmp_path):
    table = upserts.UpsertTable(spark, str(tmp_path / "t"), ["k"], ["_version"], "k long, v long, gone boolean", deleted="gone", compact_every=5, keep=2)
    state, rng = {}, random.Random(3)
    for number in range(50):
        rows = [(rng.randint(0, 9), number * 100 + i, rng.random() < 0.3) for i in range(4)]
        rows = list({r[0]: r for r in rows}.values())
        batch = spark.createDataFrame(rows, "k long, v long, gone boolean")
        table.write(batch, "query", number)
        if number in (7, 33):  # Spark runs a micro-batch again
            table.write(batch, "query", number)
        for k, v, gone in rows:
            state.pop(k, None) if gone else state.__setitem__(k, v)
        if number % 10 == 9:
            assert {(r["k"], r["v"]) for r in table.read().collect()} == set(state.items())
    manifest = table._manifest()
    assert manifest["version"] == 49 and len(manifest["deltas"]) < 5
    assert len(list((tmp_path / "t/manifests").glob("*.json"))) <= 3 and len(list((tmp_path / "t/rows").iterdir())) <= 12
    read = spark.read.parquet(*[str(tmp_path / "t/rows" / n) for n in [manifest["base"], *manifest["deltas"]]]).count()
    assert read <= 10 + 4 * 4  # live keys and the micro-batches since
    with pytest.raises(ValueError):
        upserts.UpsertTable(spark, str(tmp_path / "u"), ["k"], ["v"], "k long", deleted="gone")


def test_an_attempt_that_failed_leaves_nothing(spark, tmp_path, monkeypatch):
    table = upserts.UpsertTable(spark, str(tmp_path / "t"), ["k"], ["_version"], "k long, v long")
    one, two = spark.createDataFrame([(1, 1)], "k long, v long"), spark.createDataFrame([(1, 2), (2, 2)], "k long, v long")
    table.write(one, "q", 0)
    monkeypatch.setattr(upserts.Folder, "publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        table.write(two, "q", 1)
    monkeypatch.undo()
    assert [tuple(r) for r in table.read().collect()] == [(1, 1)]
    table.write(two, "q", 1)
    table.write(one, "other", 0)  # another query has numbers of its own
    assert {tuple(r) for r in table.read().collect()} == {(1, 1), (2, 2)}
    assert len(list((tmp_path / "t/rows").iterdir())) == 3
    with pytest.raises(RuntimeError):
        table.folder.publish(f"manifests/{2:020d}.json", "{}")


def test_polls_in_pieces(spark, tmp_path):
    none = (None, None, None)
    row = lambda p, e, x: ("s", p, "row", e, x, 0.0, p * 60_000_000, None)
    end = lambda p, n: ("s", p, "end", *none, p * 60_000_000, n)
    fail = lambda p: ("s", p, "fail", *none, p * 60_000_000, None)
    table = polls.PollTable(spark, str(tmp_path / "t"), hold_s=300, compact_every=3)
    steps = [
        [row(1, "a", 1.0), end(1, 2)],  # not whole yet
        [row(1, "b", 1.0), row(3, "a", 1.0), row(2, "a", 9.0), end(2, 5)],
        [end(3, 2), row(3, "c", 1.0), row(3, "c", 1.0)],  # a repeated row; the second poll is never whole
        [row(2, "z", 1.0), fail(4)],  # an answer to an older request, a failure
        [fail(9), ("s", None, "row", "a", 1.0, 0.0, 0, None)],
        [end(10, 0)],  # an empty snapshot
        [row(11, "a", 2.0), end(11, 1), row(12, "a", 3.0), end(12, 1)],  # two polls at once
    ]
    shown = []
    for number, events in enumerate(steps):
        batch = spark.createDataFrame(events, polls.EVENTS)
        for _ in range(2 if number in (2, 5) else 1):  # some micro-batches run twice
            table.settle(batch, "q", number)
        shown.append({(r["poll"], r["entity"], r["lng"]) for r in table.current().collect()})
    assert shown == [set(), {(1, "a", 1.0), (1, "b", 1.0)}, {(3, "a", 1.0), (3, "c", 1.0)}, {(3, "a", 1.0), (3, "c", 1.0)}, {(3, "a", 1.0), (3, "c", 1.0)}, set(), {(12, "a", 3.0)}]
    assert {(r["poll"], r["entity"], r["change"]) for r in table.changes().collect()} == {
        (1, "a", "new"), (1, "b", "new"), (3, "a", "same"), (3, "b", "gone"), (3, "c", "new"), (10, "a", "gone"), (10, "c", "gone"), (11, "a", "new"), (12, "a", "moved"),
    }
    served = {(r["ts_us"] // 60_000_000): (r["served"], r["served_us"] and r["served_us"] // 60_000_000) for r in table.served().collect()}
    assert served == {1: ("live", 1), 3: ("live", 3), 4: ("last-good", 3), 9: ("unavailable", None), 10: ("live", 10), 11: ("live", 11), 12: ("live", 12)}
    assert [(r["entity"], r["stale"]) for r in table.aged(F.lit(14 * 60_000_000), 60).collect()] == [("a", True)] and table.aged(F.lit(18 * 60_000_000), 60).count() == 0
    assert table.table.read().where("kind in ('row', 'mark')").count() == 0  # nothing open is kept once it is over


def test_malformed_stream_goes_on(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"ac":[{"hex":"x"}]}\n{broken\n')
    source = spark.readStream.text(str(tmp_path / "in")).withColumnRenamed("value", "payload")
    live.split_malformed(source, S.AIRCRAFT_MESSAGE, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/good")).count() == 1
    assert spark.read.parquet(str(tmp_path / "out/dead")).first().payload == "{broken"


def test_sessions_match_arrival_order(spark, tmp_path):
    """The table of sessions gives the states of the keyed stream without a Python call per vessel, from messages out of order."""
    rows = messages(240)
    rng = random.Random(2)
    rows = [(m + 100, *r[:1], True, None, None, r[4], None, None, r[7]) if m == 3 else (m, *r) for m, *r in rows]
    arrival = sorted(rows, key=lambda r: r[1] + rng.randint(0, 3_500_000_000))
    table = vessels.vessel_table(spark, str(tmp_path / "table"))
    sessions = vessels.VesselSessions(table, str(tmp_path / "sessions"), late_s=3600)
    for i in range(4):
        sessions.step(spark.createDataFrame(arrival[i * 60 : (i + 1) * 60], MESSAGE), "q", i)
    sessions.step(spark.createDataFrame(arrival[180:], MESSAGE), "q", 3)  # runs again
    end, state = max(r[1] for r in rows), plain_state(rows, 600_000_000)
    got = {tuple(r) for r in table.read().select("mmsi", "lng", "name", "ship_type", "at_us").collect()}
    assert got == {s for s in state if s[4] >= end - 3_600_000_000 - 600_000_000}
    assert len(sessions.folder.names("q")) == 1


def test_replayed_vessels_need_no_python_per_vessel(spark, monkeypatch):
    from wayline.plans.base import REGISTRY

    monkeypatch.setattr(vessels, "vessel_stream", None)
    assert REGISTRY["vessels_streamed"].run(spark, "/root/testdata/sf0.001").count() > 0
