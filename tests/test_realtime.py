"""Binary feed files against hand-written bytes, their JSON form and damage of every kind."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from wayline.sources import messages as M
from wayline.sources import realtime as R


def varint(n):
    out = b""
    n &= 2**64 - 1
    while n > 127:
        out, n = out + bytes([n % 128 + 128]), n // 128
    return out + bytes([n])


def field(number, value):
    if isinstance(value, bytes):
        return varint(number * 8 + 2) + varint(len(value)) + value
    if isinstance(value, float):
        return varint(number * 8 + 5) + struct.pack("<f", value)
    return varint(number * 8) + varint(value)


HEADER = field(1, field(1, b"2.0") + field(2, 0) + field(3, 1_700_000_000))
VEHICLE = field(2, field(1, b"e1") + field(4, field(1, field(1, b"trip-1") + field(5, "Größe".encode())) + field(2, field(1, 42.5) + field(2, -71.25) + field(3, 90.0)) + field(3, 7)
                   + field(5, 1_700_000_001) + field(8, field(1, b"v1") + field(2, b"Bus 1"))) + field(99, b"later field") + varint(98 * 8 + 1) + bytes(8))
TRIP = field(2, field(1, b"t1") + field(3, field(1, field(5, b"R")) + field(2, field(4, b"s1") + field(2, field(2, 5)) + field(3, field(1, -30) + field(2, -9))) + field(2, field(4, b"s2"))))
ALERT = field(2, field(1, b"a1") + field(5, field(1, field(1, 10)) + field(5, field(2, b"R") + field(5, b"S")) + field(10, field(1, field(1, b"Delay") + field(2, b"en")))))


def rows(df):
    return [json.loads(r) for r in df.toJSON().collect()]


def test_hand_written_bytes_are_their_json_form(spark, tmp_path):
    (tmp_path / "feed.pb").write_bytes(HEADER + VEHICLE + TRIP + ALERT)
    read = R.read_binary(spark, str(tmp_path)).withColumns({"feed": F.lit("f"), "agency": F.lit("A")})
    vehicle = {"id": "e1", "vehicle": {"timestamp": 1_700_000_001, "position": {"latitude": 42.5, "longitude": -71.25, "bearing": 90.0}, "trip": {"tripId": "trip-1", "routeId": "Größe"}, "vehicle": {"id": "v1", "label": "Bus 1"}}}
    trip = {"id": "t1", "tripUpdate": {"trip": {"routeId": "R"}, "stopTimeUpdate": [{"stopId": "s1", "arrival": {"time": 5}, "departure": {"time": -9}}, {"stopId": "s2"}]}}
    alert = {"id": "a1", "alert": {"activePeriod": [{"start": 10}], "informedEntity": [{"routeId": "R", "stopId": "S"}], "headerText": {"translation": [{"text": "Delay", "language": "en"}]}}}
    payload = json.dumps({"header": {"timestamp": 1_700_000_000}, "entity": [vehicle, trip, alert]})
    text = spark.createDataFrame([("f", "A", payload)], "feed string, agency string, payload string")
    assert rows(M.binary_vehicle_entities(R.decoded(read, "vehicle"))) == rows(M.vehicle_entities(text)) != []
    assert rows(M.trip_updates(R.decoded(read, "trip"), parsed=True)) == rows(M.trip_updates(text)) != []
    got, want = rows(M.service_alerts(R.decoded(read, "alert"), parsed=True))[0], rows(M.service_alerts(text))[0]
    assert {k: v for k, v in got.items() if v != []} == {k: v for k, v in want.items() if v != []}


def test_quoted_numbers_and_bad_leaves(spark):
    sent = [{"header": {"timestamp": "1700000000"}, "entity": [{"id": "q", "vehicle": {"timestamp": "5", "position": {"latitude": "42.5", "longitude": -71}}}, {"id": "bad", "vehicle": {"position": {"latitude": "n/a"}}}]}]
    text = spark.createDataFrame([("f", "A", json.dumps(m)) for m in sent] + [("f", "A", "{broken"), ("f", "A", None), ("f", "A", "{}")], "feed string, agency string, payload string")
    got = {r["id"]: (r["header_timestamp"], r["vehicle"]["timestamp"], r["vehicle"]["position"]["latitude"]) for r in M.vehicle_entities(text).collect()}
    assert got == {"q": (1_700_000_000, 5, 42.5), "bad": (1_700_000_000, None, None)}


def test_a_number_in_quotes_is_read_and_converted_once(spark):
    vehicle = lambda n, **p: {"id": n, "vehicle": {"timestamp": p.pop("at", 7), "position": p, "trip": {"routeId": p.pop("route", "r")}}}
    entities = [
        vehicle("n/a", latitude="n/a", longitude=-71.5, at="soon"), vehicle("text", latitude=" 42.5 ", longitude="1e2", bearing="", at="5"), vehicle("plain", latitude=42, longitude=-71.25, speed=3),
        vehicle("far", latitude="Infinity", longitude="NaN", at="NaN"), vehicle("name", latitude=1.5, longitude=2.5, route='"speed":"x"'), {"id": "none", "vehicle": None}, {"id": "bare", "vehicle": {"timestamp": None}},
    ]
    sent = [{"header": {"timestamp": 9}, "entity": entities}, *[{"header": {"timestamp": 9}, "entity": [e]} for e in entities]]
    text = spark.createDataFrame([("f", "A", json.dumps(m)) for m in sent], "feed string, agency string, payload string")
    read = M.vehicle_entities(text)
    place = lambda r: r["vehicle"]["position"] and tuple(r["vehicle"]["position"])
    got = sorted((r["id"], r["vehicle"]["timestamp"], place(r)) for r in read.collect())
    want = [("bare", None, None), ("far", None, (None, None, None, None)), ("n/a", None, (None, -71.5, None, None)), ("name", 7, (1.5, 2.5, None, None)), ("plain", 7, (42.0, -71.25, None, 3.0)), ("text", 5, (42.5, 100.0, None, None))]
    assert got == sorted(want * 2, key=lambda w: w[0])
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    # five numbers of an entity and the clock of the header, which a projection evaluates once; the first reading leaves out what it cannot read
    assert plan.count("trim(") <= 7 and "RLIKE" in plan


def test_damage_goes_to_the_dead_letters(spark):
    whole = HEADER + VEHICLE
    cases = {
        "whole": whole, "cut": whole[:-3], "cut number": whole[:1], "group": whole + bytes([11]), "wrong type": field(2, 5), "no text": field(2, field(1, b"\xff")),
        "number where text is": field(2, field(4, field(8, field(1, 3)))), "endless": bytes([8]) + b"\xff" * 11, "empty": b"", "null": None,
    }
    sent = spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in cases.items()], "name string, content binary")
    out = R.decoded(sent, "vehicle")
    assert {r["name"] for r in out.where("m is not null").collect()} == {"whole", "empty", "null"}
    reasons = {r["name"]: r["reason"] for r in R.damaged(out).collect()}
    assert set(reasons) == set(cases) - {"whole", "empty", "null"} and all(reasons.values())


def test_delimited_files_keep_what_comes_before_the_cut(spark, tmp_path):
    whole, odd = HEADER + VEHICLE, field(2, 5)
    (tmp_path / "a.pb").write_bytes(b"".join(varint(len(d)) + d for d in (whole, odd, whole, whole))[:-4])
    (tmp_path / "b.pb").write_bytes(b"")
    out = R.decoded(R.read_binary(spark, str(tmp_path)), "vehicle", delimited=True)
    assert out.where("m is not null").count() == 2 and R.damaged(out).count() == 2


def test_files_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.pb").write_bytes(HEADER + VEHICLE * (i + 1))
    read = R.decoded(R.read_binary(spark, str(tmp_path / "in"), stream=True).withColumns({"feed": F.lit("f"), "agency": F.lit("A")}), "vehicle")
    query = M.binary_vehicle_entities(read).writeStream.format("memory").queryName("vehicles").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("vehicles").count() == 6


@pytest.mark.parametrize("kind", ["vehicle", "trip", "alert"])
def test_round_trip(kind):
    fields = R.MESSAGES[kind][1]
    message = R.decode(HEADER + VEHICLE + TRIP + ALERT, fields)
    assert R.decode(R.encode(message, fields), fields) == message
    assert R.decode(b"", fields) == {"header": None, "entity": []}


def test_batches_are_read_in_slices():
    """However many rows a batch has, few of them and few bytes are Python objects at a time; a long message comes alone."""
    import pyarrow as pa

    from wayline.sources import realtime

    sizes = lambda contents: [s.num_rows for s in realtime._slices(pa.RecordBatch.from_pydict({"content": contents}), "content")]
    assert max(sizes([b"x"] * 10_000)) <= realtime.SLICE_ROWS and sum(sizes([b"x"] * 10_000)) == 10_000
    assert sizes([b"x" * realtime.SLICE_BYTES] * 5) == [1] * 5 and sizes([]) == []
