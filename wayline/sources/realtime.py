"""Binary realtime feeds: the wire form of feed messages, decoded in Arrow batches to the same rows as their JSON form.

Files are read with Spark's ``binaryFile`` source, in batch or as a stream, so listing, partitions and offsets are Spark's and any file
system it reads will do. A file holds one message, or messages each after their length (``delimited``). A message that is cut off or does
not follow the wire rules becomes a dead letter, the others of its file stay. Unknown fields are passed over.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from wayline import schemas as S
from wayline.sources.messages import CORRUPT

_VARINT, _FIXED64, _BYTES, _FIXED32 = 0, 1, 2, 5
# Field numbers of the public feed message format, with the name and kind that a field has in the JSON form
_TEXT_FIELD = {"translation": (1, [{"text": (1, "string"), "language": (2, "string")}])}
_SELECTOR = {"routeId": (2, "string"), "stopId": (5, "string")}
_TRIP = {"tripId": (1, "string"), "routeId": (5, "string")}
_EVENT = {"time": (2, "int")}
_HEADER = {"timestamp": (3, "int")}
VEHICLE = {
    "timestamp": (5, "int"), "position": (2, {"latitude": (1, "float"), "longitude": (2, "float"), "bearing": (3, "float"), "speed": (5, "float")}),
    "trip": (1, _TRIP), "vehicle": (8, {"id": (1, "string"), "label": (2, "string")}),
}
TRIP_UPDATE = {"trip": (1, _TRIP), "stopTimeUpdate": (2, [{"stopId": (4, "string"), "arrival": (2, _EVENT), "departure": (3, _EVENT)}])}
ALERT = {
    "activePeriod": (1, [{"start": (1, "int"), "end": (2, "int")}]), "informedEntity": (5, [_SELECTOR]), "headerText": (10, _TEXT_FIELD), "descriptionText": (11, _TEXT_FIELD),
}
MESSAGES = {
    "vehicle": (S.VEHICLE_NUMBERS, {"header": (1, _HEADER), "entity": (2, [{"id": (1, "string"), "vehicle": (4, VEHICLE)}])}),
    "trip": (S.TRIP_MESSAGE, {"header": (1, _HEADER), "entity": (2, [{"id": (1, "string"), "tripUpdate": (3, TRIP_UPDATE)}])}),
    "alert": (S.ALERT_MESSAGE, {"header": (1, _HEADER), "entity": (2, [{"id": (1, "string"), "alert": (5, ALERT)}])}),
}


SLICE_BYTES, SLICE_ROWS = 1 << 20, 256  # of a batch that are Python objects at a time


class Damaged(ValueError):
    """Bytes that do not follow the wire rules."""


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise Damaged("a number is cut off")
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value & (1 << 64) - 1, at


def _fields(data: bytes) -> Iterator[tuple[int, int, Any]]:
    """(field number, wire type, value) in order; length-delimited values as bytes."""
    at = 0
    while at < len(data):
        tag, at = varint(data, at)
        wire = tag & 7
        if wire == _VARINT:
            value, at = varint(data, at)
        else:
            if wire == _BYTES:
                size, at = varint(data, at)
            elif wire in (_FIXED64, _FIXED32):
                size = 8 if wire == _FIXED64 else 4
            else:
                raise Damaged(f"wire type {wire} is not in use")
            if at + size > len(data):
                raise Damaged("a field is cut off")
            value, at = data[at : at + size], at + size
        yield tag >> 3, wire, value


def _scalar(kind: str, wire: int, value: Any) -> Any:
    if kind == "string" and wire == _BYTES:
        return value.decode()  # text that is no UTF-8 damages the message
    if kind == "int" and wire == _VARINT:
        return value - (1 << 64) if value >> 63 else value
    if kind == "float" and wire == _FIXED32:
        return struct.unpack("<f", value)[0]
    raise Damaged(f"a {kind} has wire type {wire}")


def decode(data: bytes, fields: dict) -> dict:
    """A message as nested dictionaries with all of ``fields``; absent ones are null, repeated ones lists."""
    by_number = {number: (name, kind) for name, (number, kind) in fields.items()}
    out: dict = {name: [] if isinstance(kind, list) else None for name, (_, kind) in fields.items()}
    for number, wire, value in _fields(data):
        if number not in by_number:
            continue
        name, kind = by_number[number]
        if isinstance(kind, (list, dict)) and wire != _BYTES:
            raise Damaged(f"{name} has wire type {wire}")
        if isinstance(kind, list):
            out[name].append(decode(value, kind[0]))
        else:
            out[name] = decode(value, kind) if isinstance(kind, dict) else _scalar(kind, wire, value)
    return out


def _number(value: int) -> bytes:
    out, value = bytearray(), value & (1 << 64) - 1
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes(out) + bytes([value])


def encode(message: dict | None, fields: dict) -> bytes:
    """What ``decode`` reads; null fields are left out."""
    out = []
    for name, (number, kind) in fields.items():
        value = (message or {}).get(name)
        for one in [] if value is None else value if isinstance(kind, list) else [value]:
            if kind == "int":
                out += [_number(number << 3 | _VARINT), _number(int(one))]
            elif kind == "float":
                out += [_number(number << 3 | _FIXED32), struct.pack("<f", one)]
            else:
                data = one.encode() if kind == "string" else encode(one, kind[0] if isinstance(kind, list) else kind)
                out += [_number(number << 3 | _BYTES), _number(len(data)), data]
    return b"".join(out)


def frames(data: bytes, delimited: bool) -> Iterator[bytes]:
    """The messages of a file; what is cut off at its end comes as it is and fails to decode."""
    if not delimited:
        yield data
        return
    at = 0
    while at < len(data):
        size, start = varint(data, at)
        if start + size > len(data):
            raise Damaged("a message is cut off")
        yield data[start : start + size]
        at = start + size


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces of bounded rows and bytes of ``column``; a longer row comes alone.

    A decoded message takes many times its bytes as Python objects, so a whole batch of them grows with its rows.
    """
    rows = max(1, min(SLICE_ROWS, SLICE_BYTES * batch.num_rows // max(1, batch.column(column).nbytes)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def read_binary(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """(content, file) of binary feed files."""
    reader = spark.readStream.schema("path string, modificationTime timestamp, length bigint, content binary") if stream else spark.read
    return reader.format("binaryFile").load(path).select("content", F.col("path").alias("file"))


def decoded(messages: DataFrame, kind: str, delimited: bool = False) -> DataFrame:
    """Typed column ``m`` per message of ``content``, beside the other columns; damaged ones have ``m`` null and the reason in ``_corrupt``.

    A null or empty content is an empty file: nothing where messages are delimited, else a message without entities.
    """
    schema, fields = MESSAGES[kind]
    others = [c for c in messages.columns if c != "content"]
    keep = messages.select(*[F.col(f"`{c}`") for c in others]).schema
    typed = StructType.fromDDL(schema)
    out = StructType([*keep.fields]).add("m", typed).add(CORRUPT, "string")
    arrow = to_arrow_type(typed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in _slices(whole, "content")):
            rows, values, reasons = [], [], []
            for i, data in enumerate(batch.column("content").to_pylist()):
                try:
                    for frame in frames(data or b"", delimited):
                        try:
                            value, reason = decode(frame, fields), None
                        except (Damaged, UnicodeDecodeError) as error:
                            value, reason = None, str(error)
                        rows.append(i)
                        values.append(value)
                        reasons.append(reason)
                except Damaged as error:
                    rows.append(i)
                    values.append(None)
                    reasons.append(str(error))
            at = pa.array(rows, pa.int64())
            columns = [batch.column(c).take(at) for c in others] + [pa.array(values, arrow), pa.array(reasons, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*others, "m", CORRUPT])

    return messages.select(*[F.col(f"`{c}`") for c in others], "content").mapInArrow(run, out)


def damaged(rows: DataFrame) -> DataFrame:
    """Dead letters of ``decoded``: the other columns and the reason."""
    return rows.where(F.col(CORRUPT).isNotNull()).drop("m").withColumnRenamed(CORRUPT, "reason")


def encoded(messages: DataFrame, kind: str, delimited: bool = False) -> DataFrame:
    """``content`` of messages held in the struct ``m``, beside the other columns."""
    fields = MESSAGES[kind][1]
    others = [c for c in messages.columns if c != "m"]
    out = StructType([*messages.drop("m").schema.fields]).add("content", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in _slices(whole, "m")):
            data = [encode(m, fields) for m in batch.column("m").to_pylist()]
            framed = [_number(len(d)) + d for d in data] if delimited else data
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], pa.array(framed, pa.binary())], names=[*others, "content"])

    return messages.select(*[F.col(f"`{c}`") for c in others], "m").mapInArrow(run, out)
