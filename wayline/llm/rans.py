"""Token files: static range asymmetric numeral systems over interleaved blocks.

Documents are dealt by ranges of ``doc_id`` and encoded in ascending order. A segment (about ``SEGMENT_IDS`` ids) has one
frequency table, shared by all of its blocks; a block (about ``BLOCK_IDS`` ids, whole documents) is coded alone by up to
``LANES`` interleaved states, with the states and the read position of every ``CHECK_STEPS`` steps, a checksum of its words
and one of its ids. So segments are read in parallel, blocks and the stretches between checkpoints are independent.

File format: Parquet rows (part, segment, first_in_part, n_ids, symbols, freqs, blocks), one row per segment; arrays are little-endian bytes.
Null or repeated doc_ids keep one entry per row (nulls first); null texts count as empty; an empty table gives an empty file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.llm.common import slices, staged
from wayline.llm.tokens import encoder

BITS = 20  # frequencies of a table sum to 2 ** BITS
LOW = np.uint64(1 << 31)
LANES, CHECK_STEPS = 4096, 32
BLOCK_IDS, SEGMENT_IDS = 1 << 18, 1 << 22
FILE_SCHEMA = (
    "part int, segment int, first_in_part bigint, n_ids bigint, symbols binary, freqs binary, blocks array<struct<doc_ids array<bigint>, lengths binary, n_ids int, "
    "lanes int, words binary, words_crc32 bigint, ids_crc32 bigint, checkpoints array<struct<step int, word int, states binary>>>>"
)
_BLOCK = pa.struct([
    ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.binary()), ("n_ids", pa.int32()), ("lanes", pa.int32()), ("words", pa.binary()),
    ("words_crc32", pa.int64()), ("ids_crc32", pa.int64()),
    ("checkpoints", pa.list_(pa.struct([("step", pa.int32()), ("word", pa.int32()), ("states", pa.binary())]))),
])
_FILE = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("first_in_part", pa.int64()), ("n_ids", pa.int64()), ("symbols", pa.binary()), ("freqs", pa.binary()), ("blocks", pa.list_(_BLOCK))])


class CorruptBlock(ValueError):
    """A checksum of a block does not hold."""


def frequency_table(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, frequencies): every symbol that occurs gets at least 1; frequencies sum to 2 ** BITS."""
    symbols, counts = np.unique(ids, return_counts=True)
    total = 1 << BITS
    if len(symbols) > total // 2:
        raise ValueError("too many distinct ids for the table's precision")
    freqs = np.maximum(1, counts * (total - len(symbols)) // max(1, counts.sum()))
    freqs[np.argmax(freqs)] += total - freqs.sum()
    return symbols.astype("<u4"), freqs.astype("<u4")


def encode_block(ranks: np.ndarray, freqs: np.ndarray, starts: np.ndarray, lanes: int) -> tuple[np.ndarray, list[tuple[int, int, bytes]]]:
    """Words of the block in reading order and its checkpoints (step, words read before it, states)."""
    steps = -(-len(ranks) // lanes)
    state = np.full(lanes, LOW, np.uint64)
    emitted, marks = [], []
    shift, limit = np.uint64(BITS), np.uint64(63 - BITS)
    for step in range(steps - 1, -1, -1):
        at = ranks[step * lanes : (step + 1) * lanes]
        f, x = freqs[at], state[: len(at)]
        full = x >= (f << limit)
        emitted.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
        x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        state[: len(at)] = (q << shift) + (x - q * f) + starts[at]
        if step % CHECK_STEPS == 0:
            marks.append((step, len(emitted), state.astype("<u8").tobytes()))
    sizes = np.cumsum([0, *(len(e) for e in reversed(emitted))])
    words = np.concatenate(emitted[::-1]) if emitted else np.empty(0, "<u4")
    return words, [(step, int(sizes[step]), states) for step, _, states in reversed(marks)]


def decode_steps(words: np.ndarray, mark: dict, n_ids: int, lanes: int, to_step: int, slots: np.ndarray, freqs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ranks of the steps from a checkpoint up to ``to_step``."""
    state, at, out = np.frombuffer(mark["states"], "<u8").copy(), mark["word"], []
    mask, shift = np.uint64((1 << BITS) - 1), np.uint64(BITS)
    for step in range(mark["step"], to_step):
        x = state[: min(lanes, n_ids - step * lanes)]
        slot = x & mask
        rank = slots[slot]
        x = freqs[rank] * (x >> shift) + slot - starts[rank]
        empty = np.flatnonzero(x < LOW)
        x[empty] = (x[empty] << np.uint64(32)) | words[at : at + len(empty)]
        at += len(empty)
        state[: len(x)] = x
        out.append(rank)
    return np.concatenate(out) if out else np.empty(0, slots.dtype)


def _segment(docs: list[tuple[int | None, bytes]], part: int, number: int, first: int) -> pa.RecordBatch:
    whole = memoryview(b"".join(d[1] for d in docs))
    ids, done = np.frombuffer(whole, "<u4"), 0
    symbols, table = frequency_table(ids)
    freqs = table.astype(np.uint64)
    starts = np.cumsum(freqs) - freqs
    rank_of = np.zeros(int(symbols[-1]) + 1 if len(symbols) else 1, np.uint32)
    rank_of[symbols] = np.arange(len(symbols), dtype=np.uint32)
    blocks, at = [], 0
    while at < len(docs):
        to, n = at, 0
        while to < len(docs) and n < BLOCK_IDS:
            n += len(docs[to][1]) // 4
            to += 1
        raw, done = whole[4 * done : 4 * (done + n)], done + n
        lanes = LANES if n >= 64 * LANES else max(1, n // 64)
        words, marks = encode_block(rank_of[np.frombuffer(raw, "<u4")], freqs, starts, lanes)
        payload = words.tobytes()
        blocks.append({
            "doc_ids": [d[0] for d in docs[at:to]], "lengths": np.array([len(d[1]) // 4 for d in docs[at:to]], "<u4").tobytes(), "n_ids": n, "lanes": lanes,
            "words": payload, "words_crc32": zlib.crc32(payload), "ids_crc32": zlib.crc32(raw),
            "checkpoints": [{"step": s, "word": w, "states": x} for s, w, x in marks],
        })
        at = to
    row = {"part": part, "segment": number, "first_in_part": first, "n_ids": len(ids), "symbols": symbols.tobytes(), "freqs": table.tobytes(), "blocks": blocks}
    return pa.RecordBatch.from_pylist([row], schema=_FILE)


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, first, docs, size = TaskContext.get().partitionId(), 0, 0, [], 0
        for batch in slices(batches, "text"):
            keys = batch.column(0).to_pylist()
            for key, ids in zip(keys, encoder(path, end_id).encode(batch.column(1).to_pylist()), strict=True):
                docs.append((key, ids))
                size += len(ids) // 4
                if size >= SEGMENT_IDS:
                    yield _segment(docs, part, number, first)
                    number, first, docs, size = number + 1, first + size, [], 0
        if docs:
            yield _segment(docs, part, number, first)

    return run


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Encodes (doc_id, text) into the file format in the shared folder; returns the files as a DataFrame."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return staged(dealt.mapInArrow(_encode(tokenizer, end_id), FILE_SCHEMA), "uncompressed")


def decode_block(block: dict, symbols: np.ndarray, slots: np.ndarray, freqs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ids of a block, checked; every stretch between two checkpoints is decoded on its own."""
    if zlib.crc32(block["words"]) != block["words_crc32"]:
        raise CorruptBlock("words")
    words = np.frombuffer(block["words"], "<u4").astype(np.uint64)
    marks, n, lanes = block["checkpoints"], block["n_ids"], block["lanes"]
    ends = [m["step"] for m in marks[1:]] + [-(-n // lanes)]
    parts = [decode_steps(words, m, n, lanes, end, slots, freqs, starts) for m, end in zip(marks, ends, strict=True)]
    ids = symbols[np.concatenate(parts)] if parts else np.empty(0, "<u4")
    if zlib.crc32(ids.astype("<u4").tobytes()) != block["ids_crc32"]:
        raise CorruptBlock("ids")
    return ids


def documents_of(segment: dict) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of a segment in file order."""
    symbols, freqs = np.frombuffer(segment["symbols"], "<u4"), np.frombuffer(segment["freqs"], "<u4").astype(np.uint64)
    slots, starts = np.repeat(np.arange(len(freqs), dtype=np.uint32), freqs.astype(np.int64)), np.cumsum(freqs) - freqs
    for block in segment["blocks"]:
        ids = decode_block(block, symbols, slots, freqs, starts)
        ends = np.cumsum(np.frombuffer(block["lengths"], "<u4").astype(np.int64))
        yield from zip(block["doc_ids"], np.split(ids, ends[:-1]), strict=True)


def _decode(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                segment = batch.slice(i, 1).to_pylist()[0]
                at, doc_ids, starts, counts, last = segment["first_id"], [], [], [], []
                for key, ids in documents_of(segment):
                    doc_ids.append(key)
                    starts.append(at)
                    counts.append(len(ids))
                    raw = ids.astype("<u4").tobytes()
                    last.append(zlib.crc32(raw) if digest else ids)
                    at += len(ids)
                kind = pa.int64() if digest else pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(last, kind)], ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    return run


def read_tokens(files: DataFrame, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, or ids_crc32 in place of ids with ``digest``.

    The start of a part is the sum of the parts before it; a segment knows its place in its part. There is one part per task of
    the writing job, so their totals are a table as long as the number of partitions, whatever the input.
    """
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = files.join(F.broadcast(parts.select("part", before.alias("before"))), "part")
    last = "ids_crc32 bigint" if digest else "ids array<bigint>"
    segments = joined.select("symbols", "freqs", "blocks", (F.col("before") + F.col("first_in_part")).alias("first_id"))
    return segments.mapInArrow(_decode(digest), f"doc_id bigint, start bigint, n_tokens bigint, {last}")
