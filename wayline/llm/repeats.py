"""Repeated byte strings: run-length Burrows-Wheeler index over the places that may repeat.

1. In every ``length`` bytes the smallest hash of ``GRAM``-byte grams is an anchor, so equal strings have equal anchors. An anchor
   that occurs once rules out every string it stands for. Where it occurs again with the same surroundings (all bytes that a
   string with the anchor can reach), all of the surroundings repeat.
2. The other places of a repeated anchor go to a shard of the anchor, with one place for each distinct surroundings. The shard
   joins overlapping places of a text, orders its suffixes, and keeps of the Burrows-Wheeler transform only the run heads with
   their text positions and common prefixes. Streaming over these samples in text order gives the matching statistics of
   every position (between two samples they fall by one), and with them the long matches.
3. Anchors with more than ``MOST_PLACES`` different surroundings are counted string by string instead, in a grouping that
   combines before it shuffles, so no anchor has to fit into a task.

The same steps over words in place of bytes find passages: runs of ``WORDS`` words that occur again, however few bytes they have.
A word counts as its 64-bit hash there, and white space does not count.

Matches never cross texts. Equal texts are one text with several places. Null texts count as empty; texts under ``length`` bytes
lose nothing; repeated rows are copies of each other and lose all; an empty table gives no rows. Anchors and surroundings are
compared by 64-bit hashes, matches in shards byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import collecting, discard, slices, staged
from wayline.llm.shingles import mixed

LENGTH, GRAM = 400, 200
WORDS, WORD_GRAM = 51, 13
MOST_PLACES, SHARD_BYTES = 20_000, 1_500_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_TABLE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_powers: dict[str, np.ndarray] = {}


def _power(n: int, inverse: bool) -> np.ndarray:
    key = "down" if inverse else "up"
    if key not in _powers or len(_powers[key]) < n:
        base = np.uint64(pow(int(_BASE), -1, 1 << 64)) if inverse else _BASE
        p = np.full(max(n, 1 << 16), base, np.uint64)
        p[0] = 1
        _powers[key] = np.cumprod(p)
    return _powers[key][:n]


class Hashes:
    """Hashes of any substrings of some symbols, given by their own hashes."""

    def __init__(self, symbols: np.ndarray):
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(symbols * _power(len(symbols), False))))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        down = _power(len(self.sums), True)
        return mixed((self.sums[end] - self.sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))


_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def as_bytes(raw: bytes) -> bytes:
    return raw


def byte_hashes(cut: bytes) -> np.ndarray:
    return _TABLE[np.frombuffer(cut, np.uint8)]


def laid_bytes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return byte_hashes(b"".join(raws)), np.cumsum([len(r) for r in raws])


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of words."""
    values = np.frombuffer(raw, np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate(([True], _BLANK[values], [True])).astype(np.int8)))
    return edges[::2], Hashes(_TABLE[values]).of(edges[::2], edges[1::2])


def as_words(raw: bytes) -> bytes:
    """The hash of every word, eight bytes each."""
    return _words(raw)[1].tobytes()


def laid_words(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    starts, hashes = _words(b"\n".join([*raws, b""]))
    return hashes, np.searchsorted(starts, np.cumsum([len(r) + 1 for r in raws]))


def word_hashes(cut: bytes) -> np.ndarray:
    return np.frombuffer(cut, np.uint64)


class Unit(NamedTuple):
    """What a text is a sequence of: bytes of one symbol, a text's symbols one after the other, their hashes, hashes and ends of texts laid end to end."""

    width: int
    symbols: Callable[[bytes], bytes]
    hashes: Callable[[bytes], np.ndarray]
    laid: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


BYTE, WORD = Unit(1, as_bytes, byte_hashes, laid_bytes), Unit(8, as_words, word_hashes, laid_words)


def window_minima(values: np.ndarray, w: int) -> np.ndarray:
    """Smallest of every ``w`` values in a row."""
    least, size = values, 1
    while 2 * size <= w:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    return np.minimum(least[: len(values) - w + 1], least[w - size :])


def anchors(symbols: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ends among them, positions, gram hashes, hashes of the surroundings) of the anchors of texts laid end to end.

    In each window of one text the smallest gram, the last of equals.
    """
    if len(symbols) < length:
        return np.zeros(len(ends), np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    hashes, w, low = Hashes(symbols), length - gram + 1, np.uint64((1 << 24) - 1)
    starts = np.arange(len(symbols) - gram + 1)
    grams = hashes.of(starts, starts + gram)
    first = np.concatenate(([0], ends[:-1]))
    inside = np.repeat(ends, ends - first)[: len(symbols) - length + 1] - starts[: len(symbols) - length + 1] >= length
    found = []
    for at in range(0, len(grams) - w + 1, 1 << 23):  # the last bits of a key hold the place in a stretch
        part = grams[at : at + (1 << 23) + w - 1]
        keys = (part & ~low) | (low - np.arange(len(part), dtype=np.uint64))
        smallest = (low - (window_minima(keys, w) & low)).astype(np.int64)[inside[at : at + (1 << 23)]]
        found.append(smallest[np.flatnonzero(np.diff(smallest, prepend=-1))] + at)
    position = np.unique(np.concatenate(found))
    text = np.searchsorted(ends, position, "right")
    lo, hi = np.maximum(first[text], position - (length - gram)), np.minimum(ends[text], position + length)
    around = hashes.of(lo, hi) + mixed((position - lo).astype(np.uint64))
    return np.searchsorted(position, ends), position - first[text], grams[position], around


def long_matches(regions: list[bytes] | list[np.ndarray], length: int) -> list[tuple[int, int, int]]:
    """(region, start, end) of every stretch of window starts whose ``length`` bytes or numbers occur at another place of the regions.

    Suffixes are ordered by doubling; of the transform only run heads stay, each with its text position, the position of the
    suffix before it and their common prefix. From one sample to the next in text order the common prefix falls by one.
    """
    sizes = np.array([len(r) for r in regions])
    bounds = np.cumsum(np.concatenate(([0], sizes + 1)))
    codes = np.zeros(int(bounds[-1]) + 4, np.int64)
    for r, at in zip(regions, bounds, strict=False):
        codes[at : at + len(r)] = (np.frombuffer(r, np.uint8) if isinstance(r, bytes) else r) + np.int64(len(regions) + 1)
    codes[bounds[1:] - 1] = np.arange(1, len(regions) + 1)  # every end differs from all others
    n = int(bounds[-1])
    tables, step = {}, 1
    rank = codes[:n]
    while True:
        tables[step] = rank.astype(np.int32)
        if int(rank.max(initial=0)) >= n - 1 and step > 1:
            break
        later = np.zeros(n, np.int64)
        later[: n - step] = rank[step:] + 1
        pairs = rank * np.int64(max(n, int(rank.max())) + 2) + later
        rank = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        step *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    transform = codes[order - 1]
    heads = np.flatnonzero(transform[1:] != transform[:-1]) + 1
    sample, partner = order[heads], order[heads - 1]
    common = np.zeros(len(heads), np.int64)
    for size in sorted((s for s in tables if s < step), reverse=True):
        for _ in range(1):
            a, b = np.minimum(sample + common, n - 1), np.minimum(partner + common, n - 1)
            common += np.where(tables[size][a] == tables[size][b], size, 0)
    place = np.argsort(sample, kind="stable")
    sample, partner, common = sample[place], partner[place], common[place]
    until = np.minimum(np.concatenate((sample[1:], [n])), sample + common - length + 1)
    some = until > sample
    starts = np.concatenate((sample[some], partner[some]))
    ends = np.concatenate((until[some], partner[some] + until[some] - sample[some]))
    owner = np.searchsorted(bounds, starts, "right") - 1
    return [(int(o), int(s - bounds[o]), int(e - bounds[o])) for o, s, e in zip(owner, starts, ends, strict=True)]


def merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open intervals, touching ones joined."""
    out: list[list[int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _signatures(unit: Unit, length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            raws = [t.encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()]
            symbols, ends = unit.laid(raws)
            upto, position, grams, around = anchors(symbols, ends, length, gram)
            offsets = pa.array(np.concatenate(([0], upto)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(f)) for f in (position.astype(np.int32), _signed(grams), _signed(around))]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(np.diff(ends, prepend=0), pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in raws]), *lists,
            ], names=["doc_id", "text_number", "size", "sha256", "position", "anchor", "around"])

    return run


def _cut(unit: Unit, length: int, gram: int):
    """Symbols of the places in ``wanted`` of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            rows = []
            for number, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                symbols = unit.symbols(text.encode("utf-8", "surrogatepass"))
                for w in wanted:
                    lo, hi = max(0, w["position"] - (length - gram)), min(len(symbols) // unit.width, w["position"] + length)
                    rows.append((w["anchor"], number, lo, w["position"] - lo, symbols[lo * unit.width : hi * unit.width]))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["anchor", "text_number", "lo", "inside", "raw"])

    return run


def _numbered(unit: Unit, regions: list[bytes]) -> list[bytes] | list[np.ndarray]:
    """Regions with small numbers for symbols of more than one byte."""
    if unit.width == 1:
        return regions
    numbers = np.unique(unit.hashes(b"".join(regions)), return_inverse=True)[1].astype(np.int64)
    return np.split(numbers, np.cumsum([len(r) // unit.width for r in regions])[:-1])


def _indexed(unit: Unit, length: int):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["text_number"].to_pylist(), table["lo"].to_pylist(), table["raw"].to_pylist(), strict=True))
        regions: list[list] = []
        for number, lo, raw in rows:  # overlapping places of a text are one region, so no byte is its own match
            if regions and regions[-1][0] == number and lo <= regions[-1][1] + len(regions[-1][2]) // unit.width:
                seen = len(regions[-1][2]) - (lo - regions[-1][1]) * unit.width
                regions[-1][2] += raw[seen:] if seen < len(raw) else b""
            else:
                regions.append([number, lo, raw])
        found = long_matches(_numbered(unit, [r[2] for r in regions]), length)
        spans = [(regions[o][0], regions[o][1] + s, regions[o][1] + e - 1 + length) for o, s, e in found]
        columns = list(zip(*spans, strict=True)) if spans else [[]] * 3
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["text_number", "start", "end"])

    return run


def _strings(unit: Unit, length: int):
    """Every string of ``length`` symbols of a place, for anchors with very many places; equal ones of a batch are combined."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "raw", 1 << 20):
            rows = []
            for number, lo, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if len(raw) // unit.width < length:
                    continue
                starts = np.arange(len(raw) // unit.width - length + 1)
                rows.append((np.full(len(starts), number), starts + lo, _signed(Hashes(unit.hashes(raw)).of(starts, starts + length))))
            columns = [np.concatenate(c) for c in zip(*rows, strict=True)] if rows else [np.empty(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["text_number", "start", "string"])

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 4 << 20):
        rows = []
        for number, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            raw, at, kept = text.encode("utf-8", "surrogatepass"), 0, hashlib.sha256()
            runs = merged([(s["start"], s["end"]) for s in spans])
            for a, b in runs:
                kept.update(raw[at:a])
                at = b
            kept.update(raw[at:])
            rows.append((number, sum(b - a for a, b in runs), len(runs), kept.hexdigest(), [{"start": a, "end": b} for a, b in runs]))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), spans_type), strict=True)], names=["text_number", "n_removed", "n_spans", "kept_sha256", "spans"])


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        covered = [sum(b - a for a, b in merged([(s["start"], s["end"]) for s in spans])) for spans in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(covered, pa.int64())], names=["text_number", "n_passage_words"])


def _numbered_texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_number"), text.alias("text"))


def _repeats(rows: DataFrame, unit: Unit, length: int, gram: int, most_places: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows with size and SHA-256 of the text; texts that may hold repeats; of these, the spans of symbols that repeat."""
    schema = "doc_id bigint, text_number bigint, size bigint, sha256 string, position array<int>, anchor array<bigint>, around array<bigint>"
    known = staged(rows.mapInArrow(_signatures(unit, length, gram), schema), "uncompressed")
    often = known.select(F.explode("anchor").alias("anchor")).groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    often = staged(often)  # so that the join below has its own shuffle, whose large partitions Spark can split
    zipped = known.select("text_number", "size", F.explode(F.arrays_zip("position", "anchor", "around")).alias("z")).select("text_number", "size", "z.*")
    again = staged(zipped.join(often, "anchor"))
    around = staged(again.groupBy("anchor", "around").agg(F.count("*").alias("n"), F.min(F.struct("text_number", "position")).alias("place")))
    of_anchor = staged(around.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum((F.col("n") == 1).cast("int")).alias("single")))
    around = staged(around.join(of_anchor, "anchor"))
    # the same surroundings twice: all of them repeat
    sure = again.join(around.filter("n > 1").select("anchor", "around"), ["anchor", "around"])
    lo, hi = F.greatest(F.lit(0), F.col("position") - (length - gram)), F.least(F.col("size"), F.col("position") + length)
    whole = sure.select("text_number", lo.cast("bigint").alias("start"), hi.cast("bigint").alias("end")).filter(F.col("end") - F.col("start") >= length).distinct()
    places = around.filter("single > 0 AND kinds > 1").select("anchor", "kinds", "place.text_number", "place.position")
    # texts with a repeated anchor, each once, staged for the two readings below; their list grows with the corpus and is never broadcast
    first = known.groupBy("text_number").agg(F.min("doc_id").alias("first"))
    chosen = staged(again.select("text_number").distinct().join(first, "text_number"))
    texts = staged(rows.join(chosen.hint("merge"), "text_number").filter(F.col("doc_id").eqNullSafe(F.col("first"))).select("text_number", "text"))
    wanted = places.groupBy("text_number").agg(F.collect_list(F.struct("anchor", "position")).alias("wanted"))  # of one text
    raws = texts.join(wanted, "text_number").select("text_number", "text", "wanted").mapInArrow(_cut(unit, length, gram), "anchor bigint, text_number bigint, lo bigint, inside bigint, raw binary")
    raws = staged(raws.join(places.select("anchor", "kinds").distinct(), "anchor"))
    few = raws.filter(F.col("kinds") <= most_places)
    shards = max(1, -(-(few.agg(F.sum(F.length("raw"))).first()[0] or 0) // SHARD_BYTES))
    indexed = few.groupBy(F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard")).applyInArrow(_indexed(unit, length), "text_number bigint, start bigint, end bigint")
    many = raws.filter(F.col("kinds") > most_places).select("text_number", "lo", "raw").mapInArrow(_strings(unit, length), "text_number bigint, start bigint, string bigint").distinct()
    twice = many.groupBy("string").agg(F.count("*").alias("n")).filter("n > 1").select("string")
    counted = many.join(twice, "string").select("text_number", "start", (F.col("start") + length).alias("end"))
    spans = whole.unionByName(indexed).unionByName(counted).groupBy("text_number").agg(F.collect_set(F.struct("start", "end")).alias("spans"))  # of one text
    return known, texts, spans


def _repeated(docs: DataFrame, length: int, gram: int, most_places: int) -> DataFrame:
    known, texts, spans = _repeats(_numbered_texts(docs), BYTE, length, gram, most_places)
    result_schema = "text_number bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>"
    results = texts.join(spans, "text_number").select("text_number", "text", "spans").mapInArrow(_kept, result_schema).dropDuplicates(["text_number"])
    joined = known.select("doc_id", "text_number", "size", "sha256").join(results, "text_number", "left")
    return joined.select(
        "text_number", "doc_id", F.col("size").alias("n_bytes"), F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("bigint").alias("n_spans"),
        F.coalesce("kept_sha256", "sha256").alias("kept_sha256"), "spans",
    )


def repeated_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most_places: int = MOST_PLACES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) for every row of (doc_id, text); spans are byte offsets."""
    return _repeated(docs, length, gram, most_places).drop("text_number")


def repeated_words(docs: DataFrame, words: int = WORDS, gram: int = WORD_GRAM, most_places: int = MOST_PLACES) -> DataFrame:
    """(text_number, n_passage_words) of texts in which ``words`` words in a row also start anywhere else: how many words such runs cover."""
    with collecting() as tables:
        spans = _repeats(_numbered_texts(docs), WORD, words, gram, most_places)[2]
        covered = spans.mapInArrow(_covered, "text_number bigint, n_passage_words bigint")
    out = staged(covered)
    discard(*tables)
    return out


def repeats_and_passages(docs: DataFrame) -> DataFrame:
    """The columns of ``repeated_bytes`` and n_passage_words, which also tells passages too short for ``LENGTH`` bytes."""
    passages = repeated_words(docs)  # first, so that its intermediate tables are gone before the larger ones are written
    found = _repeated(docs, LENGTH, GRAM, MOST_PLACES).join(passages, "text_number", "left").drop("text_number")
    return found.withColumn("n_passage_words", F.coalesce("n_passage_words", F.lit(0)).cast("bigint"))
