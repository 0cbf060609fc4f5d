"""Benchmark decontamination: one Aho-Corasick automaton over normalised item windows, scanning each text once.

Words are runs of letters and digits after lower-casing A-Z; every character beyond ASCII counts as a letter. A window is
``window`` consecutive words of an item; a shorter item is one window. All occurrences are found, overlaps included, and
mapped back to words and to offsets of the original text (code points).

Null or empty texts have no words and no hits. Repeated items count once per item_id; items with a null id hit but are not
listed. An empty benchmark hits nothing. The benchmark is a stated query set: it is read in blocks of at most ``BLOCK_CHARS``
window characters, one automaton each, so an automaton's size is bounded; the documents are never collected.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import slices

WINDOW = 10
BLOCK_CHARS = 1 << 24
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_automata: dict[str, list] = {}
SCHEMA = (
    "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, items array<string>, "
    "spans array<struct<start int, end int>>"
)
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def normalised(text: str) -> str:
    """Words between single spaces, one Latin-1 character per UTF-8 byte, with a space at both ends."""
    return b"".join((b" ", b" ".join(text.encode().translate(_WORD_BYTES).split()), b" ")).decode("latin-1")


def item_windows(text: str | None, window: int) -> list[str]:
    words = normalised(text or "").split(" ")[1:-1]
    if words == [""] or not words:
        return []
    return [f" {' '.join(words[i : i + window])} " for i in range(max(1, len(words) - window + 1))]


def automaton_blocks(items: list[tuple[str | None, str | None]], window: int, block_chars: int = BLOCK_CHARS) -> list[list[tuple[str, list[str | None]]]]:
    """Distinct windows with the ids of their items, in blocks of bounded size."""
    owners: dict[str, set] = {}
    for item, text in items:
        for w in item_windows(text, window):
            owners.setdefault(w, set()).add(item)
    blocks, size = [[]], 0
    for w, ids in owners.items():
        if size + len(w) > block_chars and blocks[-1]:
            blocks.append([])
            size = 0
        blocks[-1].append((w, list(ids)))
        size += len(w)
    return blocks


def _automaton(key: str, blocks: list) -> list:
    if key not in _automata:
        import ahocorasick

        built = []
        for block in blocks:
            a = ahocorasick.Automaton()
            for w, ids in block:
                a.add_word(w, (w.count(" ") - 1, ids))
            if len(a):
                a.make_automaton()
                built.append(a)
        _automata.clear()
        _automata[key] = built
    return _automata[key]


def scan(text: str, automata: list) -> tuple[int, int, set, list[tuple[int, int]]]:
    """(words, hit words, item ids, spans of hit runs in code points of ``text``)."""
    norm = normalised(text)
    n_words = norm.count(" ") - 1 if len(norm) > 2 else 0
    found = [(end, *value) for a in automata for end, value in a.iter(norm)] if n_words else []
    if not found:
        return n_words, 0, set(), []
    gaps = np.flatnonzero(np.frombuffer(norm.encode("latin-1"), np.uint8) == 32)
    last = np.searchsorted(gaps, [f[0] for f in found])  # the gap that ends the window; words before it
    edges = np.zeros(n_words + 1, np.int64)
    np.add.at(edges, last - np.array([f[1] for f in found]), 1)
    np.add.at(edges, last, -1)
    hit = np.cumsum(edges)[:-1] > 0
    turns = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    kept = np.frombuffer(text.encode().translate(_WORD_BYTES), np.uint8) != 32
    sides = np.flatnonzero(np.diff(np.concatenate(([0], kept.view(np.int8), [0]))))
    points = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)  # code points up to a byte
    points = np.concatenate(([0], points))
    spans = [(int(points[sides[2 * a]]), int(points[sides[2 * b - 1]])) for a, b in zip(turns[::2], turns[1::2], strict=True)]
    return n_words, int(hit.sum()), {i for f in found for i in f[2]}, spans


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ("doc_id",), block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document: columns ``keep``, its hit words, the items whose windows occur, and the hit spans of the original text."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).distinct()
    blocks = automaton_blocks([tuple(r) for r in items.toLocalIterator()], window, block_chars)
    key = hashlib.sha256(pickle.dumps(blocks)).hexdigest()
    sent = spark.sparkContext.broadcast(blocks)
    rows = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = _automaton(key, sent.value)
        for batch in slices(batches, "_text"):
            out = [scan(t, automata) for t in batch.column(len(keep)).to_pylist()]
            ids = [sorted(i for i in r[2] if i is not None) for r in out]
            yield pa.RecordBatch.from_arrays([
                *batch.columns[: len(keep)], pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([len(i) for i in ids], pa.int64()),
                pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in ids]), pa.array([r[1] > 0 for r in out], pa.bool_()), pa.array(ids, pa.list_(pa.string())),
                pa.array([[{"start": a, "end": b} for a, b in r[3]] for r in out], _SPAN),
            ], names=[*keep, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"])

    return rows.mapInArrow(run, f"{kept}, {SCHEMA}")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows of ``docs`` that hold no window of the benchmark."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return contamination(rows, benchmark, window, ("row",)).filter("NOT contaminated").select("row.*")
