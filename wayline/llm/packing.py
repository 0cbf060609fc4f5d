"""Lexical retrieval packing: token sequences of a fixed window filled with lexically near documents.

Documents are dealt by the smallest word hash of their set (near texts often share it) with a rebalance that splits hot keys,
sorted, and read as a stream. Every ``SHARD_IDS`` ids form a shard with its own BM25 inverted index over token ids. Whole
windows of a long document are sequences of their own; its rest waits in the shard. The first unused document is the seed: its
strongest terms query the index, and the unused neighbours, best first, fill the window. What does not fit is cut there and
seeds the next window, so only the last sequence of a partition is padded, and not even that one at a power of two.

Null and empty texts have the end id alone and are packed like others. Repeated rows are packed each. An empty table gives no
pieces. Memory per task: one shard, or one document where that is longer.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import slices
from wayline.llm.tokens import encoder

WINDOW, END_ID = 4096, 2
SHARD_IDS = 1 << 21
QUERY_TERMS = 24
K1, B = 1.2, 0.75
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, seed_doc_id bigint"


class Index:
    """BM25 postings of one shard: term -> documents and weights."""

    def __init__(self, docs: list[np.ndarray]):
        sizes = np.array([len(d) for d in docs], np.float64)
        terms, docs_of, tfs = [], [], []
        for i, ids in enumerate(docs):
            ordered = np.sort(ids, kind="stable")
            edges = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
            terms.append(ordered[edges])
            tfs.append(np.diff(np.concatenate((edges, [len(ordered)]))))
            docs_of.append(np.full(len(edges), i, np.int32))
        self.ends = np.cumsum([0, *(len(t) for t in terms)])
        term, doc, tf = np.concatenate(terms), np.concatenate(docs_of), np.concatenate(tfs).astype(np.float64)
        df = np.bincount(term, minlength=1 << 16)
        idf = np.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[doc] / sizes.mean()))
        self.term, self.own = term, weight
        order = np.argsort(term, kind="stable")
        self.doc, self.weight, self.first = doc[order], weight[order], np.concatenate(([0], np.cumsum(df)))
        self.n = len(docs)

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a query term with the seed, best first, ties to the earlier one."""
        at = slice(self.ends[seed], self.ends[seed + 1])
        terms, own = self.term[at], self.own[at]
        if len(terms) > QUERY_TERMS:
            terms = terms[np.argpartition(-own, QUERY_TERMS)[:QUERY_TERMS]]
        score = np.zeros(self.n)
        for t in terms:
            to = slice(self.first[t], self.first[t + 1])
            score[self.doc[to]] += self.weight[to]
        score[~unused] = 0
        hits = np.flatnonzero(score)
        return hits[np.argsort(-score[hits], kind="stable")]


class Packer:
    """Pieces of one partition; ``open`` is the sequence being filled."""

    def __init__(self, part: int):
        self.base, self.count, self.filled, self.seed = part << 32, 0, 0, None
        self.rows: list[tuple] = []

    def piece(self, doc: tuple, start: int, length: int) -> None:
        key, ids, _ = doc
        if not self.filled:
            self.seed = key
        raw = ids[start : start + length].astype("<u4").tobytes()
        self.rows.append((key, start, length, zlib.crc32(raw), len(ids), self.base + self.count, self.filled, self.seed))
        self.filled += length
        if self.filled == WINDOW:
            self.count, self.filled = self.count + 1, 0

    def put(self, doc: tuple, start: int) -> None:
        """The document from ``start`` to its end, cut where windows end."""
        while start < len(doc[1]):
            length = min(WINDOW - self.filled, len(doc[1]) - start)
            self.piece(doc, start, length)
            start += length

    def shard(self, docs: list[tuple]) -> None:
        """``docs``: (doc_id, ids, start of what is left)."""
        if not docs:
            return
        index = Index([d[1] for d in docs])
        unused = np.ones(len(docs), bool)
        for seed in range(len(docs)):
            if not unused[seed]:
                continue
            unused[seed] = False
            self.put(docs[seed], docs[seed][2])
            while self.filled:
                for i in index.neighbours(seed, unused):
                    unused[i], before = False, self.count
                    self.put(docs[i], docs[i][2])
                    if self.count > before:
                        seed = i  # cut at the border, it seeds the next window
                        break
                else:
                    break

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) if self.rows else [[]] * 8
        self.rows = []
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def _pack(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, shard, size = Packer(TaskContext.get().partitionId()), [], 0
        for batch in slices(batches, "text"):
            keys = batch.column(0).to_pylist()
            for key, raw in zip(keys, encoder(path, END_ID).encode(batch.column(1).to_pylist()), strict=True):
                wide = np.frombuffer(raw, "<u4")
                narrow = np.uint16 if wide.max(initial=0) < 1 << 16 else np.uint32
                doc = (key, wide.astype(narrow), len(wide) // WINDOW * WINDOW)
                if doc[2] and not packer.filled:
                    for start in range(0, doc[2], WINDOW):
                        packer.piece(doc, start, WINDOW)
                elif doc[2]:
                    doc = (key, doc[1], 0)  # cut at the open sequence's end when its turn comes
                if doc[2] < len(wide):
                    shard.append(doc)
                    size += len(wide)
                if size >= SHARD_IDS:
                    packer.shard(shard)
                    shard, size = [], 0
                    yield packer.take()
        packer.shard(shard)
        yield packer.take()

    return run


def lexical_key(text: Column) -> Column:
    """Smallest hash of the text's words: equal for equal word sets, often equal for near ones."""
    return F.coalesce(F.array_min(F.transform(F.split(F.lower(text), " "), lambda w: F.xxhash64(w))), F.lit(0).cast("bigint"))


def pack(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per piece of (doc_id, text) with its sequence and place there."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = rows.withColumn("near", lexical_key(F.col("text"))).hint("rebalance", "near").sortWithinPartitions("near", "doc_id", F.xxhash64("text"))
    return dealt.select("doc_id", "text").mapInArrow(_pack(tokenizer), SCHEMA)
