"""Ranked lexical search over bit-sliced Bloom signatures, exact in its results.

``build_index`` turns documents into blocks of documents of like size. A block holds one Bloom signature per document, sliced:
slice b has one bit per document, bit b of its signature. A signature takes the document's terms, and again those that occur
at least 2, 3, 4, 6, 8, 12, ... times, as entries of a higher level. The slices of a (term, level) together, by AND, tell which
documents may hold the term that often: never too few of them. A document of which a term's highest level is known can at
most have the count just below the next level, so the weighted sum over these bitmaps is an upper bound of its score.

``search`` reads the blocks of a partition one after the other. Per query it rescores documents from the block's exact counts,
highest bound first, and stops where the bound falls under the query's k-th exact score so far (or meets it with a larger id).
What is left out provably cannot be among the k; nothing else is left out. Each task returns k rows per query, which are ranked.

Weights and scores are the integers of the BM25 form in ``search``; N counts the documents with a term, L their terms.

Null and empty texts, and texts without a term, are in no block and count nowhere. Documents with a null id count in N, L and df
and may be found; they come after other ids of the same score. Repeated rows are documents of their own, repeated queries
(id and text) are one; queries without a term, and those with a null id, find nothing. Empty tables give no rows. Other columns
are not read. A text is read whole, however long; a document larger than ``CHUNK_BYTES`` is handled alone.
The queries are a stated set: they are asked in blocks of at most about ``BLOCK_TERMS`` terms, one scan of the index each.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.llm.common import staged
from wayline.session import scratch_folder

K = 20
CHUNK_BYTES = 8 << 20  # text that is turned into blocks together
BLOCK_DOCS = 2_048
SLICE_BYTES = 4 << 20  # of a block, where it has more than eight documents
HASHES, BITS_PER_ENTRY = 4, 8
LEVELS = np.array([1, 2, *(x for p in range(60) for x in (3 << p, 4 << p))])  # 1, 2, 3, 4, 6, 8, 12, 16, ...
BLOCK_TERMS, GROUP_TERMS = 200_000, 4_096  # terms of the queries that one scan asks, and of those that look at a block together
RESCORED = 64
LAST_ID = np.iinfo(np.int64).max  # stands for a null id inside the tasks
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
INDEX = (
    "n_docs int, n_terms bigint, ids array<bigint>, lengths array<bigint>, vocabulary array<string>, held array<int>, bits bigint, "
    "slices binary, first array<bigint>, terms binary, counts binary"
)


def terms_of(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """(document number, term) of every term of the texts, in order; the terms are dictionary encoded."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = (texts.buffers()[2] or pa.py_buffer(b"")).to_pybytes()[offsets[0] : offsets[-1]].translate(_FOLDED)
    folded = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(data)])
    words = pc.ascii_split_whitespace(folded)
    flat, owner = words.flatten(), np.repeat(np.arange(len(texts)), np.diff(words.offsets.to_numpy()))
    real = pc.greater(pc.binary_length(flat), 0)
    return owner[real.to_numpy(zero_copy_only=False)], flat.filter(real).dictionary_encode()


def hashes(terms: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(t) for t in terms.cast(pa.large_binary()).to_pylist()), np.uint64, len(terms))


def positions(term: np.ndarray, level: np.ndarray, bits: int) -> np.ndarray:
    """HASHES bit numbers per (term hash, level) in a signature of ``bits`` bits, a power of two."""
    mixed = term + (level.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    mixed ^= mixed >> np.uint64(31)
    step = (mixed >> np.uint64(32)) | np.uint64(1)
    return ((mixed[:, None] + np.arange(HASHES, dtype=np.uint64)[None, :] * step[:, None]) & np.uint64(bits - 1)).astype(np.int64)


def blocks_of(ids: pa.Array, texts: pa.Array) -> Iterator[dict]:
    """Index blocks of some documents: those with about the same number of entries share a block."""
    owner, coded = terms_of(texts)
    if not len(owner):
        return
    size, vocabulary = len(coded.dictionary), coded.dictionary
    pair, count = np.unique(owner * size + coded.indices.to_numpy(), return_counts=True)
    doc, term = pair // size, pair % size
    level = np.searchsorted(LEVELS, count, side="right")  # entries: one per level up to the count's
    entries = np.bincount(doc, weights=level, minlength=len(texts)).astype(np.int64)
    lengths = np.bincount(doc, weights=count, minlength=len(texts)).astype(np.int64)
    term_hashes = hashes(vocabulary)
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    classes = np.ceil(np.log2(np.maximum(entries, 8))).astype(np.int64)
    ids = ids.to_pylist()
    for c in np.unique(classes[entries > 0]):
        members, bits = np.flatnonzero((classes == c) & (entries > 0)), BITS_PER_ENTRY << int(c)
        most = int(min(BLOCK_DOCS, max(8, 8 * SLICE_BYTES // bits)))
        for at in range(0, len(members), most):
            docs = members[at : at + most]
            widths = first[docs + 1] - first[docs]
            ends = np.cumsum(widths)
            rows = np.repeat(first[docs] - (ends - widths), widths) + np.arange(ends[-1])
            column = np.repeat(np.arange(len(docs)), widths)
            used, local = np.unique(term[rows], return_inverse=True)
            levels = level[rows]
            entry = np.repeat(np.arange(len(rows)), levels)
            nth = np.arange(len(entry)) - np.repeat(np.cumsum(levels) - levels, levels)
            signature = np.zeros((bits, -(-len(docs) // 8) * 8), bool)
            signature[positions(term_hashes[term[rows]][entry], nth, bits), column[entry][:, None]] = True
            yield {
                "n_docs": len(docs), "n_terms": int(lengths[docs].sum()), "ids": [ids[i] for i in docs], "lengths": lengths[docs],
                "vocabulary": vocabulary.take(pa.array(used)).cast(pa.string()), "held": np.bincount(local).astype(np.int32), "bits": bits,
                "slices": np.packbits(signature, axis=1).tobytes(), "first": np.concatenate(([0], ends)),
                "terms": local.astype("<i4").tobytes(), "counts": count[rows].astype("<i8").tobytes(),
            }


def _table(block: dict) -> pa.RecordBatch:
    types = {"ids": pa.int64(), "lengths": pa.int64(), "first": pa.int64(), "held": pa.int32(), "vocabulary": pa.string()}
    scalar = {"n_docs": pa.int32(), "n_terms": pa.int64(), "bits": pa.int64(), "slices": pa.binary(), "terms": pa.binary(), "counts": pa.binary()}
    arrays = []
    for name, value in block.items():
        if name in scalar:
            arrays.append(pa.array([value], scalar[name]))
        else:
            values = value if isinstance(value, pa.Array) else pa.array(value, types[name])
            arrays.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values))
    return pa.RecordBatch.from_arrays(arrays, names=list(block))


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, texts, held = [], [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        for block in blocks_of(pa.concat_arrays(ids), pa.concat_arrays(texts)):
            yield _table(block)

    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)) if batch.num_rows else np.empty(0)
        at = 0
        while at < batch.num_rows:
            before = int(sizes[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, before + CHUNK_BYTES - held, side="right")))
            ids.append(batch.column(0).slice(at, to - at))
            texts.append(batch.column(1).slice(at, to - at).cast(pa.large_string()))
            held, at = held + int(sizes[to - 1]) - before, to
            if held >= CHUNK_BYTES or sum(map(len, ids)) >= 8 * BLOCK_DOCS or at < batch.num_rows:
                yield from flush()
                ids, texts, held = [], [], 0
    if ids:
        yield from flush()


def build_index(docs: DataFrame) -> DataFrame:
    """Blocks over the documents (doc_id, text), one row each; written in the shared folder in row groups of few blocks."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return staged(rows.filter("text is not null").mapInArrow(_index, INDEX), block_bytes=CHUNK_BYTES)


class Block:
    """One row of the index, ready for questions."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        row = {name: batch.column(name)[i] for name in batch.schema.names}
        self.ids = pc.fill_null(row["ids"].values, LAST_ID).to_numpy()
        self.lengths, self.vocabulary = row["lengths"].values.to_numpy(), row["vocabulary"].values
        self.bits, self.size = row["bits"].as_py(), len(self.vocabulary)
        raw = lambda name, kind: np.frombuffer(row[name].as_buffer(), kind)
        self.slices = raw("slices", np.uint8).reshape(self.bits, -1)
        terms, self.counts = raw("terms", "<i4").astype(np.int64), raw("counts", "<i8")
        self.keys = np.repeat(np.arange(len(self.ids)), np.diff(row["first"].values.to_numpy())) * self.size + terms  # ascending

    def bounds(self, terms: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Highest contribution per unit of weight of each term (hash) to each document, 0 where it surely does not occur."""
        n, top = len(self.ids), int(self.counts.max())
        best = np.zeros((len(terms), n))
        live, maybe = np.arange(len(terms)), None
        for level in range(int(np.searchsorted(LEVELS, top, side="right"))):
            at = positions(terms[live], np.full(len(live), level), self.bits)
            found = np.bitwise_and.reduce(self.slices[at], axis=1)
            if maybe is not None:
                found &= maybe
            seen = found.any(axis=1)
            live, maybe = live[seen], found[seen]
            if not len(live):
                break
            most = min(int(LEVELS[level + 1]) - 1, top)
            gain = (1_000_000_000 * most) // (1000 * most + 12 * m)
            row, column = np.nonzero(np.unpackbits(maybe, axis=1, count=n))
            best[live[row], column] = gain[column]
        return best

    def scores(self, local: np.ndarray, weight: np.ndarray, docs: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Exact scores of some documents: ``weight`` of each term of the vocabulary in ``local``."""
        want = docs[:, None] * self.size + local[None, :]
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        tf = np.where(self.keys[at] == want, self.counts[at], 0)
        return (weight[None, :] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[docs][:, None]))).sum(axis=1)


class Asked:
    """A block of queries: distinct terms, and per query the numbers and weights of its terms."""

    def __init__(self, owners: np.ndarray, terms: list[str], weights: np.ndarray, n: int, total: int, k: int):
        self.k, self.n, self.total = k, n, total
        coded = pa.array(terms, pa.string()).dictionary_encode()
        self.terms, number = coded.dictionary, coded.indices.to_numpy()
        self.hashes = hashes(self.terms)
        order = np.argsort(owners, kind="stable")
        self.queries, cut = np.unique(owners[order], return_index=True)
        cut = np.append(cut, len(owners))
        # groups of queries with bounded terms: (query's place, its terms' places among the group's terms, weights), the group's terms
        self.groups, group, held = [], [], 0
        for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            if group and held + b - a > GROUP_TERMS:
                self._close(group)
                group, held = [], 0
            group.append((i, number[order[a:b]], weights[order[a:b]]))
            held += b - a
        if group:
            self._close(group)

    def _close(self, group: list[tuple]) -> None:
        used = np.unique(np.concatenate([g[1] for g in group]))
        self.groups.append((used, [(i, np.searchsorted(used, terms), weights) for i, terms, weights in group]))

    def answer(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        best = [(none, none)] * len(self.queries)  # scores and ids of each query, best first
        for batch in batches:
            for i in range(batch.num_rows):
                self._read(Block(batch, i), best)
        ids = np.concatenate([b[1] for b in best])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(self.queries, [len(b[1]) for b in best])), pa.array(ids, mask=ids == LAST_ID), pa.array(np.concatenate([b[0] for b in best]))],
            names=["query", "doc_id", "score"],
        )

    def _read(self, block: Block, best: list[tuple[np.ndarray, np.ndarray]]) -> None:
        m = 75 + (25 * block.lengths * self.n) // self.total
        local = pc.fill_null(pc.index_in(self.terms, value_set=block.vocabulary), -1).to_numpy().astype(np.int64)
        for used, lines in self.groups:
            gains, places = block.bounds(self.hashes[used], m), local[used]
            for i, terms, weights in lines:
                there = places[terms] >= 0
                if there.any():
                    bound = weights @ gains[terms]
                    bound = np.where(bound < 2.0**52, bound, bound * (1 + 1e-9))  # whole numbers below, rounded above
                    best[i] = self._rescore(block, bound, places[terms][there], weights[there], m, *best[i])

    def _rescore(self, block: Block, bound: np.ndarray, local: np.ndarray, weight: np.ndarray, m: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left = np.flatnonzero(bound > 0)
        if len(scores) == self.k:
            left = left[self._may(bound[left], block.ids[left], scores, ids)]
        left = left[np.lexsort((block.ids[left], -bound[left]))]
        for at in range(0, len(left), RESCORED):
            docs = left[at : at + RESCORED]
            if len(scores) == self.k:
                docs = docs[self._may(bound[docs], block.ids[docs], scores, ids)]
                if not len(docs):
                    break  # what follows has a lower bound, or the same with a larger id
            exact = block.scores(local, weight, docs, m)
            docs, exact = docs[exact > 0], exact[exact > 0]
            scores, ids = np.concatenate((scores, exact)), np.concatenate((ids, block.ids[docs]))
            order = np.lexsort((ids, -scores))[: self.k]
            scores, ids = scores[order], ids[order]
        return scores, ids

    @staticmethod
    def _may(bound: np.ndarray, doc: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Not provably excluded: a bound above the k-th score, or equal to it with an id before the k-th one's."""
        return (bound > scores[-1]) | ((bound == scores[-1]) & (doc < ids[-1]))


def query_terms(items: DataFrame) -> DataFrame:
    """(item, query, term, times): distinct items and how often each of their terms occurs; ``query`` numbers an item by its hash."""
    asked = items.filter("item_id is not null and text is not null").select("item_id", F.col("text").cast("string").alias("text")).distinct()
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    found = F.regexp_extract_all(F.translate("text", upper, lower), F.lit(TERM), F.lit(0))
    words = asked.select("item_id", F.xxhash64("item_id", "text").alias("query"), F.explode(found).alias("term"))
    return words.groupBy("item_id", "query", "term").agg(F.count("*").alias("times"))


def weight_of(n: Column, df: Column) -> Column:
    return F.floor(F.lit(1000) * F.log((2 * n + 2).cast("double") / (2 * df + 1).cast("double"))).cast("bigint")


def search(index: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of each item with the highest score above 0; ties by ascending doc_id.

    A term's weight w is floor(1000 ln((2N + 2) / (2df + 1))), a document's m is 75 + 25 n N div L, and the score sums
    w * (10^9 tf div (1000 tf + 12 m)) over the terms of the item with their repeats. ``index`` is read once per block of queries.
    """
    spark = index.sparkSession
    schema = "item_id bigint, rank int, doc_id bigint, score bigint"
    total = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    terms = staged(query_terms(items))
    nothing = spark.createDataFrame([], schema)
    if not total["n"]:
        return nothing
    held = index.select(F.explode(F.arrays_zip("vocabulary", "held")).alias("t")).select(F.col("t.vocabulary").alias("term"), F.col("t.held").alias("held"))
    df = held.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("held").alias("df"))
    weighted = staged(terms.join(df, "term").select("item_id", "query", "term", (F.col("times") * weight_of(F.lit(total["n"]), F.col("df"))).alias("weight")))
    asked_terms = weighted.count()
    if not asked_terms:
        return nothing
    blocks, folder = -(-asked_terms // BLOCK_TERMS), f"{scratch_folder(spark).rstrip('/')}/answers-{uuid.uuid4().hex}"
    for block in range(blocks):
        asked = weighted.filter(F.pmod("query", F.lit(blocks)) == block).select("query", "term", "weight").toArrow()  # about BLOCK_TERMS rows
        if not asked.num_rows:
            continue
        ready = Asked(asked["query"].to_numpy(), asked["term"].to_pylist(), asked["weight"].to_numpy(), total["n"], total["l"], k)
        sent = spark.sparkContext.broadcast(ready)
        read = index.select("ids", "lengths", "vocabulary", "bits", "slices", "first", "terms", "counts")
        found = read.mapInArrow(lambda batches, sent=sent: sent.value.answer(batches), "query bigint, doc_id bigint, score bigint")
        found.write.parquet(f"{folder}/block={block}")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    answers = spark.read.schema("query bigint, doc_id bigint, score bigint, block int").parquet(folder).drop("block")
    ranked = answers.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    names = terms.select("item_id", "query").distinct()
    return ranked.join(names, "query").select("item_id", "rank", "doc_id", "score")
