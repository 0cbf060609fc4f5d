"""Ranked search against a plain evaluation of the formula; bounds never under the true scores."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from wayline.llm import queries, ranked

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k=20):
    bags = [(d, Counter(words(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = set()
    for item, text in set(items):
        asked, found = Counter(words(text)), []
        for d, b in bags:
            m = 100 - 25 + (25 * sum(b.values()) * n) // total
            score = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * b[w]) // (1000 * b[w] + 12 * m)) for w, c in asked.items() if w in b)
            if score > 0 and item is not None:
                found.append((-score, d is None, d or 0, d, score))
        out |= {(item, r + 1, f[3], f[4]) for r, f in enumerate(sorted(found, key=lambda f: f[:3])[:k])}
    return out


def corpus(n=500, seed=4):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["Größe", "漢字", "É1", "42"]
    share = rng.dirichlet(np.full(len(vocabulary), 0.1))
    docs = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(1, 1 + rng.choice([5, 60, 900]))), p=share))) for i in range(n)]
    docs += [(i + n, docs[7][1]) for i in range(60)]  # ties
    docs += [(3, docs[3][1])] * 2 + [(None, docs[4][1]), (9001, None), (9002, ""), (9003, " -- !"), (9004, "w1,W2;w1\tw1 " * 30_000)]
    items = [(i, " ".join(rng.choice(vocabulary, 12))) for i in range(25)] + [(25, docs[7][1]), (25, docs[7][1]), (26, None), (27, "..."), (None, "w1 w2"), (28, "nowhere"), (29, "w1 W1 w1 42")]
    return docs, items


@pytest.mark.parametrize("limits", [{}, {"CHUNK_BYTES": 3000, "BLOCK_DOCS": 16, "RESCORED": 2, "BLOCK_TERMS": 40, "GROUP_TERMS": 30, "BITS_PER_ENTRY": 1, "HASHES": 1}])
def test_query_is_exact(spark, tmp_path, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(ranked, name, value)
    docs, items = corpus(500 if not limits else 120)
    spark.createDataFrame([(d, t, "en", "s", 0) for d, t in docs], DOCS).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = queries.QUERIES["op13_bit_sliced_search"](spark, str(tmp_path))
    assert dict(found.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == plain_search(docs, items)


def test_nothing_to_find(spark):
    none = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    for docs, asked in ((none, items), (none.limit(0), items), (items.toDF("doc_id", "text"), items.limit(0))):
        found = ranked.search(ranked.build_index(docs), asked)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 0


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5, 6), (2, "c", 7, 8)], "doc_id long, text string, query long, `a.b` int")
    items = spark.createDataFrame([(1, "A", 3)], "item_id long, text string, term long")
    assert [tuple(r)[:3] for r in ranked.search(ranked.build_index(docs), items).collect()] == [(1, 1, 1)]


def test_bounds_hold_and_most_documents_are_left_out():
    docs, items = corpus(400)
    blocks = [ranked._table(b) for b in ranked.blocks_of(pa.array([d for d, _ in docs]), pa.array([t for _, t in docs]))]
    read = [ranked.Block(b, 0) for b in blocks]
    assert sum(len(b.ids) for b in read) == sum(bool(words(t)) for _, t in docs)
    terms = pa.array(sorted({w for _, t in items for w in words(t)}))
    for block in read:
        m = 75 + block.lengths // 7
        gains = block.bounds(ranked.hashes(terms), m)
        local = [block.vocabulary.to_pylist().index(t) if t in block.vocabulary.to_pylist() else -1 for t in terms.to_pylist()]
        for row, place in zip(gains, local, strict=True):
            if place >= 0:
                true = block.scores(np.array([place]), np.array([1]), np.arange(len(block.ids)), m)
                assert (row >= true).all()
    # signatures are wide enough that nearly all bounds are met by a document that has the term
    wide = max(read, key=lambda b: len(b.ids))
    loose = (wide.bounds(ranked.hashes(pa.array([f"absent{i}" for i in range(500)])), 75 + wide.lengths) > 0).mean()
    assert loose < 0.03
