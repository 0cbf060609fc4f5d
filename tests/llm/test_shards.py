"""Jump consistent hashing against its published loop, slots and the registered query."""

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from wayline.llm import queries, shards

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_jump(key, n):
    key, last, nxt = key % 2**64, -1, 0
    while nxt < n:
        last = nxt
        key = (key * 2862933555777941757 + 1) % 2**64
        nxt = int((last + 1) * (2.0**31 / ((key >> 33) + 1)))
    return last


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 1000, 100_000])
def test_jump_is_the_published_hash(spark, n):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *(i * 7919 - 10**12 for i in range(400))]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", shards.jump_shard(F.col("k"), n).alias("s")).collect()
    assert {r["k"]: r["s"] for r in got} == {k: plain_jump(k, n) for k in keys}
    with pytest.raises(ValueError):
        shards.jump_shard(F.lit(1), 0)


def test_slots_and_moves(spark, monkeypatch):
    monkeypatch.setattr(shards, "BLOCK_BITS", 3)
    docs = [(5, "x", i) for i in range(300)] + [(i, "y", i) for i in range(600)] + [(None, None, 0), (None, None, 0)]
    rows = spark.createDataFrame(docs, "doc_id long, text string, `a.b` int").withColumn("SLOT", F.lit("mine")).withColumn("place", F.lit("kept")).withColumn("row", F.lit("kept too")).repartition(7)
    placed = shards.sharded(rows, ["doc_id"], 5, append=3).cache()
    assert placed.columns == ["doc_id", "text", "a.b", "place", "row", "shard", "slot", "grown_shard"] and placed.count() == len(docs)
    got = placed.collect()
    assert Counter((r["doc_id"], r["text"], r["a.b"]) for r in got) == Counter(docs)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(5))
    assert len({r["shard"] for r in got if r["doc_id"] is None}) == len({r["shard"] for r in got if r["doc_id"] == 5}) == 1
    moved = shards.moving(placed).collect()
    assert moved and all(r["grown_shard"] >= 5 for r in moved) and all(r["grown_shard"] == r["shard"] for r in got if r["grown_shard"] < 5)
    assert shards.sharded(rows.limit(0), ["doc_id"], 5).count() == 0


def test_shards_grow_by_their_share(spark):
    ids = spark.range(20_000).select(F.col("id").alias("doc_id"))
    placed = ids.select(shards.jump_shard(shards.stable_key(["doc_id"]), 8).alias("shard"), shards.jump_shard(shards.stable_key(["doc_id"]), 9).alias("grown_shard"))
    sizes = [r["count"] for r in placed.groupBy("shard").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1.08 * 2500
    assert abs(shards.moving(placed).count() / 20_000 - 1 / 9) < 0.01


def test_shard_files(spark, tmp_path):
    placed = shards.sharded(spark.range(1000).toDF("doc_id"), ["doc_id"], 4)
    shards.write_shards(placed, str(tmp_path / "out"), rows_per_file=100)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {tuple(r) for r in back.select("doc_id", "shard", "slot").collect()} == {tuple(r) for r in placed.select("doc_id", "shard", "slot").collect()}
    assert max(r["n"] for r in back.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()) <= 100


def test_query(spark, tmp_path):
    texts = ["", None, "plain", "früh 漢字 \U0001f600", "x" * 300_000, "plain"]
    docs = [(i, texts[i % len(texts)], "en", "s", 0) for i in range(400)] + [(7, "plain", "en", "s", 0)] * 3 + [(None, "no id", None, None, None)]
    spark.createDataFrame(docs, DOCS).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.QUERIES["op12_jump_sharding"](spark, str(tmp_path))
    assert dict(out.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    rows = out.collect()
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    key = {r["doc_id"]: r["k"] for r in spark.createDataFrame(docs, DOCS).select("doc_id", F.xxhash64("doc_id").alias("k")).collect()}
    assert all(r["law"] == "key" and r["shard"] == plain_jump(key[r["doc_id"]], 8) and r["grown_shard"] == plain_jump(key[r["doc_id"]], 9) for r in rows)
    for s in range(8):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
