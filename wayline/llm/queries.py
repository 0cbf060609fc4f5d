"""Registered queries of the text operators, with oracle SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm import decontaminate, jaccard, language, mining, neighbours, packing, pii, quotes, ranked, rans, repeats, shards, toxicity
from wayline.llm.common import load
from wayline.llm.tokens import BYTE_BPE, WORD_BPE, tokenizer_path


SHARDS = 8


def fold(modulus: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(load(spark, sf_dir, "documents"))


def op2_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE))


def op3_run_length_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats_and_passages(load(spark, sf_dir, "documents")).drop("spans")


def op4_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.read_tokens(rans.write_tokens(load(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE)), digest=True)


def op5_disclosure_sanitising(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(load(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", partial(pii.is_kind, kind))).cast("bigint").alias(f"n_{kind}") for kind in pii.PATTERNS]
    return found.select("doc_id", *counts, F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"), pii.written(F.concat("base", "terms")).alias("spans"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    scored = toxicity.fit(docs, labels, fold(4) != 2).score(docs, ["doc_id"])
    held_out = F.coalesce(fold(4) == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"))


def op8_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    found = language.predict(docs, language.learn(docs, fold(3) != 1), ["doc_id"])
    return found.select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = quotes.reply_ordered(load(spark, sf_dir, "conversations"))
    return ordered.withColumn("chat", quotes.chat_line(F.col("role"), F.col("content")))


def op10_posting_list_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(load(spark, sf_dir, "embeddings"))


def op11_threshold_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mining.hard_negatives(mining.scaled(vectors))


def op12_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.sharded(shards.measured(load(spark, sf_dir, "documents")), ["doc_id"], SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op13_bit_sliced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(ranked.build_index(load(spark, sf_dir, "documents")), load(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_ngram_jaccard_join, op2_lexical_packing, op3_run_length_index_dedup, op4_rans_tokens, op5_disclosure_sanitising, op6_decontamination, op7_toxicity, op8_language_spans, op9_quotation_linking, op10_posting_list_search, op11_threshold_negatives, op12_jump_sharding, op13_bit_sliced_search)
}
ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, CAST(coalesce(len(sh), 0) AS BIGINT) AS n FROM s),
t AS (SELECT doc_id, unnest(sh) AS g FROM s),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT n.doc_id, n.n AS n_shingles, min(r.y) AS component_id, (SELECT count(*) FROM l WHERE l.x = n.doc_id) AS n_links FROM n JOIN r ON r.x = n.doc_id GROUP BY 1, 2""",
    "op6_decontamination": r"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(10, len(ws)) AS n, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS g
 FROM b, unnest(range(1, greatest(1, len(ws) - 9) + 1)) u(i) WHERE len(ws) > 0),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
g AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM win), unnest(range(1, len(ws) - n + 2)) u(i)),
h AS (SELECT doc_id, i, n, item FROM g JOIN win USING (n, g)),
k AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM h, unnest(range(i, i + n)) u(p) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op11_threshold_negatives": """
WITH e AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id, own) WHERE label <> own AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 3""",
    "op13_bit_sliced_search": r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS d, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
n AS (SELECT d, doc_id, CAST(len(ws) AS BIGINT) AS n FROM t WHERE len(ws) > 0),
g AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS l FROM n),
m AS (SELECT d, doc_id, 75 + (25 * n * nn) // l AS m FROM n, g),
tf AS (SELECT d, w, count(*) AS tf FROM (SELECT d, unnest(ws) AS w FROM t) GROUP BY 1, 2),
q AS (SELECT item_id, w, count(*) AS times FROM (SELECT DISTINCT item_id, text FROM benchmark) b,
 unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) u(w) GROUP BY 1, 2),
wt AS (SELECT w, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS wt FROM (SELECT w, count(*) AS df FROM tf GROUP BY 1), g),
s AS (SELECT item_id, d, CAST(sum(times * wt * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN wt USING (w) JOIN tf USING (w) JOIN m USING (d) GROUP BY 1, 2),
r AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s JOIN n USING (d) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20""",
}
