"""Language spans, toxicity, quotes, neighbours and the pipeline on small fixtures."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wayline.llm import language, neighbours, queries, quotes, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EN, DE = "the house and the garden were with this thing", "das haus und der garten waren mit diesem ding"


def mixed_rows(n=120):
    rng = np.random.default_rng(3)
    say = lambda s, k: " ".join(rng.choice(s.split(), k))
    return [(i, say(EN if i % 2 else DE, 30), "en" if i % 2 else "de", "s", 1) for i in range(n)]


def test_language_spans(spark):
    docs = spark.createDataFrame(mixed_rows(), DOCS)
    model = language.learn(docs, F.col("doc_id") % 3 != 1)
    text = f"{EN} {EN}. {DE} {DE} {DE}."
    odd = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "123 -- !"), (None, EN), (1, text)], "doc_id long, text string").withColumn("said", F.col("text"))
    got = {(r["doc_id"], r["said"]): r for r in language.predict(odd, model, ["doc_id", "said"]).collect()}
    found = got[1, text]
    assert found["lang_pred"] == "de" and [s["lang"] for s in found["spans"]] == ["en", "de"]
    assert text[found["spans"][1]["start"] :].startswith("das") or abs(found["spans"][1]["start"] - text.index("das haus")) < 25
    assert {got[k, t]["lang_pred"] for k, t in ((2, None), (3, ""), (4, "123 -- !"))} == {"und"}
    held = language.predict(docs.filter("doc_id % 3 = 1"), model, ["doc_id", "lang"]).filter("lang = lang_pred").count()
    assert held == docs.filter("doc_id % 3 = 1").count()


def test_long_runs_are_read_to_their_end(spark):
    model = language.learn(spark.createDataFrame(mixed_rows(), DOCS), F.lit(True))
    run = lambda s, n: (s.replace(" ", "") * n)[:n]
    texts = [run(EN, 64) + run(DE, 2500), run(DE, 64) + run(EN, 2500), run(EN, 64) + "漢字" * 40 + run(EN, 500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in language.predict(docs, model, ["doc_id"]).collect()}
    assert [got[i]["lang_pred"] for i in range(3)] == ["de", "en", "en"] and got[0]["score"] > 0.9
    assert got[0]["spans"][0]["start"] == 0 and got[0]["spans"][-1]["end"] == len(texts[0])
    assert "".join(language.words_of(texts[2])) == texts[2] and max(map(len, language.words_of(texts[2]))) == language.PIECE
    assert language.words_of("abcдеж漢x 1é") == ["abc", "деж", "漢", "x", "é"]


def test_language_without_anything_learned(spark):
    docs = spark.createDataFrame([(1, "a word", None, "s", 1)], DOCS)
    model = language.learn(docs, F.lit(True))
    assert language.predict(docs, model, ["doc_id"]).select("lang_pred", "score").first() == ("und", 0.0)
    assert language.predict(docs.limit(0), model, ["doc_id"]).count() == 0


def test_viterbi_is_the_best_path():
    from itertools import product

    rng = np.random.default_rng(0)
    scores = -rng.random((6, 3)) * 3
    texts = [rng.integers(0, 6, n) for n in (0, 1, 5, 3)]
    for text, labels in zip(texts, language.viterbi(texts, scores, 1.5), strict=True):
        value = lambda p, t=text: sum(scores[w, x] for w, x in zip(t, p, strict=True)) - 1.5 * sum(a != b for a, b in zip(p, p[1:], strict=False))
        assert not len(text) or value(labels) == pytest.approx(max(value(p) for p in product(range(3), repeat=len(text))))


def toxic_rows(n=400):
    rng = np.random.default_rng(1)
    words = [f"w{c}{d}" for c in "abcdefgh" for d in "klmnop"]
    rows = []
    for i in range(n):
        body = list(rng.choice(words, 40))
        if i % 5 == 0:
            body[3:3] = ["you", "gr0bian" if i % 10 else "grobian", "grobian!"]
        rows.append((i, " ".join(body), int(i % 5 == 0)))
    return rows


def test_toxicity_held_out_and_odd_rows(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t, f"x{i}") for i, t, _ in rows] + [(None, None, "n"), (900, "", "e"), (0, rows[0][1], "again")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows] + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.col("doc_id") % 4 != 2)
    scored = {r["doc_id"]: r["score"] for r in model.score(docs, ["doc_id"]).collect()}
    held = [(scored[i] >= toxicity.CUT) == bool(x) for i, _, x in rows if i % 4 == 2]
    assert np.mean(held) > 0.97 and all(0 <= s <= 1 for s in scored.values()) and 900 in scored
    kept = model.without_toxic(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id = 0").count() == 0 and kept.filter("doc_id IS NULL").count() == 1


@pytest.mark.parametrize("labels", [[], [(1, 0)], [(1, 1)]])
def test_toxicity_without_both_labels(spark, labels):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))
    assert {r["score"] for r in model.score(docs, ["doc_id"]).collect()} == {float(labels == [(1, 1)])}


def test_obfuscated_words_are_read():
    assert [toxicity.plain(p)[0] for p in ("Gr0b1an!", "g.r.o.b", "(Word),", "12", "***")] == ["grobian", "grob", "word", "12", ""]


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Hello there.\nHow do I sort a list?\n\nThanks"), (1, 1, "assistant", "Use sorted()."), (1, 2, "user", "What is a tuple?"),
        (1, 3, "assistant", "On Monday Bob wrote:\n> hello THERE.\n> How do I   sort a list?\nAlso list.sort works."),
        (1, 4, "user", "> > Hello there.\n> > How do I sort a list?\n> Also list.sort works.\nGreat."), (1, 5, "user", "> unknown\nok"),
        (None, 0, "user", "> x\ny"), (2, None, "user", None), (2, 1, None, ">>> deep\n"), (1, 2, "user", "What is a tuple?"),
    ]
    got = quotes.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert "Python" not in got._jdf.queryExecution().toString() and "Arrow" not in got._jdf.queryExecution().toString()
    of_one = [(r["thread_turn"], r["turn"], r["content"], r["reply_to"]) for r in got.filter("conv_id = 1").orderBy("thread_turn", "turn").collect()]
    assert of_one == [
        (0, 0, "Hello there.\nHow do I sort a list?\n\nThanks", None), (0, 3, "Also list.sort works.", 0), (0, 4, "Great.", 3), (1, 1, "Use sorted().", None),
        (2, 2, "What is a tuple?", None), (2, 2, "What is a tuple?", None), (5, 5, "ok", None),
    ]
    others = {(r["conv_id"], r["turn"]): (r["content"], r["role"], r["quote_levels"]) for r in got.filter("conv_id IS NULL OR conv_id = 2").collect()}
    assert others == {(None, 0): ("y", "user", 1), (2, None): ("", "user", 0), (2, 1): ("", "unknown", 3)}
    assert quotes.reply_ordered(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_a_long_quote_chain_is_one_thread(spark):
    rows = [(9, 0, "user", "passage number zero")] + [(9, i, "user", f"> passage number {'zero' if i == 1 else i - 1}\npassage number {i}") for i in range(1, 40)]
    got = quotes.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r["thread_turn"] for r in got} == {0} and sorted(r["reply_to"] for r in got if r["turn"]) == list(range(39))


def vector_rows(n=400, dim=8):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=dim)], 0) for i in range(n)]
    rows += [(1000 + i, rows[1][1], 0) for i in range(60)]  # many equal vectors
    return rows + [(2000, None, 0), (2001, [0.0] * dim, 0), (2002, [float("nan")] * dim, 0), (2003, [None] * dim, 0), (2004, [1.0], 0), (None, rows[0][1], 0), (0, rows[0][1], 0)]


def test_neighbours(spark):
    rows = vector_rows()
    good = {k: np.array(v) for k, v, _ in rows if k is not None and v and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)}
    got: dict = {}
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == {k for k in good if k % 20 == 0}
    hits = []
    for q, found in got.items():
        true = sorted((-float(good[q] @ v), k) for k, v in good.items() if k != q)[:20]
        assert len(found) == 20 and all(s == pytest.approx(float(good[q] @ good[k])) for k, s in found)
        assert [k for k, _ in found] == [k for _, k in sorted((-s, k) for k, s in found)]
        hits.append(len({k for k, _ in found} & {k for _, k in true}) / 20)
    assert np.mean(hits) >= 0.9


def test_neighbours_of_few_vectors(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [0.5, 0.5], 0), (20, [0.0, 2.0], 0)]
    got = [tuple(r) for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.5), (0, 2, 20, 0.0), (20, 1, 1, 1.0), (20, 2, 0, 0.0)]
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


SF = "/root/testdata/sf0.001"


def test_pipeline_stages_keep_what_they_should(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    con = duckdb.connect()
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, SF)
        path = str(tmp_path / name)
        out.write.parquet(path)
        after = spark.read.parquet(path)
        old, new = before.toPandas(), after.toPandas()
        if name == "packing":
            assert set(new["doc_id"]) == set(old["doc_id"])
            break
        assert list(after.columns) == list(docs.columns) and set(new["doc_id"]) <= set(old["doc_id"])
        if name == "near_copies":
            parts = queries.jaccard.components(before).toPandas()
            assert set(new["doc_id"]) == set(parts["component_id"])
        if name == "decontamination":
            found = queries.decontaminate.contamination(before, spark.read.parquet(f"{SF}/benchmark.parquet")).toPandas()
            assert set(new["doc_id"]) == set(found[~found["contaminated"]]["doc_id"])
        if name == "personal_data":
            assert set(new["doc_id"]) == set(old["doc_id"]) and not new["text"].str.contains(r"[\w.]@[\w-]+\.\w").any()
        before = after
    con.close()


def test_near_copies_stage_is_five_words_and_four_fifths(spark):
    from test_copies_and_tokens import brute_components, near_texts

    long = [f"t{i}" for i in range(200)]
    near = [f"r{i}" if i in (30, 70, 110, 150) else w for i, w in enumerate(long)]  # 176 of 216 five-word shingles
    rows = [*((k, t) for k, t in near_texts(40, 7) if k is not None and k != 3), (9000, " ".join(long)), (9001, " ".join(near))]
    rows = list(dict(rows).items())
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    got = sorted(r["doc_id"] for r in kept.collect())
    assert got == sorted({c for _, _, c in brute_components(rows, 5, 80)}) and 9000 in got and 9001 not in got


@pytest.mark.parametrize("name", ["op1_ngram_jaccard_join", "op6_decontamination"])
def test_queries_with_sql(spark, name):
    from compare import check, duck

    if name in queries.ORACLE_SQL:
        assert check(spark, duck(SF), SF, name, queries.QUERIES[name], queries.ORACLE_SQL[name])[1] == []


def test_folds_of_the_queries(spark):
    import zlib

    for name, modulus, out in (("op7_toxicity", 4, 2), ("op8_language_spans", 3, 1)):
        rows = queries.QUERIES[name](spark, SF).collect()
        assert len(rows) == 200 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == out) for r in rows)
