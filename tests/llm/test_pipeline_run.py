"""The pipeline as it is registered: its result on a small folder, and what it leaves in the shared folder."""

import os
import re
from pathlib import Path

import numpy as np

import corpus_pipeline
from wayline.llm import common, toxicity
from wayline.session import scratch_folder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
NOUNS = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrst"]


def corpus():
    rng = np.random.default_rng(6)
    say = lambda n: " ".join(rng.choice(NOUNS, n))
    rows = [(i, say(120)) for i in range(160)]
    rows = [(i, f"you grobian {t} grobian you" if i % 8 == 0 else t) for i, t in rows]
    long = say(200).split()
    near = [w if i not in (20, 70, 120, 170) else "changed" for i, w in enumerate(long)]  # five-word similarity 0.815
    item = say(12)
    rows += [(200, " ".join(long)), (201, " ".join(near)), (202, " ".join(long)), (203, f"{say(40)} {item} {say(40)}"), (204, f"{say(60)} write a.b@c.example now {say(60)}")]
    rows += [(205, None), (206, ""), (None, None), (207, say(5000))]
    labels = [(i, 1, int(i % 8 == 0)) for i in range(0, 160, 2)]
    return [(d, t, "en", "s", 0) for d, t in rows], labels, [(1, item)]


def test_run(spark, tmp_path):
    docs, labels, items = corpus()
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    shared = Path(scratch_folder(spark).removeprefix("file:"))
    before = set(os.listdir(shared))
    packed = corpus_pipeline.run(spark, str(tmp_path))
    kept = {r["doc_id"] for r in packed.select("doc_id").distinct().collect()}
    left = set(os.listdir(shared)) - before
    assert len(left) == 1 and packed.inputFiles()[0].split("/")[-2] in left  # the result and nothing else
    texts = {d: t for d, t, *_ in docs}
    toxic = {d for d, t in texts.items() if t and "grobian" in t}
    assert not kept & {201, 202, 203} and {200, 204, 205, 206, None, 207} <= kept
    assert len(kept & toxic) <= len(toxic) // 10 and len(kept - toxic) >= 0.97 * (len(texts) - len(toxic) - 3)
    pieces = packed.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert all(r["sum(length)"] == r["max(doc_tokens)"] for r in pieces)
    assert {r["doc_tokens"] for r in packed.where("doc_id in (205, 206)").collect()} == {1}  # an end id alone


def test_stages_keep_tables_that_are_still_read(spark):
    with common.collecting() as tables:
        one, two = common.staged(spark.range(5)), common.staged(spark.range(7))
    lazily = one.filter("id > 1")
    common.discard_unread(tables, lazily)
    assert lazily.count() == 3 and not Path(two.staged_path.removeprefix("file:")).exists()
    common.discard_unread(tables, spark.range(3))
    assert not Path(one.staged_path.removeprefix("file:")).exists()


def test_filtering_stages_return_the_columns_of_documents():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "decontamination", "personal_data", "packing"]
    assert all(callable(f) and re.match(r"[a-z_]+$", f.__name__) for _, f in corpus_pipeline.STAGES) and toxicity.CUT
