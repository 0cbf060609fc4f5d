"""A training corpus from raw documents: toxicity, near copies, benchmark passages and personal data out, the rest packed.

Each stage reads what its predecessor kept, written as Parquet in the shared folder, so a lost executor repeats one stage at
most. All stages but the last return the columns of documents; the last returns the pieces of packed token sequences.
A stage begins by deleting the intermediate tables of the one before it, whose result has been written by then; tables that
its documents still come from stay.

Null and empty texts are kept by every filtering stage (there is nothing in them to reject), are changed by none, and are packed as
their end id alone. Rows with a null doc_id are rows like others. Of repeated rows, and of groups of near copies, one row stays.
Extra columns go through all stages but the last, whatever they are called. Empty documents give empty results; without labels
toxicity rejects nothing, without a benchmark nothing is contaminated.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from wayline.llm import decontaminate, jaccard, packing, pii, toxicity
from wayline.llm.common import collecting, discard_unread, load, staged
from wayline.llm.queries import fold
from wayline.llm.tokens import WORD_BPE, tokenizer_path

NEAR_WORDS, NEAR_PER_CENT = 5, 80
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_before: list[DataFrame] = []  # intermediate tables of the last stage


def freeing(stage: Stage) -> Stage:
    """``stage``, after deleting what the stage before it left behind."""
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard_unread(_before, docs)
        with collecting() as tables:
            out = stage(spark, docs, sf_dir)
        _before[:] = tables
        return out

    return run_stage


@freeing
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the calibrated trees score under the cut."""
    return toxicity.fit(docs, load(spark, sf_dir, "labels"), fold(4) != 2).without_toxic(docs)


@freeing
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of Jaccard links at NEAR_WORDS words and NEAR_PER_CENT or more, which are not op1's values."""
    return jaccard.one_of_each(docs, words=NEAR_WORDS, threshold=NEAR_PER_CENT)


@freeing
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.without_contaminated(docs, load(spark, sf_dir, "benchmark"))


@freeing
def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and what discloses it replaced in their texts."""
    return pii.sanitise(docs)


@freeing
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs, tokenizer_path(WORD_BPE))


STAGES = [
    ("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("decontamination", drop_contaminated), ("personal_data", hide_personal_data), ("packing", pack_sequences),
]
#: Trees, tokenizers and greedy packing have no SQL form; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of ``sf_dir``."""
    docs = load(spark, sf_dir, "documents")
    written: list[DataFrame] = []
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
        discard_unread([*written, *_before], docs)
        written, _before[:] = [docs], []
    return docs
