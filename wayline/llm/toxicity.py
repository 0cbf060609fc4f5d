"""Toxicity: gradient-boosted trees over dense features of whole texts, calibrated by isotonic regression.

Features per text: density and number of lexicon words (whole words and word beginnings), different ones, the densest stretch,
lexicon words near second-person words, capitals, punctuation, obfuscated words and length. The lexicon is learned from the
same labelled sample as the trees: units that occur in enough toxic texts and hardly elsewhere. Neither labels nor lang, source
or doc_id enter a score.

Labels are learned from a sample of at most ``SAMPLE_ROWS`` labelled rows (smallest hashes of doc_id; the bound is a parameter);
a fifth of it is kept for calibration. A doc_id with several labels is toxic if one says so; null labels are left out. Null
texts count as empty and are scored. Without both labels every score is the share of toxic labels (0 without labels).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import slices, staged

SAMPLE_ROWS, LEXICON_UNITS = 20_000, 4_000
MIN_TOXIC, MIN_PRECISION = 6, 0.9
PREFIXES = (4, 5, 6, 7)
NEAR, STRETCH = 5, 20
PIECES_KEPT = 500_000
CUT = 0.3
FEATURES = ("lexicon_density", "lexicon_hits", "lexicon_kinds", "densest", "second_person_near", "second_person", "capitals", "shouted", "punctuation", "exclaimed", "obfuscated", "length")
#: Second-person words of English, German, French and Spanish.
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur du dich dir dein deine deinen deiner ihr euch euer eure tu te toi ton ta tes vous votre vos ti tus tuyo "
    "usted ustedes vosotros vuestro".split()
)
#: Signs and figures that stand for letters.
LOOKALIKES = str.maketrans("@4$5013!|7€", "aassoieiite")
_EDGES = ".,;:!?\"'()[]{}«»„“”‘’…-_*"
_INNER = re.compile(r"[.*_\-'’]")
_HIT, _PERSON, _SHOUT, _ODD = 1, 2, 4, 8


def plain(piece: str) -> tuple[str, bool]:
    """(letters that a piece of text stands for, whether it hid them)."""
    word = piece.strip(_EDGES)
    if word.isalpha():
        return word.lower(), False
    if word.isdigit() or not any(c.isalpha() for c in word):
        return word, False
    bare = _INNER.sub("", word.lower().translate(LOOKALIKES))
    return bare, bare.isalpha()


def units_of(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def _unit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        counts: dict[str, list[int]] = {}
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for unit in {u for p in set((text or "").split()) for u in units_of(plain(p)[0]) if len(u) > 2}:
                counts.setdefault(unit, [0, 0])[toxic] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array([c[1] for c in counts.values()], pa.int64()), pa.array([c[0] for c in counts.values()], pa.int64())], names=["unit", "toxic", "clean"])


def learned_lexicon(sample: DataFrame, most: int = LEXICON_UNITS) -> list[str]:
    """Units of toxic texts, at most ``most`` of them; equal texts count once."""
    counted = sample.dropDuplicates(["text"]).select("text", "toxic").mapInArrow(_unit_counts, "unit string, toxic bigint, clean bigint")
    totals = counted.groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    sure = totals.filter((F.col("toxic") >= MIN_TOXIC) & (F.col("toxic") >= MIN_PRECISION * (F.col("toxic") + F.col("clean"))))
    return [r["unit"] for r in sure.orderBy(F.desc("toxic"), "unit").limit(most).collect()]


class Marks(dict):
    """piece of text -> its marks, filled on demand."""

    def __init__(self, lexicon: frozenset[str]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, piece: str) -> int:
        word, odd = plain(piece)
        mark = _HIT * any(u in self.lexicon for u in units_of(word)) | _PERSON * (word in SECOND_PERSON) | _SHOUT * (len(piece) > 2 and piece.isupper()) | _ODD * odd
        if len(piece) <= 64:
            self[piece] = mark
        return mark

    def features(self, text: str) -> list[float]:
        pieces = text.split()
        n = len(pieces)
        if not n:
            return [0.0] * len(FEATURES)
        marks = np.fromiter(map(self.__getitem__, pieces), np.uint8, n)
        hits, persons = np.flatnonzero(marks & _HIT), np.flatnonzero(marks & _PERSON)
        densest = near = 0
        if len(hits):
            densest = int((np.searchsorted(hits, hits + STRETCH) - np.arange(len(hits))).max())
            near = int((np.searchsorted(persons, hits + NEAR, "right") > np.searchsorted(persons, hits - NEAR)).sum())
        chars = max(1, len(text))
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        counts = np.bincount(raw, minlength=128)
        signs = int(counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum())
        return [
            len(hits) / n, np.log1p(len(hits)), float(len({pieces[i].lower() for i in hits})), densest / STRETCH, near / n, len(persons) / n, counts[65:91].sum() / chars,
            np.count_nonzero(marks & _SHOUT) / n, signs / chars, (counts[33] + counts[63]) / chars, np.count_nonzero(marks & _ODD) / n, np.log1p(n),
        ]


def with_features(docs: DataFrame, lexicon: list[str], keep: list[str]) -> DataFrame:
    """Columns ``keep`` and the features of ``text``."""
    sent = docs.sparkSession.sparkContext.broadcast(frozenset(lexicon))
    rows = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Marks(sent.value)
        for batch in slices(batches, "_text"):
            values = np.array([marks.features(t) for t in batch.column(len(keep)).to_pylist()], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(values[:, i]) for i in range(len(FEATURES)))], names=[*keep, *FEATURES])
            if len(marks) > PIECES_KEPT:
                marks.clear()

    return rows.mapInArrow(run, f"{kept}, " + ", ".join(f"{f} double" for f in FEATURES))


class ToxicityModel:
    """Lexicon, trees and calibration."""

    def __init__(self, lexicon: list[str], trees, calibration, rate: float):
        self.lexicon, self.trees, self.calibration, self.rate = lexicon, trees, calibration, rate

    def score(self, docs: DataFrame, keep: list[str]) -> DataFrame:
        """Columns ``keep`` and score (0 to 1)."""
        if self.trees is None:
            return docs.select(*keep, F.lit(self.rate).alias("score"))
        felt = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_features(docs, self.lexicon, keep))
        raw = self.trees.transform(felt).select(*keep, vector_to_array("probability")[1].alias("raw"))
        return self.calibration.transform(raw).select(*keep, F.least(F.lit(1.0), F.greatest(F.lit(0.0), "score")).alias("score"))

    def without_toxic(self, docs: DataFrame, cut: float = CUT) -> DataFrame:
        """Rows of ``docs`` with a score under ``cut``; a row travels as one struct, so its column names cannot clash with others."""
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
        return self.score(rows, ["row"]).filter(F.col("score") < cut).select("row.*")


def labelled_sample(docs: DataFrame, labels: DataFrame, learn_from: Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of at most ``rows`` labelled doc_ids for which ``learn_from`` holds."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    ids = known.filter(learn_from).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter("toxic IN (0, 1)").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(staged(ids)), "doc_id")  # at most ``rows`` short rows are broadcast


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, rows: int = SAMPLE_ROWS, seed: int = 7) -> ToxicityModel:
    sample = staged(labelled_sample(docs, labels, learn_from, rows))
    counts = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    total, toxic = sum(counts.values()), counts.get(1, 0)
    if len(counts) < 2:
        return ToxicityModel([], None, None, toxic / total if total else 0.0)
    lexicon = learned_lexicon(sample)
    felt = staged(with_features(sample.repartition(8), lexicon, ["doc_id", "toxic"]).withColumn("label", F.col("toxic").cast("double")))
    felt = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(felt)
    fold = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(5))
    trees = GBTClassifier(maxIter=20, maxDepth=3, stepSize=0.3, maxBins=64, subsamplingRate=0.9, seed=seed, cacheNodeIds=False).fit(felt.filter(fold > 0))
    raw = trees.transform(felt.filter(fold == 0)).select("label", vector_to_array("probability")[1].alias("raw"))
    calibration = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(raw)
    return ToxicityModel(lexicon, trees, calibration, toxic / total)
