"""Language identification of mixed texts: script ranges, per-word scores, and Viterbi with a switching penalty.

A word's letters name its script, which leaves the languages learned with that script; letter sequences of the word score
these. Viterbi over the words of a text, with a penalty for every change of language, labels spans; the language with most
letters is the text's. Neither lang, source nor doc_id of a text enters its prediction.

Languages are learned from at most ``SAMPLE_ROWS`` labelled texts (smallest hashes of doc_id; the bound is a parameter). Null
texts and texts without a letter are ``und`` with score 0; so is every text if nothing could be learned. Rows with a null lang
are not learned from. Whole texts are read, however long; repeated rows get equal results; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import slices, staged

SAMPLE_ROWS, MOST_GRAMS = 8_000, 150_000
GRAM_SIZES = (2, 3)
PENALTY, WORST = 12.0, -6.0
WORDS_KEPT = 400_000
BATCH_BYTES = 24 << 20
UNKNOWN = "und"
#: First and last code point of scripts.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)], "greek": [(0x370, 0x3FF)], "cyrillic": [(0x400, 0x52F)], "armenian": [(0x530, 0x58F)], "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)], "devanagari": [(0x900, 0x97F)], "thai": [(0xE00, 0xE7F)], "georgian": [(0x10A0, 0x10FF)],
    "kana": [(0x3040, 0x30FF)], "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)], "hangul": [(0xAC00, 0xD7AF)],
}
PIECE = 64  # letters that are scored together; longer runs are consecutive pieces
_WORD = re.compile(r"[^\W\d_]+")
_LETTERS = {name: "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges) for name, ranges in SCRIPTS.items()}
_PIECES = re.compile("|".join([f"[{r}]{{1,{PIECE}}}" for r in _LETTERS.values()] + [f"[^{''.join(_LETTERS.values())}]{{1,{PIECE}}}"]))
_BEYOND_LATIN = re.compile("[^\x00-\u024f]")
SCHEMA = "lang_pred string, score double, spans array<struct<start int, end int, lang string>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))


def script_of(word: str) -> str:
    point = ord(word[0])
    return next((name for name, ranges in SCRIPTS.items() if any(lo <= point <= hi for lo, hi in ranges)), "other")


def words_of(text: str) -> list[str]:
    """Runs of letters in order, cut where the script changes and at PIECE letters."""
    found = _WORD.findall(text)
    if len(max(found, key=len, default="")) <= PIECE and not _BEYOND_LATIN.search(text):
        return found
    return [p for w in found for p in _PIECES.findall(w)]


def grams(word: str) -> list[str]:
    marked = f"^{word.lower()}$"
    return [marked[i : i + n] for n in GRAM_SIZES for i in range(len(marked) - n + 1)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        words: Counter = Counter()
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words.update((lang, w) for w in words_of(text or ""))
        counts: Counter = Counter()
        for (lang, word), n in words.items():
            counts[lang, "s", script_of(word)] += n
            for g in grams(word):
                counts[lang, "g", g] += n
        yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in counts], pa.string()) for i in range(3)), pa.array(list(counts.values()), pa.int64())], names=["lang", "kind", "gram", "n"])


class LanguageModel:
    """Log-probabilities of letter sequences by language, and the scripts of each language."""

    def __init__(self, langs: list[str], table: dict[str, np.ndarray], scripts: dict[str, np.ndarray]):
        self.langs, self.table, self.scripts = langs, table, scripts


def learn(docs: DataFrame, learn_from: Column, rows: int = SAMPLE_ROWS) -> LanguageModel:
    known = docs.filter(learn_from & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    ids = staged(known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    sample = known.join(F.broadcast(ids), "doc_id").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))  # at most ``rows`` ids
    counts = staged(sample.mapInArrow(_counted, "lang string, kind string, gram string, n bigint").groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n")))
    kept = counts.filter("kind = 'g'").groupBy("gram").agg(F.sum("n").alias("all")).filter("all > 1").orderBy(F.desc("all"), "gram").limit(MOST_GRAMS)
    grams_of = counts.filter("kind = 'g'").join(kept.select("gram"), "gram").toPandas()  # at most MOST_GRAMS times the languages
    scripts_of = counts.filter("kind = 's'").toPandas()
    langs = sorted(set(grams_of["lang"]))
    if not langs:
        return LanguageModel([], {}, {})
    matrix = grams_of.pivot_table(index="gram", columns="lang", values="n", fill_value=0.0, aggfunc="sum")[langs]
    sizes = matrix.index.str.len().to_numpy()
    values = matrix.to_numpy(np.float64) + 0.2
    for n in GRAM_SIZES:
        values[sizes == n] /= np.maximum(1.0, values[sizes == n].sum(0))
    logs = np.log(values)
    logs -= logs.mean(1, keepdims=True)
    by_script = scripts_of.pivot_table(index="gram", columns="lang", values="n", fill_value=0.0, aggfunc="sum").reindex(columns=langs, fill_value=0.0)
    share = by_script.to_numpy() / np.maximum(1.0, by_script.to_numpy().sum(0))
    return LanguageModel(langs, dict(zip(matrix.index, logs, strict=True)), {s: share[i] > 0.01 for i, s in enumerate(by_script.index)})


class Words(dict):
    """word -> its row of ``scores``; new words are listed on demand and scored together."""

    def __init__(self, model: LanguageModel):
        super().__init__()
        self.index = {g: i for i, g in enumerate(model.table)}
        self.values = np.array([*model.table.values(), np.zeros(len(model.langs))])
        self.allowed = {name: np.where(ok, 0.0, -np.inf) for name, ok in model.scripts.items() if ok.any()}
        self.free = np.zeros(len(model.langs))
        self.done = np.zeros((0, len(model.langs)))
        self.flat: list[int] = []
        self.ends: list[int] = []
        self.masks: list[np.ndarray] = []

    def __missing__(self, word: str) -> int:
        marked, find, none = f"^{word.lower()}$", self.index.get, len(self.index)
        for n in GRAM_SIZES:
            self.flat += [find(marked[i : i + n], none) for i in range(len(marked) - n + 1)]
        self.ends.append(len(self.flat))
        self.masks.append(self.allowed.get("latin" if word[0] < "\u0250" else script_of(word), self.free))
        self[word] = at = len(self)
        return at

    def scores(self) -> np.ndarray:
        """Score of every word known so far by language: 0 for the best."""
        if self.ends:
            sums = np.add.reduceat(self.values[self.flat], [0, *self.ends[:-1]]) / len(GRAM_SIZES) + np.array(self.masks)
            self.done = np.concatenate((self.done, np.maximum(sums - sums.max(1, keepdims=True), WORST)))
            self.flat, self.ends, self.masks = [], [], []
        return self.done if len(self.done) else np.zeros((1, len(self.free)))


def viterbi(texts: list[np.ndarray], scores: np.ndarray, penalty: float) -> list[np.ndarray]:
    """Best labels of each text's words (rows of ``scores``, best 0); all texts advance word by word together.

    A text whose best single language lacks no more than one change costs keeps that language: no path can be better.
    """
    alone = np.array([scores[t].sum(0) for t in texts]).reshape(len(texts), -1)
    single = alone.max(1, initial=-np.inf) >= -penalty
    result = [np.full(len(t), a.argmax() if s else 0, np.int16) for t, a, s in zip(texts, alone, single, strict=True)]
    order = sorted(np.flatnonzero(~single).tolist(), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in order])
    longest = int(sizes.max(initial=0))
    active = np.searchsorted(-sizes, -np.arange(1, longest + 1), "right")  # texts with a word at each step
    starts = np.cumsum(sizes) - sizes
    flat = np.concatenate([texts[i] for i in order]) if longest else np.empty(0, np.int64)
    value = np.zeros((len(order), scores.shape[1]))
    back = []
    for t in range(longest):
        k = active[t]
        v = value[:k]
        best = v.argmax(1)
        moved = v[np.arange(k), best][:, None] - penalty
        stay = v >= moved
        back.append(np.where(stay, np.arange(scores.shape[1], dtype=np.int16), best.astype(np.int16)[:, None]))
        value[:k] = np.where(stay, v, moved) + scores[flat[starts[:k] + t]]
    label, out = value.argmax(1), np.empty(len(flat), np.int16)
    for t in range(longest - 1, -1, -1):
        k = active[t]
        out[starts[:k] + t] = label[:k]
        label[:k] = back[t][np.arange(k), label[:k]]
    for place, i in enumerate(order):
        result[i] = out[starts[place] : starts[place] + sizes[place]]
    return result


def _spans(text: str, words: list[str], labels: np.ndarray, langs: list[str]) -> list[dict]:
    turns = np.flatnonzero(np.diff(labels)) + 1
    if not len(turns):
        return [{"start": 0, "end": len(text), "lang": langs[labels[0]]}]
    begins, at = [], 0
    for word in words:
        begins.append(text.index(word, at))  # only other characters lie between
        at = begins[-1] + len(word)
    cuts = [0, *(begins[t] for t in turns), len(text)]
    return [{"start": a, "end": b, "lang": langs[labels[t]]} for a, b, t in zip(cuts, cuts[1:], [0, *turns], strict=False)]


def predict(docs: DataFrame, model: LanguageModel, keep: list[str], penalty: float = PENALTY) -> DataFrame:
    """Columns ``keep``, lang_pred, score (share of letters in the language's spans) and the spans."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col("text").cast("string").alias("text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = sent.value
        words = Words(learned)
        for batch in slices(batches, "text", BATCH_BYTES):
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            if not learned.langs:
                found = [(UNKNOWN, 0.0, [])] * len(texts)
            else:
                cut = [words_of(t) for t in texts]
                rows_of = [np.fromiter(map(words.__getitem__, c), np.int64, len(c)) for c in cut]
                labels = viterbi(rows_of, words.scores(), penalty)
                found = []
                for text, c, own in zip(texts, cut, labels, strict=True):
                    if not c:
                        found.append((UNKNOWN, 0.0, []))
                        continue
                    letters = np.bincount(own, np.fromiter(map(len, c), np.int64, len(c)), len(learned.langs))
                    top = int(letters.argmax())
                    found.append((learned.langs[top], float(letters[top] / letters.sum()), _spans(text, c, own, learned.langs)))
            yield pa.RecordBatch.from_arrays([
                *batch.columns[: len(keep)], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], _SPANS),
            ], names=[*keep, "lang_pred", "score", "spans"])
            if len(words) > WORDS_KEPT:
                words = Words(learned)

    return rows.mapInArrow(run, f"{kept}, {SCHEMA}")
