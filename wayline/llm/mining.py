"""Hard negatives by threshold joins on vectors, exact in their results.

Rows become index blocks. A block orders the dimensions by their weight in it; of each row only the leading dimensions are indexed,
those after which the norms that remain could still lift some anchor's product to the threshold. A join adds up partial products over
the indexed dimensions in steps, drops the pairs whose partial product plus the product of the remaining norms stays under the
anchor's threshold (or, less it, over all its windows), and computes the exact product of what is left.

A *window* is a range of scores of which the ``k`` highest rows are wanted: for an anchor's positives, all rows of its label; for the
negatives of one positive, the rows of other labels between ``low`` and ``high`` hundredths of its score. A threshold starts high and
is lowered until the windows are full; the k-th score in a full window is the threshold for all later blocks of the task, and
nothing under a window's lower end is ever looked at. Each task returns what its windows hold, and these are ranked.

Rows with a null id, label or vector, or with a null or non-finite component, take no part. Rows equal in id, label and vector are one;
a row is never a partner of its own id. Missing components of the shorter vector count as 0. Ties go to the smaller id. An anchor
without positives, and a positive without negatives in its window, give no rows; so do empty tables. Other columns are not read.
Products must fit 64 bits. Anchors are a stated query set and are asked in blocks of at most about ``ANCHOR_BYTES``, two scans each.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.llm.common import staged
from wayline.session import scratch_folder

BLOCK_VECTORS, BLOCK_BYTES, ANCHOR_BYTES = 4_096, 4 << 20, 8 << 20
LINE = 512  # anchors that meet a block together
STEP = 8  # dimensions between two looks at the remaining norms
SPARSE = 0.1  # share of pairs left at which they are followed one by one
FRACTIONS = (0.9, 0.75, 0.6, 0.45, 0.3, 0.2, 0.1, 0.0)  # thresholds tried on the way down
INDEX = "ids array<bigint>, labels array<bigint>, dims array<int>, v binary"
OUT = "anchor int, slot int, vec_id bigint, score bigint"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding): rows that take part, with components as doubles."""
    e = F.col("embedding")
    whole = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vectors.filter(whole).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), e.cast("array<double>").alias("embedding"))


def scaled(vectors: DataFrame, factor: int = 256) -> DataFrame:
    """(vec_id, label, v): usable rows once each, with whole components floor(factor * x)."""
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(factor)) * x).cast("bigint"))
    return usable(vectors).select("vec_id", "label", whole.alias("v")).distinct()


def _rows(batch: pa.RecordBatch, width: int, at: np.ndarray) -> np.ndarray:
    column = batch.column(2)
    return pc.list_flatten(column.take(pa.array(at))).to_numpy(zero_copy_only=False).astype("<i8").reshape(len(at), width)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one length in blocks of bounded size."""
    held: dict[int, list[tuple]] = {}

    def block(width: int) -> pa.RecordBatch:
        ids, labels, v = (np.concatenate(part) for part in zip(*held.pop(width), strict=True))
        dims = np.argsort(-(v.astype(float) ** 2).sum(axis=0), kind="stable")
        line = lambda values, kind: pa.array([values], pa.list_(kind))
        return pa.RecordBatch.from_arrays([line(ids, pa.int64()), line(labels, pa.int64()), line(dims, pa.int32()), pa.array([np.ascontiguousarray(v[:, dims]).tobytes()], pa.binary())], names=["ids", "labels", "dims", "v"])

    for batch in batches:
        widths = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
        for width in np.unique(widths).tolist():
            most = max(1, min(BLOCK_VECTORS, BLOCK_BYTES // (8 * max(1, width))))
            at = np.flatnonzero(widths == width)
            while len(at):
                room = most - sum(len(p[0]) for p in held.get(width, []))
                part, at = at[:room], at[room:]
                held.setdefault(width, []).append((batch.column(0).to_numpy()[part], batch.column(1).to_numpy()[part], _rows(batch, width, part)))
                if len(part) == room:
                    yield block(width)
    for width in list(held):
        yield block(width)


def suffix_norms(v: np.ndarray) -> np.ndarray:
    """Norm of what follows each leading part of a row, down to 0; one column more than ``v``."""
    squares = np.cumsum((v * v)[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.concatenate((squares, np.zeros((len(v), 1))), axis=1))


def join(x: np.ndarray, y: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, product) of all pairs whose product is between ``least`` and ``most`` of the row of x.

    Both hold whole numbers, in the same order of dimensions.
    """
    none = np.empty(0, np.int64)
    if not len(x) or not len(y):
        return none, none, none
    xf, yf, width = x.astype(float), y.astype(float), x.shape[1]
    xs, ys = suffix_norms(xf), suffix_norms(yf)
    slack = 1.0 + 1e-9 * xs[:, 0].max() * ys[:, 0].max()  # rounding of norms and sums
    low, high = least - slack, most + slack
    # the index: a row's dimensions up to where what remains of it cannot reach the least threshold with any anchor
    depth = np.minimum((ys * xs.max(axis=0)[None, :] >= low.min()).sum(axis=1), width)
    reach = ys[:, 0] * xs[:, 0].max() >= low.min()
    order = np.argsort(-depth, kind="stable")
    order = order[reach[order]]
    yf, ys, depth = yf[order], ys[order], depth[order]
    kept = np.minimum(-(-depth // STEP) * STEP, width)  # whole steps are indexed
    part = np.zeros((len(x), len(order)))
    at = 0
    while True:
        live = int(np.searchsorted(-depth, -at, side="left"))  # rows with dimensions from here on in the index
        if at >= width or not live:
            break
        to = min(at + STEP, width)
        part[:, :live] += xf[:, at:to] @ yf[:live, at:to].T
        at = to
        where = np.minimum(kept, at)
        rest = xs[:, where] * ys[np.arange(len(order)), where][None, :]
        alive = (part + rest >= low[:, None]) & (part - rest <= high[:, None])
        if alive.sum() <= SPARSE * alive.size:
            break
    where = np.minimum(kept, at)
    rest = xs[:, where] * ys[np.arange(len(order)), where][None, :]
    a, b = np.nonzero((part + rest >= low[:, None]) & (part - rest <= high[:, None]))
    sums, reached = part[a, b], where[b]
    at = int(reached.min(initial=width))
    while len(a) and at < width:  # what is left goes on pair by pair, into the dimensions that the index leaves out
        to = min(at + STEP, width)
        open_ = reached == at
        sums[open_] += np.einsum("ij,ij->i", xf[a[open_], at:to], yf[b[open_], at:to])
        reached[open_] = to
        rest = xs[a, reached] * ys[b, reached]
        stay = (sums + rest >= low[a]) & (sums - rest <= high[a])
        a, b, sums, reached, at = a[stay], b[stay], sums[stay], reached[stay], to
    b = order[b]
    exact = np.concatenate([np.einsum("ij,ij->i", x[a[i : i + 65_536]], y[b[i : i + 65_536]]) for i in range(0, len(a), 65_536)]) if len(a) else none
    fits = (exact >= least[a]) & (exact <= most[a])
    return a[fits], b[fits], exact[fits]


class Windows:
    """Windows of a block of anchors: ``anchor[i]`` asks for the ``k`` highest rows with a score from ``low[i]`` to ``high[i]``."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: list[np.ndarray], anchor: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool):
        self.ids, self.labels, self.k, self.same = ids, labels, k, same
        self.anchor, self.low, self.high = anchor, low.astype(float), high.astype(float)
        self.top = np.full(len(ids), -np.inf)
        np.maximum.at(self.top, anchor, self.high)
        self.lowest_high = np.full(len(ids), np.inf)
        np.minimum.at(self.lowest_high, anchor, self.high)
        widths = np.array([len(v) for v in vectors], np.int64)
        asking = np.unique(anchor)
        self.lines = [(w, asking[widths[asking] == w], np.array([vectors[i] for i in asking[widths[asking] == w]], np.int64).reshape(int((widths[asking] == w).sum()), w)) for w in np.unique(widths[asking]).tolist()]
        none = np.empty(0, np.int64)
        self.held = none, none, none  # window, id, score; best first in each window
        self.first = np.searchsorted(anchor, np.arange(len(ids) + 1))  # anchors are in order
        self.tried = np.full(len(ids), np.inf)  # threshold of each anchor that the last block came down to

    def thresholds(self) -> np.ndarray:
        """Per anchor: what lies under it cannot enter any of its windows."""
        window, _, score = self.held
        least = self.low.copy()
        counts = np.bincount(window, minlength=len(least))
        full = np.flatnonzero(counts >= self.k)
        ends = np.cumsum(counts)
        least[full] = np.maximum(least[full], score[ends[full] - 1])
        out = np.full(len(self.ids), np.inf)
        np.minimum.at(out, self.anchor, least)
        return out

    def add(self, anchor: np.ndarray, found: np.ndarray, score: np.ndarray) -> None:
        """Puts rows into the windows of their anchor that hold their score, and keeps the best ``k`` of each."""
        many = self.first[anchor + 1] - self.first[anchor]
        pair = np.repeat(np.arange(len(anchor)), many)
        window = self.first[anchor][pair] + np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many)
        inside = (score[pair] >= self.low[window]) & (score[pair] <= self.high[window])
        window, pair = window[inside], pair[inside]
        parts = [np.concatenate(p) for p in zip(self.held, (window, found[pair], score[pair]), strict=True)]
        order = np.lexsort((parts[1], -parts[2], parts[0]))
        window, found, score = (p[order] for p in parts)
        rank = np.arange(len(window)) - np.searchsorted(window, window)
        self.held = tuple(p[rank < self.k] for p in (window, found, score))

    def read(self, ids: np.ndarray, labels: np.ndarray, dims: np.ndarray, v: np.ndarray) -> None:
        for width, anchors, vectors in self.lines:
            shared = dims[dims < width]  # missing components are 0
            x, y = vectors[:, shared], v[:, dims < width]
            groups = [(np.flatnonzero(self.labels[anchors] == z), np.flatnonzero(labels == z)) for z in np.unique(labels)] if self.same else [(np.arange(len(anchors)), np.arange(len(labels)))]
            for mine, theirs in groups:
                for at in range(0, len(mine), LINE):
                    line = mine[at : at + LINE]
                    self._fill(anchors[line], x[line], ids[theirs], labels[theirs], y[theirs])

    def _fill(self, anchors: np.ndarray, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, y: np.ndarray) -> None:
        """One block: thresholds are lowered until what is under them cannot enter a window."""
        if not len(ids):
            return
        longest = np.sqrt((y.astype(float) ** 2).sum(axis=1).max(initial=0.0))
        start = np.minimum(np.sqrt((x.astype(float) ** 2).sum(axis=1)) * longest, self.lowest_high[anchors])
        ladder = np.where(start[:, None] > 0, start[:, None] * np.array(FRACTIONS), -np.inf)
        aim, above = np.minimum(self.tried[anchors], ladder[:, 0]), np.full(len(anchors), np.inf)  # scores from ``above`` on are held already
        left = np.arange(len(anchors))
        while len(left):
            least = np.maximum(self.thresholds()[anchors[left]], aim[left])
            a, b, score = join(x[left], y, least, self.top[anchors[left]])
            a = left[a]
            whole = anchors[a]
            fresh = (score < above[a]) & (ids[b] != self.ids[whole])
            if not self.same:
                fresh &= labels[b] != self.labels[whole]
            self.add(whole[fresh], ids[b[fresh]], score[fresh])
            above[left], self.tried[anchors[left]] = least, least
            left = left[least > self.thresholds()[anchors[left]]]
            aim[left] = np.where(ladder[left] < above[left][:, None], ladder[left], -np.inf).max(axis=1)

    def answer(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels, dims = (batch.column(n)[i].values.to_numpy() for n in ("ids", "labels", "dims"))
                self.read(ids, labels, dims, np.frombuffer(batch.column("v")[i].as_buffer(), "<i8").reshape(len(ids), len(dims)))
        window, found, score = self.held
        anchor = self.anchor[window]
        yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int32()), pa.array(window - self.first[anchor], pa.int32()), pa.array(found), pa.array(score)], names=["anchor", "slot", "vec_id", "score"])


def _best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    best = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors_every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over ``rows`` (vec_id, label, v) of whole vectors.

    Anchors are the rows whose id is divisible by ``anchors_every``; an anchor's positives are the ``positives`` other rows of its label with
    the highest product; to each belong the ``negatives`` highest rows of other labels with low * positive <= 100 * negative <= high * positive.
    """
    spark = rows.sparkSession
    rows = staged(rows)
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    asked = rows.filter(F.col("vec_id") % anchors_every == 0)
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    if not size["n"]:
        return spark.createDataFrame([], schema)
    index = staged(rows.select("vec_id", "label", "v").mapInArrow(_index, INDEX), block_bytes=BLOCK_BYTES)
    blocks = -(-size["n"] * 8 * max(1, size["width"]) // ANCHOR_BYTES)
    folder, mined = f"{scratch_folder(spark).rstrip('/')}/mining-{uuid.uuid4().hex}", False

    def ask(windows: Windows, name: str) -> DataFrame:
        sent = spark.sparkContext.broadcast(windows)
        index.mapInArrow(lambda batches: sent.value.answer(batches), OUT).write.parquet(f"{folder}/{name}")
        return spark.read.schema(OUT).parquet(f"{folder}/{name}")

    for block in range(blocks):
        some = asked.filter(F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(blocks)) == block).orderBy("vec_id", "label").toArrow()  # about ANCHOR_BYTES
        if not some.num_rows:
            continue
        ids, labels = some["vec_id"].to_numpy(), some["label"].to_numpy()
        vectors = [np.array(v, np.int64) for v in some["v"].to_pylist()]
        each = np.arange(len(ids))
        near = Windows(ids, labels, vectors, each, np.full(len(ids), -np.inf), np.full(len(ids), np.inf), positives, same=True)
        found = _best(ask(near, f"positives/block={block}"), ["anchor"], positives).orderBy("anchor", "rank").toArrow()  # positives of the block's anchors
        anchor, score = found["anchor"].to_numpy().astype(np.int64), found["score"].to_numpy()
        if not len(anchor):
            continue
        mined = True
        lows, highs = -(-low * score // 100), high * score // 100
        ask(Windows(ids, labels, vectors, anchor, lows, highs, negatives, same=False), f"negatives/block={block}")
        named = pa.table({"anchor": found["anchor"], "slot": pc.subtract(found["rank"], 1).cast(pa.int32()), "anchor_id": pa.array(ids[anchor]), "positive_id": found["vec_id"], "positive_score": found["score"]})
        spark.createDataFrame(named).write.parquet(f"{folder}/names/block={block}")
    if not mined:
        return spark.createDataFrame([], schema)
    names = spark.read.schema("anchor int, slot int, anchor_id bigint, positive_id bigint, positive_score bigint, block int").parquet(f"{folder}/names")
    held = spark.read.schema(f"{OUT}, block int").parquet(f"{folder}/negatives")
    best = _best(held, ["block", "anchor", "slot"], negatives).join(names, ["block", "anchor", "slot"])
    return best.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
