"""Approximate nearest neighbours by inner product: balanced posting lists under an in-memory graph of centroids.

Equal vectors are one entry with its smallest ids (no answer can hold more of them). Centroids are learned from a sample of at
most ``SAMPLE_VECTORS`` vectors; every vector is indexed: in the list of its nearest centroid and, at a boundary, in those of
further centroids that are nearly as near and not hidden behind one already chosen. A query walks the graph of centroids and
takes the lists whose distance is within a ratio of the nearest; the ratio is set on the sample so that the wanted share of true
neighbours lies in the lists taken. Long lists and long query lines are cut into parts that meet in tasks of their own.

For the largest inner product all vectors get one more component that brings them to one length, so that nearness to a
centroid is a distance. Scores are inner products of the original vectors in double precision.

Null or zero vectors, and those with null or non-finite components, take no part; nor do those without the most frequent
number of components. Null ids take no part. Repeated rows of one id count once (per vector). Fewer candidates than wanted give all.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.llm.common import staged

SAMPLE_VECTORS, LIST_VECTORS, MOST_CENTROIDS = 20_000, 200, 2_048
ROUNDS, BALANCE = 8, 0.15
COPIES, COPY_RATIO = 4, 1.06
GRAPH_NEAR, GRAPH_FAR = 24, 8
WANTED = 0.96
PART_VECTORS, PART_QUERIES = 4_096, 2_048
FIRST_LISTS = 4


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T)


def lifted(v: np.ndarray, length: float) -> np.ndarray:
    """One more component, so that all vectors have the same length."""
    return np.concatenate((v, np.sqrt(np.maximum(0.0, length**2 - (v * v).sum(1)))[:, None]), axis=1)


def level(q: np.ndarray, length: float) -> np.ndarray:
    """Queries at that length, with nothing in the added component."""
    return np.concatenate((q * (length / np.linalg.norm(q, axis=1))[:, None], np.zeros((len(q), 1))), axis=1)


def balanced_centroids(points: np.ndarray, k: int, seed: int = 5) -> np.ndarray:
    """Means of k clusters; a cluster's size adds to its distance, which keeps the lists alike."""
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), k, replace=False)].copy()
    sizes = np.full(k, len(points) / k)
    for _ in range(ROUNDS):
        d = np.sqrt(squared(points, centres))
        own = (d + BALANCE * d.mean() * (sizes / (len(points) / k) - 1.0).clip(-1, 4)[None, :] * 0.5).argmin(1)
        sizes = np.bincount(own, minlength=k).astype(np.float64)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        full = sizes > 0
        centres[full] = sums[full] / sizes[full, None]
        centres[~full] = points[rng.choice(len(points), int((~full).sum()))]
    return centres


class Centroids:
    """Centroids, the graph over them, the common length and the distance ratio of a search."""

    def __init__(self, centres: np.ndarray, length: float, seed: int = 5):
        self.centres, self.length, self.ratio = centres, length, 1.0
        self.sizes = np.zeros(len(centres), np.int64)
        between = squared(centres, centres)
        self.between = np.sqrt(between)
        near = np.argsort(between, axis=1, kind="stable")[:, 1 : GRAPH_NEAR + 1]
        rng = np.random.default_rng(seed)
        far = rng.integers(0, len(centres), (len(centres), GRAPH_FAR))
        self.edges = [np.unique(np.concatenate((a, b))) for a, b in zip(near, far, strict=True)]
        self.entries = np.unique(rng.integers(0, len(centres), 16))

    def lists_of(self, v: np.ndarray) -> list[list[int]]:
        """Posting lists of each vector, nearest first."""
        d = np.sqrt(squared(lifted(v, self.length), self.centres))
        nearest = np.argsort(d, axis=1, kind="stable")[:, : 4 * COPIES]
        out = []
        for row, order in zip(d, nearest, strict=True):
            taken = [int(order[0])]
            for c in order[1:]:
                if len(taken) == COPIES or row[c] > COPY_RATIO * row[order[0]]:
                    break
                if all(self.between[c, t] > row[c] for t in taken):
                    taken.append(int(c))
            out.append(taken)
        return out

    def search(self, q: np.ndarray, wanted: int) -> list[int]:
        """Lists within the ratio of the nearest, and further ones until they hold ``wanted`` vectors; walks the graph best first."""
        d = {int(e): float(np.linalg.norm(self.centres[e] - q)) for e in self.entries}
        queue = [(x, e) for e, x in d.items()]
        heapq.heapify(queue)
        taken, held, nearest = [], 0, min(d.values())
        while queue:
            x, at = heapq.heappop(queue)
            nearest = min(nearest, x)
            if x > self.ratio * nearest and held >= wanted and len(taken) >= 4:
                break
            taken.append((x, at))
            held += int(self.sizes[at])
            new = [int(e) for e in self.edges[at] if int(e) not in d]
            if new:
                gaps = self.centres[new] - q
                for e, y in zip(new, np.sqrt((gaps * gaps).sum(1)), strict=True):
                    d[e] = float(y)
                    heapq.heappush(queue, (float(y), e))
        limit, kept, held = self.ratio * nearest, [], 0
        for x, at in sorted(taken):
            if x > limit and held >= wanted:
                break
            kept.append(at)
            held += int(self.sizes[at])
        return kept


def learn(sample: np.ndarray, length: float, total: int, wanted: float = WANTED) -> Centroids:
    points = lifted(sample, length)
    k = int(min(MOST_CENTROIDS, max(1, len(points) // 8), max(1, -(-total // LIST_VECTORS))))
    index = Centroids(balanced_centroids(points, k), length)
    asked = sample[:: max(1, len(sample) // 256)]
    inner = asked @ sample.T
    true = np.argsort(-inner, axis=1, kind="stable")[:, 1:21]
    if true.size:
        places = index.lists_of(sample[true.ravel()])
        d = np.sqrt(squared(level(asked, length), index.centres))
        rows = np.repeat(np.arange(len(asked)), true.shape[1])
        need = [min(d[r, c] for c in lists) / d[r].min() for r, lists in zip(rows, places, strict=True)]
        index.ratio = float(np.quantile(need, wanted)) + 1e-9
    return index


def clean(table: DataFrame) -> DataFrame:
    """(vec_id, v, norm): usable vectors as little-endian doubles, once per id and vector."""
    e = F.col("embedding")
    whole = F.col("vec_id").isNotNull() & e.isNotNull() & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists(e, lambda x: x != 0)
    rows = table.filter(whole).select(F.col("vec_id").cast("bigint").alias("vec_id"), e.cast("array<double>").alias("embedding"))
    frequent = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1)
    rows = rows.join(F.broadcast(frequent.select("dim")), F.size("embedding") == F.col("dim")).drop("dim")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column(1).values.to_numpy(zero_copy_only=False)[batch.column(1).offsets[0].as_py() : batch.column(1).offsets[-1].as_py()].reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.astype("<f8").tobytes() for x in v], pa.binary()), pa.array(np.linalg.norm(v, axis=1))], names=["vec_id", "v", "norm"])

    return rows.mapInArrow(run, "vec_id bigint, v binary, norm double")


def _smallest_ids(keep: int):
    """Per batch at most ``keep`` ids of a vector: no answer of keep - 1 can hold more of equal vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[bytes, list[int]] = {}
            for key, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(v, []).append(key)
            rows = [(i, v) for v, ids in held.items() for i in sorted(set(ids))[:keep]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["vec_id", "v"])

    return run


def distinct_vectors(usable: DataFrame, keep: int) -> DataFrame:
    """(v, ids): each vector with its ``keep`` smallest ids."""
    few = usable.select("vec_id", "v").mapInArrow(_smallest_ids(keep), "vec_id bigint, v binary").distinct()
    ranked = few.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("r") <= keep)
    return ranked.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _matrix(column: pa.Array) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1) if raw else np.empty((0, 0))


def _best(keep: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names, q_all, asked, found, scores = ["query", "vec_id", "score"], _matrix(right["q"]), [], [], []
        v, ids, own, bounds = _matrix(left["v"]), left["ids"].to_pylist(), right["query"].to_pylist(), right["bound"].to_pylist()
        if len(v) and len(q_all):
            for i, line in enumerate(q_all @ v.T):
                least = -np.inf if len(line) <= keep else np.partition(line, -keep)[-keep]
                near = np.flatnonzero(line >= max(least, bounds[i]) - 1e-9)
                exact = (v[near] * q_all[i]).sum(1)
                pairs = sorted((-s, k) for s, n in zip(exact, near, strict=True) if s >= bounds[i] for k in ids[n])[:keep]
                asked += [own[i]] * len(pairs)
                scores += [-p[0] for p in pairs]
                found += [p[1] for p in pairs]
        return pa.table([pa.array(asked, pa.int64()), pa.array(found, pa.int64()), pa.array(scores, pa.float64())], names=names)

    return run


def nearest(vectors: DataFrame, queries_every: int = 20, k: int = 20, wanted: float = WANTED) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each vector whose id is divisible by ``queries_every``."""
    spark = vectors.sparkSession
    usable = staged(clean(vectors))
    entries = staged(distinct_vectors(usable, k + 1))
    total, length = entries.count(), usable.agg(F.max("norm")).first()[0] or 1.0
    sample = _matrix(pa.array(entries.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE_VECTORS).toPandas()["v"], pa.binary()))
    if not total:
        return usable.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    index = learn(sample, length, total, wanted)
    sent = spark.sparkContext.broadcast(index)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lists = sent.value.lists_of(_matrix(batch.column(0)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int32()))], names=["v", "ids", "lists"])

    postings = staged(entries.mapInArrow(post, "v binary, ids array<bigint>, lists array<int>"))
    index.sizes = np.zeros(len(index.centres), np.int64)
    for r in postings.groupBy(F.col("lists")[0].alias("list")).count().collect():  # one row per centroid at most
        index.sizes[r["list"]] = r["count"]
    sized = spark.sparkContext.broadcast(index)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                asked = level(_matrix(batch.column(1)), sized.value.length)
                lists = [sized.value.search(q, k + 1) for q in asked]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int32()))], names=["query", "q", "lists"])

    queries = usable.filter(F.col("vec_id") % queries_every == 0).select(F.col("vec_id").alias("query_id"), "v").distinct()
    lines = queries.groupBy("v").agg(F.min("query_id").alias("query")).select("query", F.col("v").alias("q"))
    listed = lines.mapInArrow(probe, "query bigint, q binary, lists array<int>")
    probes = staged(listed.select("query", "q", F.posexplode("lists").alias("place", "list")))
    posted = postings.select("v", "ids", F.explode("lists").alias("list"))
    parts = staged(posted.groupBy("list").agg(F.ceil(F.count("*") / PART_VECTORS).cast("int").alias("parts")))
    key = ["list", "part", "turn"]

    def best_of(asking: DataFrame) -> DataFrame:
        """The k + 1 best of each query in the lists it asks; long lists and query lines are cut into parts that meet one by one."""
        turns = asking.groupBy("list").agg(F.ceil(F.count("*") / PART_QUERIES).cast("int").alias("turns"))
        meet = F.broadcast(staged(parts.join(turns, "list")))  # one row per centroid at most
        left = posted.join(meet, "list").withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int")).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
        right = asking.join(meet, "list").withColumn("turn", F.pmod(F.xxhash64("query"), F.col("turns")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        met = left.select(*key, "v", "ids").groupBy(key).cogroup(right.select(*key, "query", "q", "bound").groupBy(key)).applyInArrow(_best(k + 1), "query bigint, vec_id bigint, score double")
        return met.groupBy("query", "vec_id").agg(F.max("score").alias("score")).withColumn("r", F.row_number().over(ranking)).filter(F.col("r") <= k + 1).drop("r")

    ranking = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    # the nearest lists give a bound; the others return only what reaches it
    nearest_lists = staged(best_of(probes.filter(F.col("place") < FIRST_LISTS).withColumn("bound", F.lit(float("-inf")))))
    bounds = nearest_lists.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("low"))
    bounds = bounds.select("query", F.when(F.col("n") > k, F.col("low")).otherwise(F.lit(float("-inf"))).alias("bound"))
    others = best_of(staged(probes.filter(F.col("place") >= FIRST_LISTS).join(bounds, "query")))
    top = nearest_lists.unionByName(others).dropDuplicates(["query", "vec_id"]).withColumn("r", F.row_number().over(ranking)).filter(F.col("r") <= k + 1).drop("r")
    asked = queries.join(lines, queries.v == lines.q).select("query_id", "query")
    answers = asked.join(top, "query").filter("query_id <> vec_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return answers.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
