"""N-gram Jaccard join: a size-aware heavy-light join over word-shingle sets, and its connected components.

1. Equal sets are one set from here on. Shingles have a fixed order (their hash). Of the first ``absent + spare`` shingles of two
   linked sets (``absent``: how many a set may lack) at least the smaller one's ``spare`` are common; sets that share fewer
   with any others are alone and leave.
2. Of the others every shingle is counted, and sets that share too few of their shingles leave. Shingles are ordered rare
   first. A light set (at most ``boundary`` shingles) lists the 2-subsets of its prefix: a light partner must list one of them
   too. A heavy set, and each light set near the boundary, lists its prefix shingles singly in inverted lists. The boundary is
   the size that makes the two costs smallest together.
3. Sets that meet in a list form groups. A group beyond ``block_shingles`` is cut into bands of sizes, of which only neighbours can
   link, and these into blocks; two blocks of a band or of neighbouring bands meet in a task of their own. A meeting scans inverted
   lists of all its shared shingles, so every pair of a group is counted exactly, yet pairs are never written: a meeting
   returns the number of links of each set, and of the links a forest of at most one per set.
4. Links of all meetings give the components; their numbers add up, weighted by the rows of equal sets.

Sets are compared by 64-bit shingle hashes. Null and empty texts have no shingles and stay alone. Repeated rows share their
set. Null doc_ids take part and carry no number into a component. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import discard, slices, staged
from wayline.llm.components import component_roots
from wayline.llm.shingles import WORDS, mixed, shingle_sets

THRESHOLD = 85  # per cent
SPARE_SHARE = 0.1  # of a set's shingles, beyond what it may lack, in step 1
BLOCK_SHINGLES = 1_000_000  # of a block in step 3
ROW_COST = 50.0  # of a row that is listed, shuffled and joined, in list entries that a scan passes


def absent(n, threshold: int):
    """How many of its n shingles a set may lack in a partner (plain numbers or arrays)."""
    return n - -(-n * threshold // 100)


def absent_column(n: Column, threshold: int) -> Column:
    return n - F.ceil(n * F.lit(threshold) / F.lit(100)).cast("int")


def set_number(s: np.ndarray) -> int:
    """64-bit number of a set of shingles."""
    if not len(s):
        return 0
    both = np.array([s.sum(dtype=np.uint64), np.bitwise_xor.reduce(s)], np.uint64)
    return int(mixed(mixed(both[:1]) + both[1:] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(len(s)))[0].view(np.int64))


def _signatures(words: int, threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column(2).to_pylist(), words)
            heads = [s[: absent(len(s), threshold) + max(1, int(len(s) * SPARE_SHARE))].view(np.int64) for s in sets]
            offsets = np.cumsum([0, *map(len, heads)]).astype(np.int32)
            flat = np.concatenate(heads) if heads else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_number(s) for s in sets], pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
            ], names=["doc_id", "text_number", "n_shingles", "node", "head"])

    return run


def _full_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column(0).to_pylist(), words)
            offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([set_number(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["node", "tokens"])

    return run


def _sharing(signatures: DataFrame, threshold: int) -> DataFrame:
    """(text_number) of one text of each set that passes step 1."""
    sets = signatures.filter("n_shingles > 0")
    # dealt once: counting and joining read the same shuffle
    lists = sets.select("node", F.explode("head").alias("token")).repartition("token")
    shared = lists.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi").select("token")
    counted = lists.join(shared, "token").distinct().groupBy("node").agg(F.count("*").alias("shared"))
    one = sets.groupBy("node").agg(F.min("text_number").alias("text_number"), F.first("n_shingles").alias("n"))
    # the smallest possible partner lists the fewest spare shingles, and no more than those need to be seen as shared
    least = F.ceil(F.col("n") * F.lit(threshold) / F.lit(100))
    spare = F.greatest(F.lit(1), F.floor(least * SPARE_SHARE))
    return one.join(counted, "node").filter(F.col("shared") >= spare).select("text_number")


def _ordered(sets: DataFrame, threshold: int) -> DataFrame:
    """(node, n, rare, tokens): shingles that other sets have too, rare first, of sets that share enough; ``rare``: how many are their own."""
    lists = sets.select("node", F.size("tokens").alias("n"), F.explode("tokens").alias("token")).repartition("token")
    df = lists.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    kept = lists.join(df, "token").groupBy("node").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "token"))).alias("tokens"))
    return kept.withColumn("rare", F.col("n") - F.size("tokens")).filter(F.col("rare") <= absent_column(F.col("n"), threshold))


def _prefix(spare: int, threshold: int) -> Column:
    """Shared shingles among the first absent + spare ones; a set's own shingles come first."""
    return F.slice("tokens", 1, F.greatest(F.lit(0), absent_column(F.col("n"), threshold) + spare - F.col("rare")))


def boundary(ordered: DataFrame, threshold: int) -> int:
    """Largest light size: where subsets of lighter sets, and lists of heavier ones with the scans they cause, cost least together.

    A subset is a row to shuffle and to join, as is a place in a list; an entry passed in a scan costs far less. What subsets save is
    scanning partners that have one shingle of the prefix in common and no second: those that its most frequent shingle brings beyond
    the next one; sets of a group of near copies, or with a passage in common, meet and are scanned either way. The costs are summed by size class, a table of at most some hundred rows whatever the input.
    """
    pairs = F.size(_prefix(2, threshold)).cast("double")
    one = _prefix(1, threshold)
    brought = lambda place: F.coalesce(F.try_element_at(one, F.lit(place))["df"], F.lit(0))
    scan = F.size(one) * F.lit(ROW_COST) + (brought(-1) - brought(-2)).cast("double")
    size_class = F.floor(F.log2("n") * 8).cast("int").alias("k")
    costs = ordered.groupBy(size_class).agg(F.max("n").alias("n"), F.sum(pairs * (pairs - 1) / 2 * F.lit(ROW_COST)).alias("subsets"), F.sum(scan).alias("lists")).orderBy("k").collect()
    best, at, light = sum(r["lists"] for r in costs), 0, 0.0
    for i, r in enumerate(costs):
        light += r["subsets"]
        cost = light + sum(x["lists"] for x in costs[i + 1 :])
        if cost < best:
            best, at = cost, int(r["n"])
    return at


def meeting_keys(ordered: DataFrame, light: int, threshold: int) -> DataFrame:
    """(node, key): two sets that link have a key in common."""
    two, one = _prefix(2, threshold), _prefix(1, threshold)
    subsets = F.flatten(F.transform(two, lambda a, i: F.transform(F.slice(two, i + 2, F.size(two)), lambda b: F.xxhash64(a["token"], b["token"]))))
    small = ordered.filter(F.col("n") <= light).select("node", F.explode(subsets).alias("key"))
    near = ordered.filter(F.col("n") * 100 >= F.lit(light * threshold)).select("node", "n", F.explode(F.transform(one, lambda a: a["token"])).alias("key"))
    heavy = near.filter(F.col("n") > light).select("key").distinct()  # lists that hold a heavy set
    return small.union(near.select("node", "key").join(heavy, "key").select("node", "key"))


def forest(sizes: np.ndarray, ends: np.ndarray, tokens: np.ndarray, copies: np.ndarray, n_left: int, both: bool, threshold: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that join what no earlier one joined, and the rows that each set links with, by one scan of inverted lists per set.

    ``tokens`` holds the sets' shared shingles in a row up to ``ends``; ``sizes`` counts all shingles, ``copies`` the rows of a set. The
    first ``n_left`` sets are compared with each other, or with ``both`` against the remaining ones.
    """
    n, starts = len(sizes), np.concatenate(([0], ends[:-1])).astype(np.int64)
    _, ranks = np.unique(tokens, return_inverse=True)
    owner = np.repeat(np.arange(n), ends - starts)
    listed = owner >= n_left if both else np.ones(len(owner), bool)
    order = np.argsort(ranks[listed], kind="stable")
    lists = owner[listed][order]
    bounds = np.concatenate(([0], np.cumsum(np.bincount(ranks[listed], minlength=int(ranks.max(initial=0)) + 1))))
    root, links, counts = np.arange(n), [], np.zeros(n, np.int64)
    for i in range(n_left):
        own = ranks[starts[i] : ends[i]]
        spans = [lists[a:b] for a, b in zip(bounds[own], bounds[own + 1], strict=True)]
        met = np.concatenate(spans) if spans else np.empty(0, np.int64)
        if 8 * len(met) < n:  # few of many sets
            others, common = np.unique(met, return_counts=True)
        else:
            common = np.bincount(met, minlength=n)
            others = np.flatnonzero(common)
            common = common[others]
        near = others[100 * common >= threshold * (sizes[others] + sizes[i] - common)]
        if not both:
            near = near[near > i]
        counts[i] += copies[near].sum()
        counts[near] += copies[i]
        new, first = np.unique(root[near], return_index=True)
        apart = new != root[i]
        if apart.any():
            links += [(i, int(j)) for j in near[first[apart]]]
            root[np.isin(root, new[apart])] = root[i]
    return links, counts


def _meet(threshold: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("side", "ascending"), ("node", "ascending")]).combine_chunks()
        nodes, sizes, sides, copies = (table[c].to_numpy() for c in ("node", "n", "side", "copies"))
        column = table["tokens"].combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        offsets = column.offsets.to_numpy()
        tokens, ends = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]
        both = table["x"][0] != table["y"][0]
        found, counts = forest(sizes.astype(np.int64), ends.astype(np.int64), tokens, copies, int((sides == 0).sum()), both, threshold)
        linked = np.flatnonzero(counts)
        none, some = pa.nulls(len(found), pa.int64()), pa.nulls(len(linked), pa.int64())
        a = pa.concat_arrays([pa.array([nodes[i] for i, _ in found], pa.int64()), pa.array(nodes[linked], pa.int64())])
        return pa.table({"a": a, "b": pa.concat_arrays([pa.array([nodes[j] for _, j in found], pa.int64()), some]), "links": pa.concat_arrays([none, pa.array(counts[linked], pa.int64())])})

    return run


def _meetings(members: DataFrame, threshold: int, block_shingles: int) -> DataFrame:
    """Members with the blocks (x, y) that meet; ``side`` tells theirs. Groups of one block meet once, as they are."""
    size = F.sum(F.size("tokens"))
    whole = members.groupBy("root").agg((size > block_shingles).alias("large"))
    # sets that link are at most one band apart; the width leaves room for rounding
    band = F.when(F.col("large"), F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / threshold) * (1 + 1e-9)))).otherwise(F.lit(0)).cast("int")
    banded = members.join(whole, "root").withColumn("band", band)
    bands = banded.groupBy("root", "band").agg(F.greatest(F.lit(1), F.ceil(size / block_shingles)).cast("int").alias("blocks"))
    near = bands.select("root", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), F.col("band").alias("their_band"), F.col("blocks").alias("their_blocks"))
    partners = near.groupBy("root", "band").agg(F.collect_list(F.struct("their_band", "their_blocks")).alias("partners"))  # three at most
    placed = banded.join(bands, ["root", "band"]).join(partners, ["root", "band"]).withColumn("own", F.struct("band", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")))
    theirs = F.flatten(F.transform("partners", lambda p: F.transform(F.sequence(F.lit(0), p["their_blocks"] - 1), lambda i: F.struct(p["their_band"].alias("band"), i.alias("block")))))
    placed = placed.withColumn("other", F.explode(theirs))
    return placed.select("root", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "n", "copies", "tokens")


def links(sets: DataFrame, threshold: int = THRESHOLD, block_shingles: int = BLOCK_SHINGLES, light: int | None = None) -> DataFrame:
    """Over sets (node, copies, tokens): links (a, b) that join all sets of a component, and rows (a, null, links) whose numbers of links add up; steps 2 and 3."""
    ordered = staged(_ordered(sets, threshold))
    keys = staged(meeting_keys(ordered, boundary(ordered, threshold) if light is None else light, threshold).distinct())
    hubs = keys.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("members")).filter("members > 1").select("key", "hub")
    groups = component_roots(keys.join(hubs, "key").select(F.col("hub").alias("a"), F.col("node").alias("b")))
    copies = sets.select("node", "copies")
    members = staged(groups.join(ordered, "node").join(copies, "node").select("root", "node", "n", "copies", F.transform("tokens", lambda t: t["token"]).alias("tokens")))
    discard(keys, ordered)
    met = _meetings(members, threshold, block_shingles).groupBy("root", "x", "y")
    found = staged(met.applyInArrow(_meet(threshold), "a bigint, b bigint, links bigint"))
    discard(members)
    return found


def grouped(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, text_number, n_shingles, place, n_links) for every row: rows with one place are linked; null without shingles."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_number"), F.col("text").cast("string").alias("text"))
    schema = "doc_id bigint, text_number bigint, n_shingles bigint, node bigint, head array<bigint>"
    signatures = staged(rows.mapInArrow(_signatures(words, threshold), schema), "uncompressed")
    # the texts of the sets that may have partners; their list grows with the corpus, so it is never broadcast
    chosen = staged(_sharing(signatures, threshold).distinct())
    texts = rows.join(chosen.hint("merge"), "text_number").select("text")
    rows_of_sets = signatures.filter("n_shingles > 0").groupBy("node").agg(F.count("*").alias("copies"))
    sets = texts.mapInArrow(_full_sets(words), "node bigint, tokens array<bigint>").groupBy("node").agg(F.first("tokens").alias("tokens"))
    sets = staged(sets.join(rows_of_sets, "node"), "uncompressed")
    found = links(sets, threshold)
    discard(chosen, sets)
    roots = component_roots(found.filter("b IS NOT NULL").select("a", "b"))
    counts = found.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    of_sets = rows_of_sets.join(roots, "node", "left").join(counts, "node", "left")
    known = signatures.select("doc_id", "text_number", "n_shingles", "node").join(of_sets, "node", "left")
    n_links = F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))
    return known.select("doc_id", "text_number", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("root", "node")).alias("place"), n_links.alias("n_links"))


def components(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for every row of (doc_id, text); ``n_links`` counts the other rows that it links with."""
    placed = grouped(docs, words, threshold)
    # staged, so that the join below has its own shuffle, whose large partitions Spark can split
    smallest = staged(placed.filter("place IS NOT NULL").groupBy("place").agg(F.min("doc_id").alias("first")))
    return placed.join(smallest, "place", "left").select("doc_id", "n_shingles", F.coalesce("first", "doc_id").alias("component_id"), "n_links")


def one_of_each(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id (null last). Rows without shingles stay."""
    placed = grouped(docs, words, threshold)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_number")
    best = placed.filter("place IS NOT NULL").groupBy("place").agg(F.min(rank).alias("best"), F.count("*").alias("rows"))
    # where a component is one row nothing has to be compared; the other rows that stay are listed
    listed = staged(placed.join(best, "place", "left").filter("rows > 1").select("doc_id", "text_number", (rank == F.col("best")).alias("stays")))
    verdicts = listed.groupBy("doc_id", "text_number").agg(F.max("stays").alias("stays"), F.count("*").alias("copies"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_number"))
    joined = rows.alias("r").join(verdicts.alias("v"), F.col("r.doc_id").eqNullSafe(F.col("v.doc_id")) & (F.col("r.text_number") == F.col("v.text_number")), "left")
    kept = joined.filter(F.coalesce("stays", F.lit(True))).select("row", "r.doc_id", "r.text_number", F.coalesce("copies", F.lit(1)).alias("copies"))
    single = kept.filter("copies = 1").select("row.*")
    repeated = kept.filter("copies > 1").dropDuplicates(["doc_id", "text_number"]).select("row.*")
    return single.unionByName(repeated)
