"""Snapshots that are measured while they are written, switched only if they hold, and rebuilt only where their inputs changed."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from wayline.session import cut_lineage
from wayline.streaming.upserts import Folder


@dataclass(frozen=True)
class Floor:
    """Least value of a metric: a number, or a share of what the snapshot now shown has."""
    metric: Column
    least: float | None = None
    share: float | None = None


@dataclass(frozen=True)
class Outcome:
    published: bool
    metrics: dict[str, float]
    failures: list[str] = field(default_factory=list)


def required_feeds(feeds: Sequence[str], column: str = "feed") -> dict[str, Floor]:
    """A floor of one row for every feed that a build may not lose."""
    return {f"feed {f}": Floor(F.count_if(F.col(column) == f), least=1) for f in feeds}


class Snapshots:
    """Snapshots of one table under ``path``; readers see the last one that was published, a failed one is never shown.

    Metrics are observed in the job that writes the rows, so nothing is read twice; ``keep`` older snapshots stay for readers.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        self.folder = Folder(spark, path)

    def _last(self) -> dict | None:
        names = self.folder.names("manifests")
        return json.loads(self.folder.read(f"manifests/{names[-1]}")) if names else None

    def publish(self, rows: DataFrame, floors: Mapping[str, Floor]) -> Outcome:
        last, name, seen = self._last(), f"snapshot-{uuid.uuid4().hex}", Observation()
        # an aggregate over no rows is null
        measured = [F.coalesce(f.metric.cast("double"), F.lit(0.0)).alias(n) for n, f in floors.items()]
        rows.observe(seen, F.count(F.lit(1)).alias("rows"), *measured).write.parquet(f"{self.path}/rows/{name}")
        metrics = {k: float(v) for k, v in seen.get.items()}
        before = last["metrics"] if last else {}
        failures = []
        for n, f in floors.items():
            least = max(f.least or 0.0, (f.share or 0.0) * before.get(n, 0.0))
            if metrics[n] < least:
                failures.append(f"{n}: {metrics[n]:g} of at least {least:g}")
        if failures:
            self.folder.delete(f"rows/{name}")
            return Outcome(False, metrics, failures)
        version = last["version"] + 1 if last else 0
        self.folder.publish(f"manifests/{version:020d}.json", json.dumps({"version": version, "rows": name, "schema": rows.schema.json(), "metrics": metrics}))
        kept = self.folder.names("manifests")[-self.keep - 1 :]
        named = {json.loads(self.folder.read(f"manifests/{m}"))["rows"] for m in kept}
        for old in [m for m in self.folder.names("manifests") if m not in kept]:
            self.folder.delete(f"manifests/{old}")
        for old in [r for r in self.folder.names("rows") if r not in named]:
            self.folder.delete(f"rows/{old}")
        return Outcome(True, metrics)

    def current(self) -> DataFrame | None:
        """The snapshot now shown; null before the first one."""
        last = self._last()
        return self.spark.read.parquet(f"{self.path}/rows/{last['rows']}") if last else None


def input_fingerprints(inputs: Mapping[str, DataFrame], key: str) -> DataFrame:
    """(key, digest) over all rows of all inputs, whatever their order; one combinable aggregate per input, no row leaves it.

    Equal digests mean equal rows up to two independent 64-bit sums over the rows; rows without a key belong to no feed.
    """
    parts = []
    for name, rows in sorted(inputs.items()):
        columns = [F.col(f"`{c}`") for c in sorted(rows.columns)]
        text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
        first, second = F.xxhash64(F.lit(name), text), F.xxhash64(text, F.lit(name), F.lit(1))
        wide = "decimal(38,0)"
        parts.append(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(first.cast(wide)).alias("a"), F.sum(second.cast(wide)).alias("b")).withColumn("input", F.lit(name)))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    line = F.concat_ws(":", "input", "n", "a", "b")
    return every.groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "|"), 256).alias("digest"))  # a line per input


def rebuild(inputs: Mapping[str, DataFrame], key: str, build: Callable[[Mapping[str, DataFrame]], DataFrame], path: str) -> DataFrame:
    """Brings the table ``path``/rows, partitioned by ``key``, up to its inputs; returns (key, change): ``new``, ``changed`` or ``gone``.

    ``build`` gets the inputs of the keys to build, and its result for a key must depend on that key's rows alone. Partitions of other
    keys are neither read nor written. Fingerprints are written last: a build that fails is done again.
    """
    spark = next(iter(inputs.values())).sparkSession
    folder = Folder(spark, path)
    now = cut_lineage(input_fingerprints(inputs, key))  # a row per feed
    states = folder.names("fingerprints")
    before = spark.read.schema(now.schema).parquet(f"{path}/fingerprints/{states[-1]}") if states else now.where(F.lit(False))
    kind = F.when(F.col("old").isNull(), "new").when(F.col("digest").isNull(), "gone").otherwise("changed")
    moved = now.join(before.withColumnRenamed("digest", "old"), key, "full_outer").where(~F.col("old").eqNullSafe(F.col("digest"))).select(key, kind.alias("change"))
    moved = cut_lineage(moved)
    due = moved.where("change <> 'gone'").select(key)
    if due.limit(1).count():
        built = cut_lineage(build({n: rows.join(due, key, "left_semi") for n, rows in inputs.items()}))
        # a changed key may have no rows any more: its partition goes before the new ones come
        for r in moved.join(built.select(key).distinct(), key, "left_anti").toLocalIterator():
            folder.delete(f"rows/{key}={r[key]}")
        built.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(f"{path}/rows")
    else:
        for r in moved.toLocalIterator():
            folder.delete(f"rows/{key}={r[key]}")
    following = f"{int(states[-1][:20]) + 1 if states else 0:020d}-{uuid.uuid4().hex}"
    now.write.parquet(f"{path}/fingerprints/{following}")
    for old in states:
        folder.delete(f"fingerprints/{old}")
    return moved
