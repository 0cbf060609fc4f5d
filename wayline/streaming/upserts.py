"""A table of the newest row per key that a stream keeps up to date, with compaction and an atomic switch.

Every micro-batch writes its newest row per key to a folder of its own and then publishes a manifest that names the base folder and
the deltas on top of it; a manifest appears whole or not at all, and readers take the last one. After ``compact_every`` deltas the step
merges base and deltas into a new base without the deleted keys, so a reader merges as many rows as there are live keys plus a bounded
number of micro-batches, however long the stream has run. Folders that no kept manifest names are deleted.

A micro-batch that Spark runs again is recognised by its query and number: once published it is left out; what an attempt that failed
left behind is never named and goes with the next clean-up. One writer at a time; a reader has to be done before ``keep`` further
micro-batches are published.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wayline.operators.ordered import last_wins

VERSION = "_version"


class Folder:
    """The few file operations that a manifest needs, in whatever file system the path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark.sparkContext._jvm, path.rstrip("/")
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str) -> Any:
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str) -> list[str]:
        if not self.fs.exists(self._path(folder)):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(folder)))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """``text`` under ``name``, whole or not at all; fails where the name is taken."""
        draft = self._path(f"drafts/{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self.fs.mkdirs(self._path(name).getParent())
        if self.fs.exists(self._path(name)) or not self.fs.rename(draft, self._path(name)):
            self.fs.delete(draft, False)
            raise RuntimeError(f"{name} was published by another writer")

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


class UpsertTable:
    """Newest row per ``keys`` by ``order``; rows whose ``deleted`` column is true take the key away.

    ``order`` may name ``_version``, the number of the publishing micro-batch: then a later micro-batch always wins. Without it a late
    row with a lower order changes nothing, and ``deleted`` must not be used, since a compacted table forgets deletions.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str], schema: str, deleted: str | None = None, compact_every: int = 8, keep: int = 3):
        if deleted and order[0] != VERSION:
            raise ValueError("deletions need an order that begins with _version")
        self.spark, self.path, self.keys, self.order, self.deleted = spark, path.rstrip("/"), list(keys), list(order), deleted
        self.compact_every, self.keep = compact_every, keep
        self.schema = f"{schema}, {VERSION} bigint"
        self.folder = Folder(spark, path)

    def _manifest(self) -> dict:
        names = self.folder.names("manifests")
        return json.loads(self.folder.read(f"manifests/{names[-1]}")) if names else {"version": -1, "base": None, "deltas": [], "seen": {}}

    def _rows(self, names: Sequence[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/rows/{n}" for n in names])

    def _merged(self, manifest: dict) -> DataFrame:
        parts = [manifest["base"]] if manifest["base"] else []
        return last_wins(self._rows([*parts, *manifest["deltas"]]), self.keys, self.order)

    def _live(self, rows: DataFrame) -> DataFrame:
        return rows.where(~F.coalesce(F.col(self.deleted), F.lit(False))) if self.deleted else rows

    def read(self) -> DataFrame:
        """Live rows of the last published micro-batch."""
        rows = self._live(self._merged(self._manifest())).drop(VERSION)
        return rows.drop(self.deleted) if self.deleted else rows

    def published(self, query: str, batch: int) -> bool:
        return self._manifest()["seen"].get(query, -1) >= batch

    def write(self, rows: DataFrame, query: str, batch: int) -> None:
        """Publishes one micro-batch; nothing happens where it is published already."""
        manifest = self._manifest()
        if manifest["seen"].get(query, -1) >= batch:
            return
        version = manifest["version"] + 1
        delta = f"delta-{version}-{uuid.uuid4().hex}"
        newest = last_wins(rows.withColumn(VERSION, F.lit(version).cast("bigint")), self.keys, self.order)
        newest.write.parquet(f"{self.path}/rows/{delta}")
        following = {"version": version, "base": manifest["base"], "deltas": [*manifest["deltas"], delta], "seen": {**manifest["seen"], query: batch}}
        if len(following["deltas"]) >= self.compact_every:
            base = f"base-{version}-{uuid.uuid4().hex}"
            self._live(self._merged(following)).write.parquet(f"{self.path}/rows/{base}")
            following |= {"base": base, "deltas": []}
        self.folder.publish(f"manifests/{version:020d}.json", json.dumps(following))
        self._clean()

    def _clean(self) -> None:
        names = self.folder.names("manifests")
        for old in names[: -self.keep]:
            self.folder.delete(f"manifests/{old}")
        kept = [json.loads(self.folder.read(f"manifests/{n}")) for n in names[-self.keep :]]
        named = {n for m in kept for n in [m["base"], *m["deltas"]]}
        for folder in self.folder.names("rows"):
            if folder not in named:
                self.folder.delete(f"rows/{folder}")

    def start(self, df: DataFrame, checkpoint: str, mode: str = "append") -> StreamingQuery:
        """The stream that keeps the table; what has arrived is processed and the query ends."""
        def step(batch: DataFrame, number: int) -> None:
            self.write(batch, query_of(batch), number)

        return df.writeStream.outputMode(mode).foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def query_of(batch: DataFrame) -> str:
    """Id of the streaming query that runs this micro-batch; it stays the same over restarts from one checkpoint."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or ""
