"""Table loading, staging in the shared folder and small Arrow helpers of the text operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from wayline.session import scratch_folder, use_utc


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def staged(df: DataFrame, compression: str = "zstd", block_bytes: int = 128 << 20) -> DataFrame:
    """``df`` written once as Parquet under spark.checkpoint.dir and read back: survives lost executors and is not computed twice.

    Tables of few large rows take small row groups (``block_bytes``), so that a reader holds few rows at once.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", compression).option("parquet.block.size", block_bytes).parquet(path)
    # Spark removes the shuffle files of the job just done once the driver's garbage is collected; without this they pile up
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    if _collected:
        _collected[-1].append(out)
    return out


_collected: list[list[DataFrame]] = []


@contextmanager
def collecting() -> Iterator[list[DataFrame]]:
    """The tables that are staged inside, for whoever knows when they are not read any more."""
    _collected.append([])
    try:
        yield _collected[-1]
    finally:
        _collected.pop()


def _folders_read(df: DataFrame) -> list[str] | None:
    """The folders that ``df`` is read from; null where its plan does not tell."""
    leaves, out = df._jdf.queryExecution().analyzed().collectLeaves(), []
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        kind = leaf.getClass().getSimpleName()
        if kind == "LogicalRelation":
            out += leaf.relation().location().rootPaths().mkString("\n").split("\n")
        elif kind not in ("LocalRelation", "Range", "OneRowRelation"):
            return None
    return out


def discard_unread(tables: list[DataFrame], reader: DataFrame) -> None:
    """Deletes those of the staged tables of this session that ``reader`` is not made from."""
    read = _folders_read(reader) if tables else []
    if read is not None:
        discard(*[t for t in tables if t.sparkSession is reader.sparkSession and not any(f.endswith(t.staged_path.rsplit("/", 1)[-1]) for f in read)])


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more: whatever was made from them has been staged itself."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that ``column`` holds about ``most_bytes`` at once; one row is never cut."""
    for batch in batches:
        rows, size = batch.num_rows, batch.column(batch.schema.get_field_index(column)).nbytes
        step = rows if size <= most_bytes else max(1, rows * most_bytes // size)
        for at in range(0, rows, max(1, step)):
            yield batch.slice(at, step)
