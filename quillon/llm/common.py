"""Shared pieces of the training-data operators: lineage cuts, shared paths, column hygiene."""

from __future__ import annotations

import ctypes
import gc
import posixpath
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.sources.folders import shared_dir

#: Names of the helper columns the operators add start with this; inputs must not use it.
PRIVATE = "__q_"
#: Rows of an Arrow batch, at most, while :func:`cut` writes.
BATCH_ROWS = 2000


def scratch(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that no other run uses."""
    return posixpath.join(shared_dir(spark), f"quillon-{what}-{uuid.uuid4().hex}")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within, Arrow batches hold ``BATCH_ROWS`` rows at most: a task's batch is in memory several times,
    in its executor and its worker. The session's own number is set again at the end."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = int(spark.conf.get(name))
    if 0 < own <= BATCH_ROWS:
        yield
        return
    spark.conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, str(own))


def cut(df: DataFrame, what: str = "cut", **partitioning: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there,
    and later readers prune columns. The files outlive lost executors."""
    path = scratch(df.sparkSession, what)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a frame made by :func:`cut` once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for folder in {posixpath.dirname(f) for f in df.inputFiles()}:
        if "quillon-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that nothing refers to any more: it does so
    when the driver's garbage is collected, which may be long after an iteration has left them."""
    gc.collect()
    spark._jvm.System.gc()


def width(spark: SparkSession) -> int:
    """How many tasks a large shuffle is dealt to in this session."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def keyed(df: DataFrame, *needed: str) -> DataFrame:
    """Only the columns an operator needs, so that others (and clashing names) cannot meet
    its own; missing ones are an error that names them."""
    if missing := [c for c in needed if c not in df.columns]:
        raise ValueError(f"columns not found: {', '.join(missing)}")
    return df.select(*[F.col(f"`{c}`") for c in needed])


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def arrow_map(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` that skips empty batches and gives memory back at a task's end (workers
    outlive their tasks, and two of them share an executor's memory with its heap)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from rows(b for b in batches if b.num_rows)
        finally:
            settle()

    return df.mapInArrow(run, schema)


def settle() -> None:
    """Return memory that the allocators of this process hold but do not use."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose ``column`` holds about ``most_bytes`` (one row at least)."""
    for b in batches:
        size = b.column(column).nbytes
        step = max(1, b.num_rows * most_bytes // max(size, 1))
        if step >= b.num_rows:
            yield b
        else:
            for at in range(0, b.num_rows, step):
                yield b.slice(at, step)
