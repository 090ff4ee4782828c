"""Helpers shared by the training-data operators: shared-folder tables, batches of texts, hashing."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.  Where that is unset, the warehouse serves in local
    mode only, where driver and executors are one machine."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stage"


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.staged_at = path
    return staged


def drop_tables(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more: what was made of them is a staged table itself by now."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.staged_at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark clean up shuffle files of plans that nothing refers to any more: it does so as the driver's garbage goes."""
    gc.collect()
    spark._jvm.System.gc()


#: Bytes of an Arrow batch between the JVM and a Python worker: texts may be long, so rows say little.
BATCH_BYTES = 4 << 20
_UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30, "t": 1 << 40, "tb": 1 << 40, "p": 1 << 50, "pb": 1 << 50}


def size_in_bytes(setting: str) -> int:
    """A size as Spark writes it (``4194304``, ``64m``, ``1gb``) in bytes; -1 (no bound) is very large."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([a-z]*)\s*", setting.lower()).groups()
    return int(number) * _UNITS[unit] if int(number) > 0 else 1 << 62


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, with Arrow batches of at most ``BATCH_BYTES`` required: this sets the session's
    ``spark.sql.execution.arrow.maxBytesPerBatch`` for all queries that follow, unless it is as small already."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if size_in_bytes(conf.get(key)) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, which at its end gives freed memory back to the system: Python workers outlive their tasks, and an
    executor has several, whose leftovers would add up."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return task


def text_slices(batches: Iterable[pa.RecordBatch], limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches (column ``text``) so that each slice holds about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijective scrambler of 64-bit words (vectorised)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def as_signed(x: np.ndarray) -> np.ndarray:
    """Reinterpret unsigned hashes as Spark's LONG."""
    return np.ascontiguousarray(x).view(np.int64)


def ragged_arange(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count, concatenated."""
    counts = np.asarray(counts, dtype=np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    starts = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) - np.repeat(starts, counts)
