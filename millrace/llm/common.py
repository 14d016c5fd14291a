"""Shared storage and text plumbing of the corpus operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import ensure_worker_path, read_table

__all__ = ["discard", "held_out", "lean", "materialise", "prepare", "read_table", "require_few", "shared_dir", "slices", "utf8"]


_own_dirs: dict[str, str] = {}
_left: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    Where the session names none, a temporary one of this machine serves a local session; on a cluster that is an error.
    """
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master, app = spark.sparkContext.master, spark.sparkContext.applicationId
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = _own_dirs.setdefault(app, _own_dirs.get(app) or tempfile.mkdtemp(prefix="millrace-"))
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; what is not discarded before goes when the driver's process ends."""
    path = f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"
    _left[path] = spark
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read back, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete the files of materialised tables that nothing reads any more; other tables are left alone."""
    for table in tables:
        path = getattr(table, "_scratch", None)
        if path and path in _left:
            _delete(_left.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _sweep() -> None:
    # At the end the session may be gone; what cannot be reached then stays for the cluster's own cleaning.
    with contextlib.suppress(Exception):
        for path, spark in list(_left.items()):
            _delete(spark, path)
    for path in _own_dirs.values():
        shutil.rmtree(path, ignore_errors=True)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Give freed memory back to the machine after a task, so that idle Python workers hold little."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def prepare(df: DataFrame) -> SparkSession:
    ensure_worker_path(df.sparkSession)
    return df.sparkSession


def held_out(id_col: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id's text leaves remainder 1 by three; a null id is held out."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(True))


def require_few(rows: DataFrame, column: str, most: int) -> None:
    """An error if a column has more distinct values than ``most``, before anything is counted by them."""
    if rows.select(column).distinct().limit(most + 1).count() > most:
        raise ValueError(f"more than {most} different values of {column}")


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow column as one byte array and n + 1 offsets; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string()).cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Split a batch so that each part holds at most about ``limit`` bytes of text (one longer text stands alone)."""
    if not batch.num_rows:
        return
    data, off = utf8(batch.column(text))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield batch.slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j
