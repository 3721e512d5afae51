"""Helpers shared by the training-data operators: shared tables and Arrow plumbing."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


#: Rows of an Arrow batch that hold whole texts.
BATCH_ROWS = 2000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only when the session names none (local tests) a local folder is made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jdir.isDefined():
        return jdir.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="keyorder_"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Fewer rows to an Arrow batch for what runs meanwhile."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Written(str):
    """Path of a table in the shared folder."""

    #: Its name in the catalog, if it has one.
    table: str | None = None


_written = threading.local()


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., None]]:
    """Tables written meanwhile are deleted at the end, and where something fails, but for those that are given to the function it yields."""
    outer, mine, kept = getattr(_written, "paths", None), [], []
    _written.paths = mine
    try:
        yield lambda *paths: kept.extend(paths)
    except BaseException:
        kept.clear()
        raise
    finally:
        _written.paths = outer
        discard(spark, *(p for p in mine if p not in kept))
        if outer is not None:
            outer.extend(kept)


def _noted(path: Written) -> Written:
    if getattr(_written, "paths", None) is not None:
        _written.paths.append(path)
    return path


def fewer(spark: SparkSession) -> int:
    """Files for a table much smaller than the shuffles around it."""
    return max(4, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)


def write_table(df: DataFrame, name: str, files: int | None = None, texts: bool = False) -> Written:
    """Write ``df`` as Parquet in the shared folder: cuts lineage, survives lost executors.

    ``files`` gathers a small table into so many files; each writer holds buffers of its own.
    ``texts``: the rows on the way there hold whole texts.
    """
    if files:
        df = df.repartition(files)
    path = _noted(Written(f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"))
    with small_batches(df.sparkSession) if texts else contextlib.nullcontext():
        df.write.parquet(path)
    return path


def materialize(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df, name, files))


def write_bucketed(df: DataFrame, name: str, column: str, buckets: int) -> Written:
    """Write ``df`` in the shared folder as a table bucketed by ``column``; joins on it don't shuffle it."""
    table = f"keyorder_{name}_{uuid.uuid4().hex}"
    path = Written(f"{shared_dir(df.sparkSession)}/{table}")
    path.table = table
    writer = df.write.option("path", _noted(path)).format("parquet")
    writer.bucketBy(buckets, column).sortBy(column).saveAsTable(table)
    return path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables and let Spark drop the shuffle files of finished steps."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        if getattr(path, "table", None):
            spark.sql(f"DROP TABLE IF EXISTS {path.table}")
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    jvm.System.gc()


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, giving the memory it has freed back to the system: Python workers outlive their tasks."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not glibc
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def text_buffer(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """UTF-8 bytes of a whole string or binary column and its n + 1 offsets; null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(column)
    if not n:
        return b"", np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    if data is None:
        return b"", at - at[0]
    return data.slice(int(at[0]), int(at[-1] - at[0])).to_pybytes(), at - at[0]


def slices(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most about ``limit`` text bytes (one row at least): bounds a task's memory."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), np.int64)
    begin, held = 0, 0
    for i, size in enumerate(lengths.tolist()):
        if held and held + size > limit:
            yield begin, i
            begin, held = i, 0
        held += size
    if begin < len(lengths):
        yield begin, len(lengths)
