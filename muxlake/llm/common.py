"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: the six ASCII characters that bytes.split() splits at.
WHITE = r"\x20\x09-\x0D"


_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where it is unset, a local session gets a temporary folder of its own; a cluster's executors would not see that, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        app = context.applicationId
        if app not in _local_dirs:
            _local_dirs[app] = "file://" + tempfile.mkdtemp(prefix="muxlake-")
        found = _local_dirs[app]
    return found.rstrip("/")


_scratch: contextvars.ContextVar[str | None] = contextvars.ContextVar("scratch", default=None)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, or in the innermost scratch folder of this thread, that no other call uses."""
    return f"{_scratch.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What new_path names inside goes at the end; results of the body have to be written elsewhere before."""
    folder = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    token = _scratch.set(folder)
    try:
        yield
    finally:
        _scratch.reset(token)
        remove(spark, folder)


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder as Parquet and read again: later stages then survive lost executors."""
    return written(df, new_path(df.sparkSession, name))


def written(df: DataFrame, path: str) -> DataFrame:
    """df, written to path as Parquet and read again."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, in any case: what an operator joins or adds never meets a user's column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        new, k = f"_{name}", 0
        while new.lower() in taken:
            k += 1
            new = f"_{name}_{k}"
        taken.add(new.lower())
        out.append(new)
    return out


def cols(*names: str) -> list[Column]:
    """Columns by their whole names, dots and all."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def file_system(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The Arrow file system and path of a folder's address; a plain path is a local one."""
    if "://" in uri or uri.startswith("file:"):
        return pa.fs.FileSystem.from_uri(uri)
    return pa.fs.LocalFileSystem(), uri


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Rows that go to a Python worker at once: a session's setting that operators of long texts lower.
ROWS_AT_ONCE = ("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)


def short_batches(spark: SparkSession) -> None:
    """Let no more rows than ROWS_AT_ONCE go to a worker at once; buffers of longer batches stay with the executor's JVM."""
    if int(spark.conf.get(ROWS_AT_ONCE[0])) > ROWS_AT_ONCE[1]:
        spark.conf.set(*ROWS_AT_ONCE)


def release_memory() -> None:
    """Give back what a Python worker's allocators keep; workers stay for later tasks, and several share an executor's memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow that releases the worker's memory when a task ends, and takes columns of any name."""
    names = df.columns
    odd = any("`" in c for c in names)  # mapInArrow looks its columns up between backticks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batch.rename_columns(names) for batch in batches) if odd else function(batches)
        finally:
            release_memory()

    return (df.toDF(*(f"c{k}" for k in range(len(names)))) if odd else df).mapInArrow(run, schema)


def per_batch(df: DataFrame, function: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """map_batches of a function from one batch to batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from function(batch)

    return map_batches(df, run, schema)


def fold_of(column: str, folds: int):
    """crc32 of a number written as text, modulo folds; null for null."""
    return F.crc32(F.col(column).cast("string")) % folds
