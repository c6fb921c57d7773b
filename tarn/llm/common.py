"""Shared folder, tables and small column helpers of the subpackage."""

from __future__ import annotations

import ctypes
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import cache

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` of the session decides; only where it is unset and the master is this
    process (tests) is a local folder set for the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tarn-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tarn-{uuid.uuid4().hex}"


def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    """One of pyarrow's file systems and the path in it, for tasks; s3a and s3n are its s3."""
    scheme, colon, rest = folder.partition(":")
    if not colon or folder.startswith("/"):
        return pafs.LocalFileSystem(), folder
    scheme = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
    return pafs.FileSystem.from_uri(f"{scheme}:{rest}" if rest.startswith("//") else f"{scheme}://{rest}")


@contextmanager
def new_file(folder: str, name: str) -> Iterator[pa.NativeFile]:
    """A stream to a file in the shared folder, there whole or not at all; of two attempts the last stays."""
    system, path = file_system(folder)
    draft = f"{path}/_{name}.{uuid.uuid4().hex}"
    system.create_dir(path, recursive=True)
    with system.open_output_stream(draft, compression=None) as out:
        yield out
    system.move(draft, f"{path}/{name}")


def write_file(folder: str, name: str, data: bytes) -> None:
    """A file of ``data`` by ``new_file``."""
    with new_file(folder, name) as out:
        out.write(data)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder, its lineage cut."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def table(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    Unlike ``cut`` the rows are columnar and compressed, so later readers prune columns.
    """
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows and bytes of an Arrow batch. Spark's own bounds let a batch of texts have 64 MB, which the
#: JVM, the socket and the Python worker of every running task hold at the same time.
ARROW_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "2m"}


def small_batches(spark: SparkSession) -> SparkSession:
    """``spark`` with smaller Arrow batches, for the queries over whole texts."""
    for key, value in ARROW_BATCH.items():
        spark.conf.set(key, value)
    return spark


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, of: int, seed: str = "") -> Column:
    """The remainder of the CRC-32 of a key's text by ``of``; a null key has remainder 0."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.crc32(F.encode(F.concat(F.lit(seed), text) if seed else text, "UTF-8")) % F.lit(of)


#: Rows of a table of a few numbers that are broadcast at most, some 16 MB.
BROADCAST_ROWS = 500_000


def sized(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it has been counted to be small; a larger one is shuffled."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def release() -> None:
    """Hands unused memory of a Python worker back: idle workers live on beside later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


@cache
def one_thread() -> None:
    """Matrix products of this worker on one core, as a task has one: more threads would wait for one another."""
    try:
        with open("/proc/self/maps") as maps:
            paths = {line.split()[-1] for line in maps if "openblas" in line}
    except OSError:  # not this system
        return
    for path in paths:
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break


def lean(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow on one core, with unused memory released after each task and about every second."""

    def leaving(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        last = time.monotonic()
        try:
            for made in run(batches):
                yield made
                if time.monotonic() - last > 1:
                    release()
                    last = time.monotonic()
        finally:
            release()

    return leaving
