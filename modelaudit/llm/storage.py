"""Shared storage for tables and files that a job writes and reads again.

Everything goes below ``spark.checkpoint.dir``, the one folder that driver and executors share. Tables replace
``checkpoint()`` where Parquet is the better form (columns are pruned when read again); binary files are written by tasks
under names of their own, and only files that the task's result row names count, so a lost or repeated task leaves nothing
but an unread file.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset (tests in one JVM), a temporary folder, which is then set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="modelaudit-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: the plan is cut there, and losing executors loses nothing."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI, also inside a task (hdfs, s3, gs and local ones)."""
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


def unique_name(prefix: str, suffix: str) -> str:
    """A file name that no other task or attempt uses."""
    return f"{prefix}-{uuid.uuid4().hex}{suffix}"


def release() -> None:
    """Give back what Arrow and the C library keep of freed memory; a reused worker would hold it through other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Split a stream of batches that is sorted by ``key`` into one table per key value (neighbours only)."""
    held: list[pa.RecordBatch] = []
    last: object = None
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(key)).to_pylist()
        start = 0
        for i, value in enumerate(values):
            if (held or i > start) and value != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield pa.Table.from_batches(held)
                held, start = [], i
            last = value
        if start < len(values):
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)
