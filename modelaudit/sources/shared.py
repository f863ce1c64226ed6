"""The folder that driver and executors share: tables and files that a job writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


#: paths given out, by application
MADE: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a temporary one that is then set, in one JVM only; else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="modelaudit-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear(spark: SparkSession) -> int:
    """Remove the tables and files that this session's jobs have left in the shared folder, and say how many. Results that still read them
    must be written first; only paths made by ``new_dir`` here are touched."""
    made = MADE.pop(spark.sparkContext.applicationId, [])
    gone = 0
    for path in made:
        store, plain = file_system(path)
        if store.get_file_info(plain).type == fs.FileType.Directory:
            store.delete_dir(plain)
            gone += 1
    return gone


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: the plan is cut there, and losing executors loses nothing."""
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI or of a path on this machine."""
    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri.rstrip("/"))
