"""Manifests, stores and reports as files."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelaudit.functions.items import class_index
from modelaudit.sources.shared import file_system

MANIFEST = "filename string, class string, split string"
SPLITS = ("train", "val", "test")
RUN_LOG = T.StructType([T.StructField("run", T.StringType()), T.StructField("epochs", T.ArrayType(T.StructType([
    T.StructField("stage", T.IntegerType()), T.StructField("epoch", T.IntegerType()), T.StructField("train_loss", T.DoubleType()),
    T.StructField("val_loss", T.DoubleType()), T.StructField("val_macro_f1", T.DoubleType()),
])))])


def write_manifest(rows: DataFrame, path: str) -> None:
    """CSV with a header: filename, class, split."""
    rows.select("filename", "class", "split").write.mode("overwrite").csv(path, header=True)


def load_split(spark: SparkSession, split: str, manifest: str, root: str, classes: list[str]) -> DataFrame:
    """S3: the rows of one split with abs_path and class_idx; other split names are an error."""
    if split not in SPLITS:
        raise ValueError(f"split must be one of {SPLITS}")
    rows = spark.read.schema(MANIFEST).csv(manifest, header=True).filter(F.col("split") == split)
    return rows.withColumns({"abs_path": F.concat_ws("/", F.lit(root.rstrip("/")), "class", "filename"), "class_idx": class_index(F.col("class"), classes)})


def missing_keys(store: DataFrame, wanted: DataFrame, key: str = "item_id") -> DataFrame:
    """Rows of ``wanted`` that a store lacks, so only those are computed."""
    return wanted.join(store.select(key).distinct(), key, "left_anti")


def commits(path: str) -> list[str]:
    """The folders of a store's commits, oldest first. A commit is a folder of its own that its writer has marked as whole, so what a
    lost or running append has written is not there yet."""
    store, base = file_system(path)
    found = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
    names = sorted(f.base_name for f in found if f.type == fs.FileType.Directory and f.base_name.startswith("commit="))
    whole = store.get_file_info([f"{base}/{n}/_SUCCESS" for n in names])
    return [f"{path.rstrip('/')}/{n}" for n, f in zip(names, whole, strict=True) if f.type == fs.FileType.File]


def read_features(spark: SparkSession, path: str, key: str = "item_id") -> DataFrame | None:
    """A store's rows, each key once: where appends overlapped, the latest commit's row (the largest, if that has several). One
    aggregation by key. None if nothing is there."""
    folders = commits(path)
    if not folders:
        return None
    rows = spark.read.option("basePath", path).option("mergeSchema", True).parquet(*folders).withColumn("commit", F.col("commit").cast("string"))
    others = [c for c in rows.columns if c not in (key, "commit")]
    newest = rows.groupBy(key).agg(F.max(F.struct("commit", *others)).alias("_row"))
    return newest.select(key, *[F.col(f"_row.{c}").alias(c) for c in others])


def append_features(spark: SparkSession, wanted: DataFrame, compute: Callable[[DataFrame], DataFrame], path: str, key: str = "item_id") -> DataFrame:
    """Compute what the Parquet store at ``path`` lacks, append it as one commit, return the store's rows for ``wanted``.

    Appends may run side by side or again: each writes a folder of its own, named by time and chance, which counts once it is whole, and
    rows that two appends have both computed are read once.
    """
    there = read_features(spark, path, key)
    lacking = wanted if there is None else missing_keys(there, wanted, key)
    compute(lacking).write.parquet(f"{path.rstrip('/')}/commit={time.time_ns():020d}-{uuid.uuid4().hex}")
    return read_features(spark, path, key).join(wanted.select(key), key, "left_semi")


def write_predictions(preds: DataFrame, path: str) -> None:
    """Parquet by model."""
    preds.select("item_id", "y_true", "y_pred", "y_prob", "model").write.mode("overwrite").partitionBy("model").parquet(path)


def write_reports(reports: DataFrame, path: str) -> None:
    """One JSON object a row."""
    reports.write.mode("overwrite").json(path)


def read_reports(spark: SparkSession, path: str, fields: list[str], multi_line: bool = False) -> DataFrame:
    """Named fields, nested ones by dots, of JSON reports."""
    df = spark.read.option("multiLine", multi_line).json(path)
    return df.select(*[F.col(f).alias(f.replace(".", "_")) for f in fields])


def read_run_logs(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row an epoch of JSON run logs."""
    logs = spark.read.schema(RUN_LOG).option("multiLine", multi_line).json(path)
    return logs.select("run", F.posexplode("epochs").alias("index", "e")).select("run", "index", "e.*")


def explode_epochs(logs: DataFrame) -> DataFrame:
    """S8 on a table of logs."""
    return logs.select("run", F.posexplode("epochs").alias("index", "e")).select("run", "index", "e.*")


def write_metrics_table(table: DataFrame, path: str, decimals: int = 4) -> None:
    """CSV with doubles rounded."""
    cols = [F.round(f.name, decimals).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in table.schema]
    table.select(*cols).write.mode("overwrite").csv(path, header=True)


def missing_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest rows (class, filename) that a listing lacks; every row is checked."""
    return manifest.join(files.select("class", "filename").distinct(), ["class", "filename"], "left_anti")
