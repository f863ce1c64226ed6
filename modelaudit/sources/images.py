"""Images as tables: write, scan, standardise, views, features."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelaudit.kernels import pixels, stacks

STANDARD = "item_id string, class string, pixels binary, height int, width int"


def _named(rows: DataFrame, path: str, encoded: bool = True) -> DataFrame:
    """Add class and item_id (class/file), the last parts of a path or an encoded one; only jpg, jpeg and png files stay."""
    rows = rows.withColumn("_path", F.url_decode(F.regexp_replace(path, r"\+", "%2B")) if encoded else F.col(path)).filter(F.col("_path").rlike(r"(?i)\.(jpg|jpeg|png)$"))
    return rows.withColumns({"class": F.regexp_extract("_path", r"([^/]+)/[^/]+$", 1), "item_id": F.regexp_extract("_path", r"([^/]+/[^/]+)$", 1)}).drop("_path")


def scan_images(spark: SparkSession, root: str, classes: list[str]) -> DataFrame:
    """(item_id, class, image) of the jpg, jpeg and png files in one folder a class; a class without files is an error. Files that are
    no images are left out; ``unreadable_images`` names them."""
    rows = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", True).load(root)
    rows = _named(rows, "image.origin").filter(F.col("class").isin(classes))
    found = {r["class"] for r in rows.select("class").distinct().collect()}  # the given classes at most
    if missing := [c for c in classes if c not in found]:
        raise FileNotFoundError(f"no images of {missing}")
    return rows.select("item_id", "class", "image")


def unreadable_images(spark: SparkSession, root: str, classes: list[str]) -> DataFrame:
    """(item_id, class) of files that are named as images and can't be read as such. Files are listed without their contents."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    listed = _named(listed, "path", encoded=False).filter(F.col("class").isin(classes)).select("item_id", "class")
    read = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", True).load(root)
    return listed.join(_named(read.select("image.origin"), "origin").select("item_id"), "item_id", "left_anti")


def png(image: np.ndarray) -> bytes:
    """A grey 8-bit PNG file."""
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, 0, 0, 0, 0)
    rows = b"".join(b"\0" + row.tobytes() for row in image)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def write_images(images: DataFrame, root: str) -> int:
    """Write (item_id, class, pixels, height, width) as ``<root>/<class>/<item_id>``, grey PNG files; tasks write, a repeated task
    writes the same again. Returns how many files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(root) if ":/" in root else (fs.LocalFileSystem(), root)
        for df in frames:
            for item, klass, *image in zip(df["item_id"], df["class"], df["pixels"], df["height"], df["width"], strict=True):
                store.create_dir(f"{base}/{klass}", recursive=True)
                with store.open_output_stream(f"{base}/{klass}/{item}") as out:
                    out.write(png(_image(*image)))
            yield pd.DataFrame({"n": [len(df)]})

    return images.select("item_id", "class", "pixels", "height", "width").mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def standardise_images(images: DataFrame, size: int = pixels.SIZE) -> DataFrame:
    """Grey, cropped, resized."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            out = [pixels.standardise(pixels.grey(d, h, w, c), size).tobytes() for d, h, w, c in zip(df["data"], df["height"], df["width"], df["nChannels"], strict=True)]
            yield pd.DataFrame({"item_id": df["item_id"], "class": df["class"], "pixels": out, "height": size, "width": size})

    return images.select("item_id", "class", "image.data", "image.height", "image.width", "image.nChannels").mapInPandas(run, STANDARD)


def _image(data: bytes, h: int, w: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(h, w)


def expand_views(images: DataFrame, views: str) -> DataFrame:
    """H6: one row for each view of a set; an unknown set is an error. Names fan out first, pixels are made in the worker."""
    if views not in pixels.VIEWS:
        raise ValueError(f"views must be one of {sorted(pixels.VIEWS)}")
    rows = images.withColumn("view", F.explode(F.lit(list(pixels.VIEWS[views]))))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            df["pixels"] = [pixels.view(_image(*x), v).tobytes() for *x, v in zip(df["pixels"], df["height"], df["width"], df["view"], strict=True)]
            yield df

    return rows.mapInPandas(run, rows.schema)


def feature_matrix(images: DataFrame) -> DataFrame:
    """(item_id, class, features array<float> of 138). Images of one size are worked on together."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for (h, w), same in df.groupby(["height", "width"]):
                found = stacks.features(np.stack([_image(x, h, w) for x in same["pixels"]]))
                yield pd.DataFrame({"item_id": same["item_id"].astype(str), "class": same["class"], "features": list(found)})

    return images.select("item_id", "class", "pixels", "height", "width").mapInPandas(run, "item_id string, class string, features array<float>")


def pixel_table(items: DataFrame, name: str = "item_id") -> DataFrame:
    """Vectors of 64 values as 8 x 8 images: (item_id string, class, pixels, height, width); ``name`` is the column of the ids."""
    value = lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.lit(128.0) + F.lit(512.0) * x)))
    hexes = F.array_join(F.transform("features", lambda x: F.lpad(F.hex(value(x).cast("long")), 2, "0")), "")
    return items.select(F.col(name).cast("string").alias("item_id"), "class", F.unhex(hexes).alias("pixels"), F.lit(8).alias("height"), F.lit(8).alias("width"))
