"""Volumes from folders of slices and from TIFF files (SRC1-6, SET1).

``slices`` rows hold one decoded image; ``voxels`` is the relational form.
Spark's image source decodes on the executors; nothing but counts and shapes
for the checks comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamina.sources import tiff

SLICES = "volume_id string, z int, height int, width int, data binary"
SORTS = ("name", "number", "date")


def _pattern(glob: str) -> str:
    """A glob of *, ? and [] as a regular expression for RLIKE."""
    out = "".join({"*": ".*", "?": "."}.get(c, c if c in "[]-" else "\\" + c if not c.isalnum() else c) for c in glob)
    return f"^{out}$"


def _rank(name: Column, sort_by: str) -> list[Column]:
    """What slices are ordered by: the path; all digits of the name as one number; or the time of the last change."""
    if sort_by == "name":
        return [F.col("origin")]
    if sort_by == "number":
        digits = F.regexp_replace(name, "[^0-9]", "")
        return [F.when(digits == "", F.raise_error(F.concat(F.lit("no digits in "), name))).otherwise(digits.cast("decimal(38,0)")), F.col("origin")]
    if sort_by == "date":
        return [F.col("changed"), F.col("origin")]
    raise ValueError(f"unknown sort: {sort_by}")


def _plain(path: Column) -> Column:
    """A path with one slash after its scheme: sources write file:/ or file:///."""
    return F.regexp_replace(path, "^([A-Za-z0-9]+):/+", "$1:/")


def _listed(spark: SparkSession, where: list[str], pattern: str, nested: bool, skip: tuple[str, ...], exclude: str | None) -> DataFrame:
    """volume_id, origin and changed of the files: a listing, which reads no content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(where).select(F.col("path").alias("origin"), F.col("modificationTime").alias("changed"))
    name, volume = F.element_at(F.split("origin", "/"), -1), F.element_at(F.split("origin", "/"), -2)
    files = files.withColumn("volume_id", volume)
    if nested:
        files = files.where(~volume.isin(*skip))
    return files.where(~name.rlike(_pattern(exclude))) if exclude else files


def slices(spark: SparkSession, directory: str, pattern: str = "*.bmp", exclude: str | None = None, sort_by: str = "name", nested: bool = False, skip: tuple[str, ...] = ("Compressed",)) -> DataFrame:
    """slices(volume_id, z, height, width, data) of a folder; data is one grey byte a pixel.

    z is the rank in the order asked for.  With nested, every sub-folder but
    those of skip is a volume of its own; else the folder is one.  No files
    raise FileNotFoundError; shapes that differ within a volume, ValueError.
    """
    read = spark.read.format("image").option("dropInvalid", False).option("pathGlobFilter", pattern)
    where = [f"{directory.rstrip('/')}/*"] if nested else [directory]
    try:
        found = read.load(where)
    except Exception as e:  # the path itself is missing
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(directory) from e
        raise
    rows = found.select("image.*")
    name = F.element_at(F.split("origin", "/"), -1)
    volume = F.element_at(F.split("origin", "/"), -2)
    rows = rows.withColumn("volume_id", volume).where(~volume.isin(*skip)) if nested else rows.withColumn("volume_id", volume)
    if exclude:
        rows = rows.where(~name.rlike(_pattern(exclude)))
    # Ranks within a volume: one row a slice, paths only; no image is decoded for them.
    paths = _listed(spark, where, pattern, nested, skip, exclude)
    ranked = paths.withColumn("z", F.row_number().over(W.partitionBy("volume_id").orderBy(*_rank(F.element_at(F.split("origin", "/"), -1), sort_by))) - 1).select(_plain(F.col("origin")).alias("__at"), "z")
    rows = rows.withColumn("__at", _plain(F.col("origin"))).join(ranked, "__at")
    shape = rows.groupBy("volume_id").agg(F.count_distinct("height", "width").alias("n"), F.min("height").alias("h")).agg(F.count("*"), F.max("n"), F.min("h")).first()
    if not shape[0]:
        raise FileNotFoundError(f"no {pattern} in {directory}")
    if shape[1] > 1 or shape[2] < 0:
        raise ValueError("images of one volume differ in shape or can't be read")

    def grey(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            p["data"] = [_luma(d, n) for d, n in zip(p["data"], p["nChannels"])]
            yield p.drop(columns="nChannels")

    return rows.select("volume_id", "z", "height", "width", "data", "nChannels").mapInPandas(grey, SLICES)


def _luma(data: bytes, channels: int) -> bytes:
    """One grey byte a pixel: (299 R + 587 G + 114 B) / 1000 of Spark's BGR order, rounded."""
    if channels == 1:
        return bytes(data)
    a = np.frombuffer(data, np.uint8).reshape(-1, channels).astype(np.int64)
    return ((a[:, 2] * 299 + a[:, 1] * 587 + a[:, 0] * 114 + 500) // 1000).astype(np.uint8).tobytes()


def voxels(rows: DataFrame) -> DataFrame:
    """voxels(volume_id, z, y, x, v int) of slices; each slice unfolds where it is."""

    def unfold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for r in p.itertuples():
                y, x = np.divmod(np.arange(r.height * r.width, dtype=np.int32), np.int32(r.width))
                yield pd.DataFrame({"volume_id": r.volume_id, "z": np.int32(r.z), "y": y, "x": x, "v": np.frombuffer(r.data, np.uint8).astype(np.int32)})

    return rows.mapInPandas(unfold, "volume_id string, z int, y int, x int, v int")


def image_stack(spark: SparkSession, directory: str, **options) -> DataFrame:
    return voxels(slices(spark, directory, **options))


def single_image(spark: SparkSession, path: str) -> DataFrame:
    """voxels of one image as slice 0."""
    folder, _, name = path.rpartition("/")
    return image_stack(spark, folder or ".", pattern=name)


def scanner_stack(spark: SparkSession, directory: str) -> DataFrame:
    """A scanner's folder without its overview images."""
    return image_stack(spark, directory, exclude="*spr.bmp")


def tiff_stack(spark: SparkSession, path: str, name: str = "*.tif*") -> DataFrame:
    """voxels (v double) of the TIFF files of that name, a volume each, named by its folder; a file is one task, a page at a time."""

    def unfold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for r in p.itertuples():
                for z, a in enumerate(tiff.read(bytes(r.content))):
                    y, x = np.divmod(np.arange(a.size, dtype=np.int32), np.int32(a.shape[1]))
                    yield pd.DataFrame({"volume_id": r.path.split("/")[-2], "z": np.int32(z), "y": y, "x": x, "v": a.ravel().astype(float)})

    return spark.read.format("binaryFile").option("pathGlobFilter", name).load(path).select("path", "content").mapInPandas(unfold, "volume_id string, z int, y int, x int, v double")
