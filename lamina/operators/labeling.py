"""Connected components of masks (LBL1-3, MOR6).

Slices are independent: a kernel labels each in one task, from coordinates.
In 3-D the kernel labels slabs of slices, and the labels that touch across the
slabs' faces are merged as a graph of labels, which is far smaller than the volume.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamina.kernels.components import components
from lamina.operators.lineage import cut

LABELS = "volume_id string, z int, y int, x int, label int"


def label_slices(mask: DataFrame, connectivity: int = 2, value: str | None = None) -> DataFrame:
    """labels(volume_id, z, y, x, label) with ids by first pixel in raster order; 1 joins edges, 2 corners too.

    With value, only pixels of equal value join.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["y", "x"], ignore_index=True)
        points = rows[["y", "x"]].to_numpy()
        rows["label"] = components(points, connectivity, rows[value].to_numpy() if value else None).astype(np.int32)
        return rows[["volume_id", "z", "y", "x", "label"]]

    return mask.groupBy("volume_id", "z").applyInPandas(run, LABELS)


def fill_holes(mask: DataFrame, height: int, width: int) -> DataFrame:
    """mask and the background regions (edge-connected) that don't touch the slice's border."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        full = np.zeros((height, width), bool)
        full[rows["y"], rows["x"]] = True
        empty = np.argwhere(~full)
        label = components(empty, 1)
        border = (empty[:, 0] == 0) | (empty[:, 0] == height - 1) | (empty[:, 1] == 0) | (empty[:, 1] == width - 1)
        hole = empty[~np.isin(label, label[border])]
        full[hole[:, 0], hole[:, 1]] = True
        y, x = np.nonzero(full)
        return pd.DataFrame({"volume_id": rows["volume_id"].iloc[0], "z": rows["z"].iloc[0], "y": y.astype(np.int32), "x": x.astype(np.int32)})

    return mask.groupBy("volume_id", "z").applyInPandas(run, "volume_id string, z int, y int, x int")


def label_volume(mask: DataFrame, slab: int = 64, connectivity: int = 1, numbered: bool = False) -> DataFrame:
    """3-D labels: label is the component's first voxel in raster order, as (z, y, x) packed, or its number from 1 if asked for.

    Connectivity is 1 (faces), 2 (edges too) or 3 (corners too).  The kernel's
    labels and each round's label graph are written, so a round reads the one
    before it and never runs a kernel again.  A round takes the least root
    among neighbours and then the root's root, so rounds grow with the
    logarithm of the slabs that a component spans.
    """
    key = F.col("z").cast("long") * (1 << 40) + F.col("y").cast("long") * (1 << 20) + F.col("x")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["z", "y", "x"], ignore_index=True)
        label = components(rows[["z", "y", "x"]].to_numpy(), connectivity)
        rows["part"] = rows["key"].to_numpy()[np.unique(label, return_index=True)[1]][label - 1]
        return rows[["volume_id", "z", "y", "x", "part"]]

    parts = mask.withColumn("key", key).withColumn("slab", F.floor(F.col("z") / slab)).groupBy("volume_id", "slab").applyInPandas(run, "volume_id string, z int, y int, x int, part long")
    parts = cut(parts)
    above = [(b, c) for b in (-1, 0, 1) for c in (-1, 0, 1) if abs(b) + abs(c) < connectivity]
    steps = F.explode(F.array(*[F.struct(F.lit(b).alias("b"), F.lit(c).alias("c")) for b, c in above])).alias("s")
    top = parts.where(F.pmod("z", F.lit(slab)) == 0).select("volume_id", "z", "y", "x", F.col("part").alias("up"), steps)
    top = top.select("volume_id", (F.col("z") - 1).alias("z"), (F.col("y") + F.col("s.b")).alias("y"), (F.col("x") + F.col("s.c")).alias("x"), "up")
    faces = parts.join(top, ["volume_id", "z", "y", "x"]).select("volume_id", F.col("part").alias("a"), F.col("up").alias("b")).distinct()
    both = cut(faces.union(faces.select("volume_id", "b", "a")).toDF("volume_id", "a", "b"))
    root = parts.select("volume_id", F.col("part").alias("node")).distinct().withColumn("root", F.col("node"))
    while True:
        near = both.join(root, (both.volume_id == root.volume_id) & (both.b == root.node)).groupBy(both.volume_id, both.a).agg(F.min("root").alias("m"))
        new = root.join(near, (root.volume_id == near.volume_id) & (root.node == near.a), "left").select(root.volume_id, "node", F.least("root", F.coalesce("m", "root")).alias("root"), F.col("root").alias("was"))
        of = new.select("volume_id", F.col("node").alias("root"), F.col("root").alias("further"))
        new = cut(new.join(of, ["volume_id", "root"]).select("volume_id", "node", F.col("further").alias("root"), "was"))
        changed = not new.where("root <> was").isEmpty()
        root = new.drop("was")
        if not changed:
            break
    if numbered:
        number = F.row_number().over(W.partitionBy("volume_id").orderBy("root"))
        numbers = root.select("volume_id", "root").distinct().withColumn("label", number)
        root = root.join(numbers, ["volume_id", "root"]).select("volume_id", "node", F.col("label").alias("root"))
    return parts.join(root.withColumnRenamed("node", "part"), ["volume_id", "part"]).select("volume_id", "z", "y", "x", F.col("root").alias("label"))
