"""Curved reslicing of a tube-like object (GEO1-7, GRA1-3, PRJ3, SET4, VIZ7)."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lamina.kernels.curves import longest_path, smooth_curve
from lamina.operators.blocks import Size
from lamina.operators.filters import closing_3d, skeleton
from lamina.operators.labeling import fill_holes
from lamina.operators.measure import bounding_box, crop
from lamina.operators.sequence import local_frames

HALF = [o for o in product((-1, 0, 1), repeat=3) if o > (0, 0, 0)]
CURVE = "volume_id string, i int, z double, y double, x double"


def skeleton_edges(points: DataFrame) -> DataFrame:
    """Edges (src, dst, weight) between neighbours among 26, src before dst in raster order; nodes are (z, y, x)."""
    steps = F.explode(F.array(*[F.struct(*[F.lit(k).alias(n) for k, n in zip(o, ("dz", "dy", "dx"))]) for o in HALF])).alias("d")
    moved = points.select("volume_id", F.struct("z", "y", "x").alias("src"), steps)
    moved = moved.select("volume_id", "src", *[(F.col(f"src.{c}") + F.col(f"d.d{c}")).alias(c) for c in "zyx"],
                         F.sqrt((F.col("d.dz") * F.col("d.dz") + F.col("d.dy") * F.col("d.dy") + F.col("d.dx") * F.col("d.dx")).cast("double")).alias("weight"))
    return moved.join(points, ["volume_id", "z", "y", "x"]).select("volume_id", "src", F.struct("z", "y", "x").alias("dst"), "weight")


def path_points(points: DataFrame) -> DataFrame:
    """curve(volume_id, i, z, y, x): the skeleton's longest shortest path, one small task a volume."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        p = longest_path(rows.sort_values(["z", "y", "x"])[["z", "y", "x"]].to_numpy())
        return _curve(rows["volume_id"].iloc[0], p)

    return points.groupBy("volume_id").applyInPandas(run, CURVE)


def _curve(volume: str, p: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"volume_id": volume, "i": np.arange(len(p), dtype=np.int32), **{c: p[:, k].astype(float) for k, c in enumerate("zyx")}})


def smooth(curve: DataFrame, smoothing: float = 25.0) -> DataFrame:
    """As many points on a smoothing spline; squared residuals sum to at most smoothing times their number."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        p = rows.sort_values("i")[["z", "y", "x"]].to_numpy()
        return _curve(rows["volume_id"].iloc[0], smooth_curve(p, smoothing * len(p), len(p)))

    return curve.groupBy("volume_id").applyInPandas(run, CURVE)


def rasterise(curve: DataFrame, box: DataFrame) -> DataFrame:
    """Voxels of the curve, halves rounded to even, within the sizes (zmax - zmin, ...) of the volume's box."""
    at = curve.join(box, "volume_id").select("volume_id", *[F.rint(c).cast("int").alias(c) for c in "zyx"], *[(F.col(f"{c}max") - F.col(f"{c}min")).alias(f"n{c}") for c in "zyx"])
    inside = " AND ".join(f"{c} >= 0 AND {c} < n{c}" for c in "zyx")
    return at.where(inside).select("volume_id", "z", "y", "x").distinct()


def resample(voxels: DataFrame, frames: DataFrame, size: int = 64, spacing: float = 1.0, sizes: DataFrame | None = None) -> DataFrame:
    """voxels of planes across a curve: slice i holds origin + u normal + v binormal, u along x and v along y, trilinear.

    frames is the curve beside its normals and binormals, sizes has (volume_id,
    nz, ny, nx) and is taken from the greatest coordinates if it is left out.
    Points beyond the first or last voxel of an axis are 0.  Values keep the
    type of v: integers are rounded, halves away from 0.  The grid is made where
    a frame is, its corners meet the voxels in one equi-join, and the weighted
    sum is one aggregation on (volume, i, u, v), so neither the volume nor a
    plane is held by a task.  Offsets span -size/2 .. size/2, both ends included.
    """
    if sizes is None:
        sizes = voxels.groupBy("volume_id").agg(*[(F.max(c) + 1).alias(f"n_{c}") for c in "zyx"])
    else:
        sizes = sizes.select("volume_id", *[F.col(f"n{c}").alias(f"n_{c}") for c in "zyx"])
    step = f"CAST(-{size} / 2D + k * {size}D / {max(size - 1, 1)} AS DOUBLE) * {spacing}D"
    line = f"explode(transform(sequence(0, {size - 1}), k -> named_struct('k', k, 't', {step})))"
    grid = frames.join(sizes, "volume_id").withColumn("u", F.expr(line)).withColumn("w", F.expr(line))
    spot = grid.select("volume_id", "i", F.col("w.k").alias("to_y"), F.col("u.k").alias("to_x"), *[f"n_{c}" for c in "zyx"], *[(F.col(c) + F.col("u.t") * F.col(f"n{c}") + F.col("w.t") * F.col(f"b{c}")).alias(f"p{c}") for c in "zyx"])
    inside = F.lit(True)
    for c in "zyx":
        inside = inside & (F.col(f"p{c}") >= 0) & (F.col(f"p{c}") <= F.col(f"n_{c}") - 1)
    corner = F.explode(F.array(*[F.struct(*[F.lit(k).alias(n) for k, n in zip(o, "zyx")]) for o in product((0, 1), repeat=3)])).alias("o")
    eight = spot.select("*", inside.alias("inside"), corner)
    low = {c: F.floor(f"p{c}") for c in "zyx"}
    weight = F.lit(1.0)
    for c in "zyx":
        part = F.col(f"p{c}") - low[c]
        weight = weight * F.when(F.col(f"o.{c}") == 1, part).otherwise(1 - part)
    eight = eight.select("volume_id", "i", "to_y", "to_x", *[(low[c] + F.col(f"o.{c}")).cast("int").alias(c) for c in "zyx"], F.when(F.col("inside"), weight).otherwise(0.0).alias("weight"))
    met = eight.join(voxels.select("volume_id", "z", "y", "x", "v"), ["volume_id", "z", "y", "x"], "left")
    value = F.sum(F.col("weight") * F.coalesce(F.col("v").cast("double"), F.lit(0.0)))
    kind = voxels.schema["v"].dataType
    if isinstance(kind, IntegralType):
        value = F.round(F.round(value, 9)).cast(kind)
    return met.groupBy("volume_id", F.col("i").alias("z"), F.col("to_y").alias("y"), F.col("to_x").alias("x")).agg(value.alias("v"))


def cmpr(voxels: DataFrame, size: Size, slice_size: int = 512, spacing: float = 0.5, smoothing: float = 25.0, slab: int = 64) -> dict[str, DataFrame]:
    """Planes across the centre line of each volume's positive voxels, and what leads to them.

    Returns volume (the planes), mask and cropped (within the bounding box),
    skeleton, centerline, centerline_mask (its voxels) and frames.
    An empty mask gives empty frames for that volume.
    """
    mask = closing_3d(voxels.where("v > 0").select("volume_id", "z", "y", "x"), size, 2, slab)
    box = bounding_box(mask)
    cropped = crop(voxels, box)
    inner = crop(mask.withColumn("v", F.lit(1)), box).drop("v")
    filled = fill_holes(inner, size[1], size[2])
    bone = skeleton(filled)
    line = smooth(path_points(bone), smoothing)
    frames = line.join(local_frames(line), ["volume_id", "i"])
    sizes = box.select("volume_id", *[(F.col(f"{c}max") - F.col(f"{c}min")).alias(f"n{c}") for c in "zyx"])
    return {"volume": resample(cropped, frames, slice_size, spacing, sizes), "centerline_mask": rasterise(line, box), "mask": filled, "cropped": cropped, "skeleton": bone, "centerline": line, "frames": frames}
