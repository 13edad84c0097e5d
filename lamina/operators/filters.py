"""Neighbourhood filters and 3-D morphology by slabs (FLT1-6, THR3, THR5, MOR2-5, MOR7, MOR9)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.kernels import curves, dense
from lamina.operators.blocks import MASK, Size, per_slab, per_slice
from lamina.operators.intensity import valley_inputs
from lamina.operators.lineage import beside


def gaussian_3d(voxels: DataFrame, size: Size, sigma: float = 1.0, slab: int = 64) -> DataFrame:
    """3-D Gaussian, borders reflected; the halo is the kernel's radius."""
    return per_slab(voxels, lambda a: dense.gaussian(a, sigma), size, slab, int(4 * sigma + 0.5))


def gaussian_slice(voxels: DataFrame, height: int, width: int, sigma: float, scale: float = 255.0) -> DataFrame:
    """2-D Gaussian before segmentation: borders repeat the last pixel, integer values are brought to [0, 1] by scale."""
    return per_slice(voxels.withColumn("v", F.col("v") / F.lit(scale)), lambda a: dense.gaussian(a, sigma, "edge"), height, width)


def difference_of_gaussians(voxels: DataFrame, size: Size, low_sigma: float = 1.0, high_sigma: float = 5.0, slab: int = 64) -> DataFrame:
    """G(low) - G(high) in one pass over the slabs."""
    return per_slab(voxels, lambda a: dense.gaussian(a, low_sigma) - dense.gaussian(a, high_sigma), size, slab, int(4 * max(low_sigma, high_sigma) + 0.5))


def enhance_edges(voxels: DataFrame, size: Size, sigma: float = 1.0, equalize: bool = True, slab: int = 64) -> DataFrame:
    """Gradient magnitude of the smoothed volume, each slice brought to [0, 1], contrast equalised if asked.

    A slice's gradient reads that slice only, so it follows the 3-D Gaussian in the same slab.
    """

    def kernel(a: np.ndarray) -> np.ndarray:
        out = np.empty(a.shape)
        for k, s in enumerate(dense.gaussian(a, sigma)):
            g = dense.sobel(s)
            g -= g.min()
            g = g / g.max() if g.max() > 0 else g
            out[k] = dense.clahe(g, 0.03) if equalize else g
        return out

    return per_slab(voxels, kernel, size, slab, int(4 * sigma + 0.5))


def clahe(voxels: DataFrame, height: int, width: int, clip_limit: float = 0.03) -> DataFrame:
    return per_slice(voxels, lambda a: dense.clahe(a, clip_limit), height, width)


def distance_transform(mask: DataFrame, height: int, width: int) -> DataFrame:
    """Distance of true pixels to the nearest false one of their slice; false pixels are left out."""
    rows = per_slice(mask, dense.distance, height, width, None)
    return rows.where("v > 0")


def local_threshold(voxels: DataFrame, height: int, width: int, block_size: int = 35) -> DataFrame:
    """Mask of pixels strictly above their Gaussian-weighted neighbourhood of an odd block size."""
    if block_size % 2 == 0:
        raise ValueError(f"block_size must be odd: {block_size}")
    sigma = (block_size - 1) / 6
    return per_slice(voxels, lambda a: a > dense.gaussian(a, sigma), height, width, out=None)


def closing_3d(mask: DataFrame, size: Size, radius: int = 1, slab: int = 64) -> DataFrame:
    foot = dense.ball(radius, 3)
    return per_slab(mask, lambda a: dense.closing(a, foot), size, slab, 2 * radius, None, None)


def opening_3d(mask: DataFrame, size: Size, radius: int = 0, slab: int = 64, disk_radius: int = 0) -> DataFrame:
    """Opening with a ball, then of each slice with a disk; radii of 0 change nothing.

    The disk is a slice's: a volume of one slice is a 2-D image, and a disk on a
    deeper one is an error, as their ranks differ.
    """
    if disk_radius > 0 and size[0] != 1:
        raise ValueError("a disk opens slices, not volumes")
    if radius > 0:
        foot = dense.ball(radius, 3)
        mask = per_slab(mask, lambda a: dense.opening(a, foot), size, slab, 2 * radius, None, None)
    if disk_radius > 0:
        flat = dense.ball(disk_radius, 2)
        mask = per_slice(mask, lambda a: dense.opening(a, flat), size[1], size[2], None, None)
    return mask


def dilate_3d(mask: DataFrame, size: Size, radius: int = 1, slab: int = 64) -> DataFrame:
    foot = dense.ball(radius, 3)
    return per_slab(mask, lambda a: dense.dilate(a, foot), size, slab, radius, None, None)


def erode_3d(mask: DataFrame, size: Size, radius: int = 1, slab: int = 64) -> DataFrame:
    """Erosion with a ball for which what lies outside the volume is false: its border voxels go."""
    foot = dense.ball(radius, 3)
    depth = size[0]
    # A slab's first and last planes are the volume's only at its ends; elsewhere the halo absorbs the difference.
    return per_slab(mask, lambda a: dense.erode(a, foot, False), (depth, *size[1:]), slab, radius, None, None)


def binary_closing(voxels: DataFrame, size: Size, fill: bool = False, slab: int = 64) -> DataFrame:
    """Mask of positive voxels; with fill, closed by the 3-D cross (it closes, it doesn't fill holes)."""
    mask = voxels.where("v > 0").select("volume_id", "z", "y", "x")
    return closing_3d(mask, size, 1, slab) if fill else mask


def skeleton(mask: DataFrame) -> DataFrame:
    """One-voxel-thin skeleton of each volume's mask.

    Thinning is sequential over an object, so a volume's mask is one task;
    only its bounding box is held.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        p = rows[["z", "y", "x"]].to_numpy()
        low = p.min(0)
        a = np.zeros(p.max(0) - low + 1, bool)
        a[tuple((p - low).T)] = True
        left = np.argwhere(curves.thin(a)) + low
        return pd.DataFrame({"volume_id": rows["volume_id"].iloc[0], **{c: left[:, k].astype(np.int32) for k, c in enumerate("zyx")}})

    return mask.groupBy("volume_id").applyInPandas(run, MASK)


def valley_threshold(voxels: DataFrame, bins: int = 512, sigma: float = 1.0) -> DataFrame:
    """Deepest valley between the histogram's two tallest peaks, on the scale where p1 is 0 and p99 is 1; 0 if there is none.

    Counting is an aggregation over voxels; only ``bins`` counts a volume reach the kernel.
    """
    scaled = (F.col("v").cast("double") - F.col("p1")) / (F.col("p99") - F.col("p1") + 1e-6)
    part = F.least(F.lit(bins - 1), F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)) * bins)).cast("int")
    counts = beside(voxels.where("v > 0"), valley_inputs(voxels), ["volume_id"]).groupBy("volume_id", part.alias("bin")).agg(F.count("*").alias("n"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        h = np.zeros(bins)
        h[rows["bin"]] = rows["n"]
        h = np.round(dense.gaussian(h, sigma), 9)
        two = sorted(dense.peaks_apart(h, bins // 10)[:2])
        at = 0.0 if len(two) < 2 else (two[0] + int(np.argmin(h[two[0] : two[1] + 1])) + 0.5) / bins
        return pd.DataFrame({"volume_id": [rows["volume_id"].iloc[0]], "threshold": [at]})

    return counts.groupBy("volume_id").applyInPandas(run, "volume_id string, threshold double")
