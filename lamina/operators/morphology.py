"""Morphology of masks (MOR1, MOR4-6, MOR8) and filters (FLT1, FLT4a) of slices.

Slices are independent, so each operator is one kernel call a slice: rows meet
once, by slice, however large the footprint.
"""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.kernels import dense
from lamina.operators.blocks import per_slice

CROSS = dense.CROSS2


def disk(radius: int) -> list[tuple[int, int]]:
    return dense.ball(radius, 2)


def dilate(mask: DataFrame, height: int, width: int, footprint: list[tuple[int, int]] = CROSS) -> DataFrame:
    return per_slice(mask, lambda a: dense.dilate(a, footprint), height, width, None, None)


def erode(mask: DataFrame, height: int, width: int, footprint: list[tuple[int, int]] = CROSS, outside: bool = True) -> DataFrame:
    """Pixels whose whole footprint is true; what lies outside the frame counts as ``outside``."""
    return per_slice(mask, lambda a: dense.erode(a, footprint, outside), height, width, None, None)


def opening(mask: DataFrame, height: int, width: int, footprint: list[tuple[int, int]] = CROSS) -> DataFrame:
    return per_slice(mask, lambda a: dense.opening(a, footprint), height, width, None, None)


def closing(mask: DataFrame, height: int, width: int, footprint: list[tuple[int, int]] = CROSS) -> DataFrame:
    return per_slice(mask, lambda a: dense.closing(a, footprint), height, width, None, None)


def open_close(mask: DataFrame, height: int, width: int, footprint: list[tuple[int, int]] = CROSS) -> DataFrame:
    """Opening, then closing, in one visit of the slice."""
    return per_slice(mask, lambda a: dense.closing(dense.opening(a, footprint), footprint), height, width, None, None)


def remove_small(labels: DataFrame, min_size: int) -> DataFrame:
    """Labelled voxels of regions with at least min_size pixels (MOR8, MEA4's lower bound)."""
    big = labels.groupBy("volume_id", "z", "label").agg(F.count("*").alias("n")).where(F.col("n") >= min_size)
    return labels.join(big.drop("n"), ["volume_id", "z", "label"], "left_semi")


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def gaussian_2d(voxels: DataFrame, height: int, width: int, sigma: float) -> DataFrame:
    """2-D Gaussian, borders reflected at half samples."""
    return per_slice(voxels, lambda a: dense.gaussian(a, sigma), height, width)


def sobel(voxels: DataFrame, height: int, width: int) -> DataFrame:
    """Gradient magnitude of every pixel, in double, borders reflected."""
    return per_slice(voxels, dense.sobel, height, width)
