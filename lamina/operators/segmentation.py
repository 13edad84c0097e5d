"""Segmenters of slices (SEG0-5, LBL2 on their labels).

Each slice is one kernel call and slices are independent, so a volume is one
shuffle to (volume, slice) groups, or none if rows are grouped so already.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from lamina.kernels import dense
from lamina.kernels.components import components
from lamina.operators.blocks import per_slice

METHODS = ("otsu", "local", "watershed", "manual")


def labels_of(mask: np.ndarray, connectivity: int) -> np.ndarray:
    out = np.zeros(mask.shape, np.int32)
    out[mask] = components(np.argwhere(mask), connectivity)
    return out


def drop_small(mask: np.ndarray, min_size: int) -> np.ndarray:
    """mask without edge-connected regions below min_size."""
    label = labels_of(mask, 1)
    return mask & (np.bincount(label.ravel())[label] >= min_size)


def _cleaned(mask: np.ndarray, min_area: int, morphology: bool) -> np.ndarray:
    if morphology:
        mask = dense.closing(dense.opening(mask, dense.CROSS2), dense.CROSS2)
    return labels_of(drop_small(mask, min_area), 2)


def watershed(a: np.ndarray, min_area: int = 100, min_distance: int = 10) -> np.ndarray:
    """Basins of the distance to Otsu's background from its peaks; small ones go, ids are kept with gaps."""
    mask = a > dense.otsu(a)
    far = dense.distance(mask)
    seeds = np.zeros(a.shape, bool)
    if mask.any() and np.isfinite(far).all():
        peaks = dense.local_peaks(far, min_distance)
        seeds[peaks[:, 0], peaks[:, 1]] = True
    label = dense.flood(-far, labels_of(seeds, 2), mask)
    return np.where(np.bincount(label.ravel())[label] >= min_area, label, 0)


def segment_array(a: np.ndarray, method: str = "otsu", min_area: int = 100, morphology: bool = True, threshold: float = 128, block_size: int = 35, min_distance: int = 10, gaussian_sigma: float = 0.0) -> np.ndarray:
    """Labels of one slice; gaussian_sigma smooths it first, with integers brought to [0, 1]."""
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    if gaussian_sigma > 0:
        a = dense.gaussian(a / 255 if np.issubdtype(a.dtype, np.integer) else a, gaussian_sigma, "edge")
    if method == "watershed":
        return watershed(a, min_area, min_distance)
    if method == "local":
        if block_size % 2 == 0:
            raise ValueError(f"block_size must be odd: {block_size}")
        mask = a > dense.gaussian(a, (block_size - 1) / 6)
    else:
        mask = a > (dense.otsu(a) if method == "otsu" else threshold)
    return _cleaned(mask, min_area, morphology)


def segment(voxels: DataFrame, height: int, width: int, method: str = "otsu", min_area: int = 100, **options) -> DataFrame:
    """labels(volume_id, z, y, x, label) of every slice, background left out.

    Options of another method are accepted and unused, as callers pass one set to all.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    return per_slice(voxels, lambda a: segment_array(a, method, min_area, **options), height, width, out="label int")
