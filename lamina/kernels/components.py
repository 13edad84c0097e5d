"""Connected components of points on a grid, without a dense array."""

from itertools import product

import numpy as np


def components(points: np.ndarray, connectivity: int, values: np.ndarray | None = None) -> np.ndarray:
    """Labels 1.. of points (n, d) sorted in raster order, numbered by each component's first point.

    Neighbours differ by at most one in every axis and in at most
    ``connectivity`` axes; with values, only equal ones are neighbours.
    """
    n, d = points.shape
    if not n:
        return np.empty(0, np.int64)
    low = points.min(0)
    span = points.max(0) - low + 3
    scale = np.cumprod([1, *span[::-1][:-1].tolist()])[::-1]
    key = (points - low + 1) @ scale
    parent = np.arange(n)
    pairs = []
    for step in product((-1, 0, 1), repeat=d):
        if step > (0,) * d and sum(map(abs, step)) <= connectivity:
            want = key + np.array(step) @ scale
            at = np.minimum(np.searchsorted(key, want), n - 1)
            hit = key[at] == want
            if values is not None:
                hit &= values[at] == values
            pairs.append((np.flatnonzero(hit), at[hit]))
    a, b = (np.concatenate(x) for x in zip(*pairs))
    while True:
        low_root = np.minimum(parent[a], parent[b])
        before = parent.copy()
        np.minimum.at(parent, parent[a], low_root)
        np.minimum.at(parent, parent[b], low_root)
        while (parent != parent[parent]).any():
            parent = parent[parent]
        if (parent == before).all():
            break
    return np.unique(parent, return_inverse=True)[1] + 1
