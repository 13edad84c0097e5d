"""Kernels on the dense array of one slice or slab; numpy only, free of Spark.

Borders: Gaussians reflect at half samples; erosion counts what lies outside
as true, dilation as false.  Order among equals is raster order everywhere.
"""

from __future__ import annotations

import heapq
from itertools import product

import numpy as np

CROSS2 = [(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)]


def ball(radius: int, dims: int) -> list[tuple[int, ...]]:
    """Offsets within a Euclidean radius."""
    return [o for o in product(range(-radius, radius + 1), repeat=dims) if sum(k * k for k in o) <= radius * radius]


def correlate(a: np.ndarray, w: np.ndarray, axis: int, border: str = "symmetric") -> np.ndarray:
    """Weighted sums along an axis; border is a mode of numpy.pad."""
    r = len(w) // 2
    pad = [(r, r) if k == axis else (0, 0) for k in range(a.ndim)]
    wide = np.moveaxis(np.pad(a, pad, mode=border), axis, -1)
    out = sum(w[k] * wide[..., k : k + a.shape[axis]] for k in range(len(w)))
    return np.moveaxis(out, -1, axis)


def gaussian(a: np.ndarray, sigma: float, border: str = "symmetric", truncate: float = 4.0) -> np.ndarray:
    if sigma <= 0:
        return a.astype(float)
    r = int(truncate * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    w /= w.sum()
    out = a.astype(float)
    for axis in range(a.ndim):
        out = correlate(out, w, axis, border)
    return out


def sobel(a: np.ndarray) -> np.ndarray:
    """Gradient magnitude of a slice in double precision, borders reflected."""
    rise, flat, a = np.array([-1.0, 0.0, 1.0]), np.array([1.0, 2.0, 1.0]), a.astype(float)
    return np.hypot(correlate(correlate(a, rise, 0), flat, 1), correlate(correlate(a, rise, 1), flat, 0))


def shifted(a: np.ndarray, offset: tuple[int, ...], fill) -> np.ndarray:
    """out[p] = a[p + offset], fill outside."""
    out = np.full_like(a, fill)
    to = tuple(slice(max(0, -o), max(0, n - max(0, o))) for o, n in zip(offset, a.shape))
    of = tuple(slice(max(0, o), max(0, n + min(0, o))) for o, n in zip(offset, a.shape))
    out[to] = a[of]
    return out


def dilate(mask: np.ndarray, footprint: list[tuple[int, ...]]) -> np.ndarray:
    return np.logical_or.reduce([shifted(mask, o, False) for o in footprint])


def erode(mask: np.ndarray, footprint: list[tuple[int, ...]], outside: bool = True) -> np.ndarray:
    return np.logical_and.reduce([shifted(mask, o, outside) for o in footprint])


def closing(mask: np.ndarray, footprint: list[tuple[int, ...]]) -> np.ndarray:
    return erode(dilate(mask, footprint), footprint)


def opening(mask: np.ndarray, footprint: list[tuple[int, ...]]) -> np.ndarray:
    return dilate(erode(mask, footprint), footprint)


def distance(mask: np.ndarray) -> np.ndarray:
    """Exact Euclidean distance of each true pixel to the nearest false one; infinite where all are true."""
    h, w = mask.shape
    far = np.where(mask, np.inf, 0.0)
    for y in range(1, h):
        far[y] = np.minimum(far[y], far[y - 1] + 1)
    for y in range(h - 2, -1, -1):
        far[y] = np.minimum(far[y], far[y + 1] + 1)
    column = far * far
    best = column.copy()
    for d in range(1, w):
        if not (best > d * d).any():
            break
        best[:, d:] = np.minimum(best[:, d:], column[:, :-d] + d * d)
        best[:, :-d] = np.minimum(best[:, :-d], column[:, d:] + d * d)
    return np.sqrt(best)


def local_peaks(a: np.ndarray, min_distance: int) -> np.ndarray:
    """(n, 2) positions, highest first, of maxima of a (2d+1)-square window, d apart and d off the border."""
    top = a
    for axis in range(2):
        pad = [(min_distance, min_distance) if k == axis else (0, 0) for k in range(2)]
        wide = np.pad(top, pad, constant_values=-np.inf)
        top = np.lib.stride_tricks.sliding_window_view(wide, 2 * min_distance + 1, axis).max(-1)
    d = min_distance
    inner = np.zeros(a.shape, bool)
    inner[d : a.shape[0] - d, d : a.shape[1] - d] = True
    found = np.argwhere((a == top) & (a > a.min()) & inner)
    found = found[np.argsort(-a[found[:, 0], found[:, 1]], kind="stable")]
    taken, out = np.zeros(a.shape, bool), []
    for y, x in found:
        if not taken[y, x]:
            out.append((y, x))
            taken[max(0, y - d) : y + d + 1, max(0, x - d) : x + d + 1] = True
    return np.array(out, np.int64).reshape(-1, 2)


def flood(height: np.ndarray, markers: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Watershed by priority flood from markers within mask: edge neighbours, no line between basins."""
    h, w = height.shape
    label = np.where(mask, markers, 0).ravel().copy()
    level, inside = height.ravel(), mask.ravel()
    queue = [(level[p], 0, p) for p in np.flatnonzero(label).tolist()]
    heapq.heapify(queue)
    age = 0
    while queue:
        _, _, p = heapq.heappop(queue)
        y, x = divmod(p, w)
        for q, there in ((p - w, y > 0), (p - 1, x > 0), (p + 1, x + 1 < w), (p + w, y + 1 < h)):
            if there and inside[q] and not label[q]:
                age += 1
                label[q] = label[p]
                heapq.heappush(queue, (level[q], age, q))
    return label.reshape(h, w)


def clahe(a: np.ndarray, clip_limit: float = 0.03, bins: int = 256, tiles: int = 8) -> np.ndarray:
    """Contrast-limited adaptive equalisation of a slice (Zuiderveld, 1994), result in [0, 1].

    Tiles are an eighth of each side; a tile's histogram is clipped, the excess
    spread evenly, and pixels read the four nearest tiles' curves bilinearly.
    """
    a = a.astype(float)
    low, high = a.min(), a.max()
    if high <= low:
        return np.zeros(a.shape)
    grey = np.minimum((a - low) / (high - low) * bins, bins - 1).astype(np.int64)
    side = [max(1, n // tiles) for n in a.shape]
    count = [-(-n // s) for n, s in zip(a.shape, side)]
    wide = np.pad(grey, [(0, c * s - n) for c, s, n in zip(count, side, a.shape)], mode="symmetric")
    limit = max(1, int(clip_limit * side[0] * side[1]))
    curve = np.empty((*count, bins))
    for i, j in product(*map(range, count)):
        h = np.bincount(wide[i * side[0] : (i + 1) * side[0], j * side[1] : (j + 1) * side[1]].ravel(), minlength=bins).astype(float)
        excess = np.maximum(h - limit, 0).sum()
        curve[i, j] = np.cumsum(np.minimum(h, limit) + excess / bins) / (side[0] * side[1])
    place = []
    for n, s, c in zip(a.shape, side, count):
        t = np.clip((np.arange(n) + 0.5) / s - 0.5, 0, c - 1)
        first = np.minimum(t.astype(np.int64), max(c - 2, 0))
        place.append((first, np.minimum(first + 1, c - 1), t - first))
    (y0, y1, fy), (x0, x1, fx) = place
    at = lambda y, x: curve[y[:, None], x[None, :], grey]
    fy, fx = fy[:, None], fx[None, :]
    out = (1 - fy) * ((1 - fx) * at(y0, x0) + fx * at(y0, x1)) + fy * ((1 - fx) * at(y1, x0) + fx * at(y1, x1))
    span = out.max() - out.min()
    return (out - out.min()) / span if span > 0 else np.zeros(a.shape)


def otsu(a: np.ndarray, bins: int = 256) -> float:
    """Otsu's threshold: one bin a level for integers, else centres of equal bins; the first of equal maxima.

    NaN, which nothing exceeds, where a value isn't finite.
    """
    if not np.isfinite(a).all():
        return float("nan")
    if a.min() == a.max():
        return float(a.flat[0])
    if np.issubdtype(a.dtype, np.integer):
        low = int(a.min())
        n = np.bincount((a.ravel() - low).astype(np.int64))
        v = np.arange(low, low + len(n), dtype=float)
    else:
        n, edge = np.histogram(a, bins)
        v = (edge[:-1] + edge[1:]) / 2
    n0, s0 = np.cumsum(n).astype(float), np.cumsum(n * v)
    n1, s1 = n0[-1] - n0, s0[-1] - s0
    ok = (n0 > 0) & (n1 > 0)
    apart = np.where(ok, s0 / np.where(n0 > 0, n0, 1) - s1 / np.where(n1 > 0, n1, 1), 0)
    return float(v[np.argmax(np.round(n0 * n1 * apart * apart, 6))])


def peaks_apart(h: np.ndarray, apart: int) -> list[int]:
    """Interior local maxima (the middle of a plateau) at least ``apart`` bins from any higher one kept."""
    found, i = [], 1
    while i < len(h) - 1:
        j = i
        while j + 1 < len(h) and h[j + 1] == h[i]:
            j += 1
        if h[i - 1] < h[i] and j + 1 < len(h) and h[j + 1] < h[i]:
            found.append((i + j) // 2)
        i = j + 1
    kept: list[int] = []
    for p in sorted(found, key=lambda p: (-h[p], -p)):
        if all(abs(p - q) >= apart for q in kept):
            kept.append(p)
    return kept
