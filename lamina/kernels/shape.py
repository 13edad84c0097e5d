"""Shapes of regions from their pixels: perimeter, convex hull, orientation."""

from __future__ import annotations

from math import atan2, pi, sqrt

import numpy as np

#: Length that a border pixel adds, by 1 + 2 x edge neighbours + 10 x corner neighbours on the border (Benkrid and others, 2000). Fixed values.
STEPS = {5: 1.0, 7: 1.0, 15: 1.0, 17: 1.0, 25: 1.0, 27: 1.0, 21: sqrt(2), 33: sqrt(2), 13: (1 + sqrt(2)) / 2, 23: (1 + sqrt(2)) / 2}


def perimeter(mask: np.ndarray) -> float:
    """Length of a region's outline, pixels with a false edge neighbour or at the frame's end being its border."""
    wide = np.pad(mask, 2)
    inner = wide[1:-1, 1:-1]
    border = np.zeros(wide.shape, np.int64)
    border[1:-1, 1:-1] = inner & ~(wide[:-2, 1:-1] & wide[2:, 1:-1] & wide[1:-1, :-2] & wide[1:-1, 2:])
    at = lambda a, b: border[1 + a : border.shape[0] - 1 + a, 1 + b : border.shape[1] - 1 + b]
    code = at(0, 0) + 2 * (at(-1, 0) + at(1, 0) + at(0, -1) + at(0, 1)) + 10 * (at(-1, -1) + at(-1, 1) + at(1, -1) + at(1, 1))
    count = np.bincount(code.ravel(), minlength=34)
    return float(sum(count[k] * w for k, w in STEPS.items()))


def _half_hull(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for p in points:
        while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
            out.pop()
        out.append(p)
    return out


def convex_area(mask: np.ndarray) -> int:
    """Pixels whose centre is within the hull of the mask's pixels, each the diamond of its four edge midpoints."""
    y, x = np.nonzero(mask)
    if not len(y):
        return 0
    # In halves of a pixel, so that everything is whole numbers.
    corners = sorted({(2 * int(a) + da, 2 * int(b) + db) for a, b in zip(y, x) for da, db in ((-1, 0), (1, 0), (0, -1), (0, 1))})
    hull = _half_hull(corners)[:-1] + _half_hull(corners[::-1])[:-1]
    gy, gx = np.mgrid[0 : 2 * mask.shape[0] : 2, 0 : 2 * mask.shape[1] : 2]
    inside = np.ones(mask.shape, bool)
    for (a, b), (c, d) in zip(hull, hull[1:] + hull[:1]):
        inside &= (c - a) * (gx - b) - (d - b) * (gy - a) >= 0
    return int(inside.sum())


def orientation(y: np.ndarray, x: np.ndarray) -> float:
    """Angle between the row axis and the long axis, from -pi/2 to pi/2; without a long axis -pi/4."""
    n, y, x = len(y), y.astype(np.int64), x.astype(np.int64)
    # n * n times the second moments, in whole numbers.
    yy, xx = n * int((y * y).sum()) - int(y.sum()) ** 2, n * int((x * x).sum()) - int(x.sum()) ** 2
    yx = n * int((y * x).sum()) - int(y.sum()) * int(x.sum())
    if yy == xx:
        return pi / 4 if yx > 0 else -pi / 4
    return 0.5 * atan2(2 * yx, yy - xx)
