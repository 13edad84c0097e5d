"""Kernels on the points of one object: thinning, longest path, smoothing curve."""

from __future__ import annotations

import heapq
from functools import lru_cache
from itertools import product

import numpy as np

AROUND = [o for o in product((-1, 0, 1), repeat=3) if any(o)]


def _parts(cells: list[tuple[int, ...]], reach: int) -> list[set]:
    left, out = set(cells), []
    while left:
        part, todo = set(), [left.pop()]
        while todo:
            p = todo.pop()
            part.add(p)
            near = [q for q in left if max(abs(a - b) for a, b in zip(p, q)) <= 1 and sum(abs(a - b) for a, b in zip(p, q)) <= reach]
            left.difference_update(near)
            todo += near
        out.append(part)
    return out


@lru_cache(1 << 18)
def _simple(code: int) -> bool:
    """Whether a voxel with these 26 neighbours can go without a change of topology (Bertrand and Malandain, 1994)."""
    on = [o for k, o in enumerate(AROUND) if code >> k & 1]
    if len(_parts(on, 3)) != 1:
        return False
    off = [o for k, o in enumerate(AROUND) if not code >> k & 1 and sum(map(abs, o)) <= 2]
    return sum(any(sum(map(abs, o)) == 1 for o in part) for part in _parts(off, 1)) == 1


def thin(mask: np.ndarray) -> np.ndarray:
    """Skeleton of a 3-D mask (or a slice): border voxels that are simple and no ends go, side by side.

    Each round peels the six sides in turn and tests every voxel again right
    before it goes, so components, tunnels and cavities stay as they are.
    Voxels are not those of other thinnings; the topology and thinness are.
    """
    flat = mask.ndim == 2
    a = np.pad(mask[None] if flat else mask, 1).astype(bool)
    sides = [(0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)] if flat or mask.shape[0] == 1 else [o for o in AROUND if sum(map(abs, o)) == 1]
    changed = True
    while changed:
        changed = False
        for side in sides:
            border = np.argwhere(a & ~np.roll(a, [-k for k in side], (0, 1, 2)))
            doomed = []
            for z, y, x in border.tolist():
                code = _code(a, z, y, x)
                if code.bit_count() > 1 and _simple(code):
                    doomed.append((z, y, x))
            for z, y, x in doomed:
                code = _code(a, z, y, x)
                if code.bit_count() > 1 and _simple(code):
                    a[z, y, x] = False
                    changed = True
    a = a[1:-1, 1:-1, 1:-1]
    return a[0] if flat else a


def _code(a: np.ndarray, z: int, y: int, x: int) -> int:
    bits = a[z - 1 : z + 2, y - 1 : y + 2, x - 1 : x + 2].ravel().tolist()
    del bits[13]
    return sum(1 << k for k, b in enumerate(bits) if b)


def _far(near: list[list[tuple[int, float]]], start: int) -> tuple[list[float], list[int]]:
    far, back = [float("inf")] * len(near), [-1] * len(near)
    far[start], queue = 0.0, [(0.0, start)]
    while queue:
        d, p = heapq.heappop(queue)
        if d > far[p]:
            continue
        for q, w in near[p]:
            if d + w < far[q] - 1e-12:
                far[q], back[q] = d + w, p
                heapq.heappush(queue, (d + w, q))
    return far, back


def longest_path(points: np.ndarray) -> np.ndarray:
    """Points along the shortest path between two far ends of a skeleton (n, 3) in raster order.

    Two sweeps: the farthest point from the first one, then the farthest from
    that; exact on trees.  Only the first point's component is seen.
    """
    at = {tuple(p): i for i, p in enumerate(points.tolist())}
    near = [[(at[q], float(np.sqrt(sum(map(abs, o))))) for o in AROUND if (q := tuple(a + b for a, b in zip(p, o))) in at] for p in at]
    if not any(near):
        raise ValueError("the skeleton has no edges")
    if not near[0]:
        raise ValueError("the first point of the skeleton stands alone")
    reach = lambda far: max((d, -i) for i, d in enumerate(far) if d < float("inf"))[1] * -1
    u = reach(_far(near, 0)[0])
    far, back = _far(near, u)
    path = [reach(far)]
    while path[-1] != u:
        path.append(back[path[-1]])
    return points[path[::-1]]


def _basis(u: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """Cubic B-splines of inner knots in [0, 1] at u (Cox and de Boor)."""
    t = np.r_[[0.0] * 4, knots, [1.0] * 4]
    b = ((u[:, None] >= t[:-1]) & (u[:, None] < t[1:])).astype(float)
    b[u >= 1.0, len(t) - 5] = 1.0
    for k in range(1, 4):
        n = len(t) - 1 - k
        rise, fall = t[k : k + n] - t[:n], t[k + 1 : k + 1 + n] - t[1 : 1 + n]
        left = np.divide(u[:, None] - t[:n], rise, out=np.zeros((len(u), n)), where=rise > 0)
        right = np.divide(t[k + 1 : k + 1 + n] - u[:, None], fall, out=np.zeros((len(u), n)), where=fall > 0)
        b = left * b[:, :n] + right * b[:, 1 : n + 1]
    return b


def smooth_curve(points: np.ndarray, s: float = 5.0, n: int = 100) -> np.ndarray:
    """n points, even in chord length, of a cubic smoothing spline whose squared residuals sum to at most s.

    The plain cubic where it is near enough; else knots are added, in the
    middle of the span that fits worst, until it is.
    """
    if len(points) < 4:
        raise ValueError("a cubic needs at least four points")
    points = points.astype(float)
    u = np.r_[0.0, np.cumsum(np.linalg.norm(np.diff(points, axis=0), axis=1))]
    u /= u[-1]
    knots = np.empty(0)
    while True:
        b = _basis(u, knots)
        c = np.linalg.lstsq(b, points, rcond=None)[0]
        error = ((b @ c - points) ** 2).sum(1)
        if error.sum() <= s or len(knots) >= len(points) - 4:
            return _basis(np.linspace(0, 1, n), knots) @ c
        edge = np.r_[0.0, knots, 1.0]
        span = np.clip(np.searchsorted(edge, u, "right") - 1, 0, len(edge) - 2)
        worst = int(np.argmax(np.bincount(span, error, len(edge) - 1)))
        knots = np.sort(np.append(knots, (edge[worst] + edge[worst + 1]) / 2))
