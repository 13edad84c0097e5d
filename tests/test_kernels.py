"""Kernels against brute force and hand-made shapes."""

import numpy as np
import pytest

from lamina.kernels import curves, dense
from lamina.kernels.components import components
from lamina.operators.segmentation import drop_small, labels_of, segment_array, watershed


def test_distance_is_exact():
    rng = np.random.default_rng(2)
    for share in (0.3, 0.9, 0.99):
        m = rng.random((17, 23)) < share
        m[3, 4] = False
        off = np.argwhere(~m)
        want = np.array([[np.sqrt(((off - (y, x)) ** 2).sum(1).min()) for x in range(23)] for y in range(17)])
        assert np.allclose(dense.distance(m), want)
    assert np.isinf(dense.distance(np.ones((2, 2), bool))).all()


def test_gaussian_reflects_and_keeps_the_sum():
    a = np.random.default_rng(3).random((4, 5, 3))
    assert np.isclose(dense.gaussian(a, 2.0).sum(), a.sum())
    assert np.allclose(dense.gaussian(np.full((3, 3), 7), 1.5), 7)


def test_morphology_borders():
    full = np.ones((3, 3), bool)
    assert dense.erode(full, dense.CROSS2).all()
    assert dense.erode(full, dense.CROSS2, False).sum() == 1
    assert len(dense.ball(1, 3)) == 7 and len(dense.ball(2, 2)) == 13


def two_discs():
    y, x = np.mgrid[:60, :80]
    return np.where(((x - 25) ** 2 + (y - 30) ** 2 <= 225) | ((x - 50) ** 2 + (y - 30) ** 2 <= 225), 200, 0)


def test_watershed_parts_touching_discs():
    a = two_discs()
    assert segment_array(a, "otsu").max() == 1
    got = watershed(a)
    assert sorted(set(got.ravel())) == [0, 1, 2]
    assert got[30, 25] != got[30, 50] and ((got > 0) == (a > 0)).all()
    assert not watershed(np.zeros((9, 9), int)).any()
    assert not watershed(a, min_area=10_000).any()


def test_segmenters():
    a = two_discs()
    assert segment_array(a, "manual", threshold=128).max() == 1
    assert segment_array(a, "local", block_size=35).any()
    with pytest.raises(ValueError):
        segment_array(a, "local", block_size=4)
    with pytest.raises(ValueError):
        segment_array(a, "other")
    m = np.array([[1, 1, 0], [0, 0, 1]], bool)
    assert drop_small(m, 2).tolist() == [[True, True, False], [False, False, False]]
    assert labels_of(m, 2).max() == 1


def test_clahe_spans_zero_to_one():
    a = np.random.default_rng(4).random((64, 48))
    got = dense.clahe(a)
    assert got.min() == 0 and got.max() == 1 and got.shape == a.shape
    assert not dense.clahe(np.full((8, 8), 3)).any()


def test_peaks():
    h = np.zeros(100)
    h[[10, 14, 60]] = 5, 9, 7
    assert dense.peaks_apart(h, 10) == [14, 60]
    assert dense.peaks_apart(np.array([0, 2, 2, 2, 0.0]), 1) == [2]


def holes(mask):
    """Background parts of a 3-D mask, counted with edge neighbours."""
    wide = np.pad(~mask, 1, constant_values=True)
    return components(np.argwhere(wide), 1).max()


@pytest.mark.parametrize("seed", range(4))
def test_thinning_keeps_topology(seed):
    rng = np.random.default_rng(seed)
    m = dense.gaussian(rng.random((9, 10, 11)), 1.0) > 0.5
    t = curves.thin(m)
    assert not (t & ~m).any()
    assert components(np.argwhere(m), 3).max() == components(np.argwhere(t), 3).max()
    assert holes(m) == holes(t)
    assert (curves.thin(t) == t).all()


def test_thin_slice_of_a_bar():
    m = np.zeros((9, 30), bool)
    m[2:7, 2:28] = True
    t = curves.thin(m)
    assert t.any() and t.sum(0).max() <= 3 and components(np.argwhere(t), 2).max() == 1


def test_longest_path_and_curve():
    line = np.array([(0, 0, k) for k in range(10)] + [(0, 1, 5)])
    path = curves.longest_path(line[np.lexsort(line.T[::-1])])
    assert {tuple(path[0]), tuple(path[-1])} == {(0, 0, 0), (0, 0, 9)} and len(path) == 10
    with pytest.raises(ValueError):
        curves.longest_path(np.array([(0, 0, 0), (5, 5, 5)]))
    t = np.linspace(0, 6, 60)
    wave = np.c_[t * 5, 8 * np.sin(t), 8 * np.cos(t)]
    close = curves.smooth_curve(wave, 0.5, 60)
    assert ((close - wave) ** 2).sum() < 60 and len(close) == 60
    with pytest.raises(ValueError):
        curves.smooth_curve(wave[:3])
