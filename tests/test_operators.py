"""Hand-computed results on small grids."""

import numpy as np
import pytest

from lamina.kernels.components import components
from lamina.operators import intensity, labeling, measure, morphology, sequence
from lamina.plans.volume import foreground


def voxels(spark, *slices):
    rows = [("a", z, y, x, int(v)) for z, s in enumerate(slices) for (y, x), v in np.ndenumerate(np.array(s))]
    return spark.createDataFrame(rows, "volume_id string, z int, y int, x int, v int")


def pixels(frame):
    return sorted((r.z, r.y, r.x) for r in frame.collect())


def smoke():
    y, x = np.mgrid[:64, :64]
    out = np.zeros((64, 64), int)
    out[(x - 20) ** 2 + (y - 20) ** 2 <= 100] = 150
    out[(x - 44) ** 2 + (y - 44) ** 2 <= 144] = 200
    out[25:35, 25:35] = 100
    return out


def test_smoke_volume_end_to_end(spark):
    v = voxels(spark, smoke()).cache()
    info = intensity.volume_info(v).first()
    assert info.mean_v == 35.107421875 and round(info.std_v, 8) == 70.62699239
    assert intensity.otsu(v).first().threshold == 0
    mask = foreground(v, 0)
    both = morphology.closing(morphology.opening(mask, 64, 64), 64, 64)
    assert (mask.count(), both.count()) == (845, 844)
    found = measure.regions(labeling.label_slices(both), v).orderBy("label").collect()
    assert [(r.area, round(r.mean_intensity, 6)) for r in found] == [(403, round(55300 / 403, 6)), (441, 200.0)]


def test_erosion_at_the_border(spark):
    full = foreground(voxels(spark, [[1, 1, 1], [1, 1, 1], [1, 1, 1]]), 0)
    assert len(pixels(morphology.erode(full, 3, 3))) == 9
    assert pixels(morphology.erode(full, 3, 3, outside=False)) == [(0, 1, 1)]
    assert len(pixels(morphology.dilate(foreground(voxels(spark, [[1, 0], [0, 0]]), 0), 2, 2))) == 3


def test_connectivity(spark):
    mask = foreground(voxels(spark, [[1, 0, 1], [0, 1, 0], [0, 0, 1]]), 0)
    assert labeling.label_slices(mask, 2).agg({"label": "max"}).first()[0] == 1
    assert labeling.label_slices(mask, 1).agg({"label": "max"}).first()[0] == 4


def test_labels_by_first_pixel():
    points = np.array([(0, 3), (1, 0), (1, 3), (2, 0), (2, 1), (2, 2), (2, 3)])
    assert components(points, 1).tolist() == [1] * 7
    assert components(points[:4], 1).tolist() == [1, 2, 1, 2]
    assert components(points[:4], 1, np.array([1, 1, 2, 1])).tolist() == [1, 2, 3, 2]
    assert len(components(np.empty((0, 2), int), 1)) == 0


def test_volume_labels_do_not_depend_on_slabs(spark):
    rng = np.random.default_rng(1)
    mask = foreground(voxels(spark, *(rng.random((5, 4, 4)) < 0.5)), 0)
    want = sorted(map(tuple, labeling.label_volume(mask, slab=99).collect()))
    assert sorted(map(tuple, labeling.label_volume(mask, slab=1).collect())) == want


def test_fill_holes(spark):
    ring = [[1, 1, 1, 0], [1, 0, 1, 0], [1, 1, 1, 0]]
    assert (0, 1, 1) in pixels(labeling.fill_holes(foreground(voxels(spark, ring), 0), 3, 4))


def test_constant_volume(spark):
    v = voxels(spark, [[7, 7], [7, 7]])
    assert np.isnan(intensity.normalize(v, "minmax").first().v)
    assert intensity.otsu(v).first().threshold == 7
    assert intensity.equalize(v).count() == 4
    with pytest.raises(ValueError):
        intensity.normalize(v, "other")
    with pytest.raises(IndexError):
        intensity.slice_range(v, 0, 3, 1)


def test_gaussian_keeps_the_mean_and_sobel_is_flat(spark):
    v = voxels(spark, [[5] * 6] * 6)
    assert all(abs(r.v - 5) < 1e-9 for r in morphology.gaussian_2d(v, 6, 6, 1.0).collect())
    assert all(r.v == 0 for r in morphology.sobel(v, 6, 6).collect())


def test_tracking_skips_growth(spark):
    rows = [("a", 3, 1, 0.0, 0.0, 10), ("a", 2, 1, 0.0, 0.1, 50), ("a", 2, 2, 9.0, 9.0, 10), ("a", 1, 1, 0.0, 0.2, 12), ("a", 0, 1, 9.0, 9.0, 12), ("a", 0, 2, 0.0, 0.3, 20)]
    frame = spark.createDataFrame(rows, "volume_id string, z int, label int, cy double, cx double, area bigint")
    assert sorted((r.z, r.label) for r in sequence.track(frame).collect()) == [(0, 2), (1, 1), (3, 1)]


def test_empty_volume(spark):
    none = voxels(spark, [[1]]).limit(0)
    assert labeling.label_slices(foreground(none)).count() == 0
    assert intensity.volume_info(none).count() == 0
    assert intensity.otsu(none).count() == 0
