"""Slab kernels don't depend on slabs; filters, segmenters and reslicing end to end."""

import numpy as np
import pytest

from lamina.kernels import dense
from lamina.operators import filters, reslice, segmentation
from lamina.operators.labeling import label_slices
from lamina.plans.volume import foreground
from tests.test_operators import smoke, voxels


def array(rows, shape, value="v"):
    out = np.zeros(shape, float if value else bool)
    for r in rows.collect():
        out[r.z, r.y, r.x] = r[value] if value else True
    return out


@pytest.fixture(scope="module")
def noise(spark):
    a = np.random.default_rng(5).integers(0, 50, (7, 6, 5))
    return a, voxels(spark, *a).cache()


@pytest.mark.parametrize("slab", [1, 3, 99])
def test_gaussian_by_slabs(noise, slab):
    a, v = noise
    assert np.allclose(array(filters.gaussian_3d(v, a.shape, 0.8, slab), a.shape), dense.gaussian(a, 0.8))


@pytest.mark.parametrize("slab", [2, 99])
def test_morphology_by_slabs(noise, slab):
    a, v = noise
    m, mask = a > 20, foreground(v, 20)
    foot = dense.ball(1, 3)
    assert (array(filters.closing_3d(mask, a.shape, 1, slab), a.shape, None) == dense.closing(m, foot)).all()
    assert (array(filters.opening_3d(mask, a.shape, 1, slab), a.shape, None) == dense.opening(m, foot)).all()
    assert (array(filters.dilate_3d(mask, a.shape, 1, slab), a.shape, None) == dense.dilate(m, foot)).all()
    assert (array(filters.erode_3d(mask, a.shape, 1, slab), a.shape, None) == dense.erode(m, foot, False)).all()
    assert filters.opening_3d(mask, a.shape, 0) is mask


def test_slice_filters(noise):
    a, v = noise
    edges = array(filters.enhance_edges(v, a.shape, 1.0, False, 2), a.shape)
    assert edges.min() == 0 and edges.max() == 1
    assert filters.clahe(v, 6, 5).count() == a.size
    near = filters.difference_of_gaussians(v, a.shape, 0.5, 1.0, 3)
    assert np.allclose(array(near, a.shape), dense.gaussian(a, 0.5) - dense.gaussian(a, 1.0))
    assert filters.distance_transform(foreground(v, 20), 6, 5).where("v < 1").count() == 0
    with pytest.raises(ValueError):
        filters.local_threshold(v, 6, 5, 4)


def test_segment_smoke_volume(spark):
    v = voxels(spark, smoke(), smoke())
    got = segmentation.segment(v, 64, 64, "otsu", 10).groupBy("z", "label").count().collect()
    assert sorted((r.z, r.label, r["count"]) for r in got) == [(0, 1, 403), (0, 2, 441), (1, 1, 403), (1, 2, 441)]
    assert segmentation.segment(v.limit(0), 64, 64).count() == 0
    assert segmentation.segment(v, 64, 64, "watershed", 10).select("label").distinct().count() >= 2


def test_valley(spark):
    rng = np.random.default_rng(6)
    two = np.r_[rng.normal(60, 8, 2000), rng.normal(180, 8, 2000)].clip(1, 255).astype(int).reshape(40, 100)
    t = filters.valley_threshold(voxels(spark, two), sigma=8.0).first().threshold
    assert 0.2 < t < 0.8
    assert filters.valley_threshold(voxels(spark, [[5, 5]])).first().threshold == 0


def tube():
    z, y, x = np.mgrid[:24, :17, :17]
    return np.where((x - 8) ** 2 + (y - 6 - z // 6) ** 2 <= 9, 100, 0)


def test_reslice_follows_a_tube(spark):
    a = tube()
    got = reslice.cmpr(voxels(spark, *a).cache(), a.shape, 9, 1.0, 1.0, slab=8)
    line = got["centerline"].orderBy("i").collect()
    assert len(line) >= 12
    planes = got["volume"]
    assert planes.count() == len(line) * 81
    middle = planes.where((planes.z == len(line) // 2) & (planes.y == 4) & (planes.x == 4)).first()
    assert middle.v > 90
    edges = reslice.skeleton_edges(got["skeleton"])
    assert edges.where("weight < 1 OR weight > 1.7321").count() == 0 and edges.count() > 0
    assert label_slices(got["mask"]).count() == got["mask"].count()


def test_resample_is_trilinear(spark):
    whole = voxels(spark, [[0, 10], [20, 30]])
    v = whole.withColumn("v", whole.v.cast("double"))
    frame = spark.createDataFrame([("a", 0, 0.0, 0.5, 0.25, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)], "volume_id string, i int, z double, y double, x double, nz double, ny double, nx double, bz double, `by` double, bx double")
    got = {(r.y, r.x): r.v for r in reslice.resample(v, frame, 3, 0.1).collect()}
    assert abs(got[1, 1] - 12.5) < 1e-9 and len(got) == 9
    # Column 2 is 0.15 along the normal, which is y: 0.75 (20 * 0.65) + 0.25 (10 + 20 * 0.65); row 2 is as far along x.
    assert abs(got[1, 2] - 15.5) < 1e-9 and abs(got[2, 1] - 14.0) < 1e-9
    assert {(r.y, r.x): r.v for r in reslice.resample(whole, frame, 3, 0.1).collect()}[1, 2] == 16
    # 0.75 beyond the last row there is no voxel to blend with.
    far = {(r.y, r.x): r.v for r in reslice.resample(v, frame, 3, 0.5).collect()}
    assert far[1, 2] == 0 and far[1, 0] == 0 and abs(far[1, 1] - 12.5) < 1e-9
