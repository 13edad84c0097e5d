"""The composite workflows on made-up jaws."""

import numpy as np
import pytest

from lamina.plans import dental
from tests.test_operators import voxels


def disc(a, z, y, x, r, v):
    yy, xx = np.mgrid[: a.shape[1], : a.shape[2]]
    a[z][(yy - y) ** 2 + (xx - x) ** 2 <= r * r] = v


def test_incisor_is_followed(spark):
    a = np.zeros((4, 40, 60), int)
    for z in range(4):
        disc(a, z, 20, 13, 9, 200)
        disc(a, z, 20, 42, 12, 200)
    got = dental.segment_incisor(voxels(spark, *a).cache(), a.shape, slab=3)
    p = got.toPandas()
    assert set(p.z) == {0, 1, 2, 3} and p.x.max() < 25


def test_molars_and_bone(spark):
    a = np.zeros((4, 40, 80), int)
    for z in range(4):
        disc(a, z, 20, 16, 13, 200)
        disc(a, z, 20, 45, 9, 200)
        disc(a, z, 20, 70, 6, 200)
    bone, molars = dental.segment_molar_bone(voxels(spark, *a).cache(), a.shape)
    b, m = bone.toPandas(), molars.toPandas()
    assert b.x.max() < 31 and 33 < m.x.min() and m.x.max() < 58


def test_trim(spark):
    a = np.zeros((4, 4, 4), int)
    a[0, 0, 0] = 5
    a[1:3] = 7
    got = dental.trim_ends(voxels(spark, *a), 10).toPandas()
    assert set(got[got.v > 0].z) == {1, 2} and len(got) == 64
    same = dental.trim_ends(voxels(spark, *a), 999).toPandas()
    assert set(same[same.v > 0].z) == {0, 1, 2}


def test_unknown_bounds_are_slices(spark):
    a = np.full((6, 30, 30), 50)
    for z, r in enumerate((12, 12, 4, 4, 12, 12)):
        disc(a, z, 15, 15, r, 200)
    v = voxels(spark, *a)
    dentin = spark.createDataFrame([("a", 55.0)], "volume_id string, dentin double")
    got = dental.unknown_bounds(v, dentin, a.shape).first()
    assert (got.lower, got.upper) == (2, 4)


def test_analysis_of_both_regions(spark):
    a = np.zeros((2, 40, 40), int)
    for z in range(2):
        disc(a, z, 20, 20, 15, 60)
        disc(a, z, 20, 20, 10, 100)
        disc(a, z, 20, 20, 6, 200)
    after = dental.analyze_after(voxels(spark, *a)).collect()
    assert len(after) == 2 and all(r.intensity_ratios > 1 for r in after)
    before = dental.analyze_before(voxels(spark, *a), a.shape).collect()
    assert len(before) == 2 and all(r.intensity_ratios < 1 for r in before)


def test_no_bone_is_an_error(spark):
    a = np.zeros((2, 8, 8), int)
    a[:, :2] = 3
    with pytest.raises(dental.WorkflowError):
        dental.segment_mandible(voxels(spark, *a), a.shape)
    with pytest.raises(dental.WorkflowError):
        dental.segment_mandible(voxels(spark, *(a * 0)), a.shape)


def test_whole_mandible(spark):
    a = np.zeros((6, 50, 120), int)
    for z in range(6):
        disc(a, z, 25, 16, 12, 220)
        disc(a, z, 25, 60, 16, 220)
        disc(a, z, 25, 100, 9, 220)
    got = dental.segment_mandible(voxels(spark, *a).repartition(4).cache(), a.shape)
    for part, low, high in (("incisor", 4, 28), ("bone", 44, 76), ("molars", 91, 109)):
        p = got[part].where("v > 0").toPandas()
        assert (p.x.min(), p.x.max()) == (low, high)


def test_whole_enamel_curve(spark):
    a = np.zeros((30, 44, 44), int)
    for z in range(30):
        disc(a, z, 22, 22, 18, 100)
        disc(a, z, 26, 22, 4 if 12 <= 29 - z < 18 else 12, 200)
        disc(a, z, 10, 22, 3, 60)
    rows = dental.enamel_curve(voxels(spark, *a).repartition(4).cache(), a.shape).orderBy("z").collect()
    assert [r.z for r in rows] == list(range(30)) and rows[15].slice_percentage == 0.5
    assert all(tuple(r)[3:] == (1.0, 1.0, 1.0) for r in rows[12:18])
    assert all(tuple(r)[4:] == (200.0, 441.0) for r in rows[18:]) and all(r.intensity_ratios < 1 for r in rows[:12])
