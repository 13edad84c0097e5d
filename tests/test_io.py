"""Sources, sinks, the analyzer and its command line."""

import io
import json
import struct
import zipfile

import numpy as np
import pandas as pd
import pytest

from lamina.plans import analyzer
from lamina.sources import images, sinks, tiff
from tests.test_operators import smoke, voxels


def bmp(path, a):
    """An 8-bit grey palette bitmap, or a 24-bit one for (h, w, 3) RGB."""
    h, w = a.shape[:2]
    bits, palette = (8, b"".join(bytes((k, k, k, 0)) for k in range(256))) if a.ndim == 2 else (24, b"")
    rows = a.astype(np.uint8) if a.ndim == 2 else a.astype(np.uint8)[..., ::-1]
    body = b"".join(r.tobytes() + b"\0" * (-len(r.tobytes()) % 4) for r in rows[::-1])
    head = struct.pack("<IiiHHIIiiII", 40, w, h, 1, bits, 0, len(body), 2835, 2835, len(palette) // 4, 0)
    start = 14 + len(head) + len(palette)
    path.write_bytes(struct.pack("<2sIHHI", b"BM", start + len(body), 0, 0, start) + head + palette + body)


@pytest.fixture(scope="module")
def stack(tmp_path_factory):
    folder = tmp_path_factory.mktemp("stack")
    for k in range(5):
        bmp(folder / f"test_slice_{k:03d}.bmp", smoke())
    bmp(folder / "over_spr.bmp", smoke())
    return str(folder)


def test_stack_is_read_in_order(spark, stack, tmp_path):
    got = images.scanner_stack(spark, stack)
    assert got.agg({"z": "max"}).first()[0] == 4
    a = np.zeros((5, 64, 64), int)
    p = got.toPandas()
    a[p.z, p.y, p.x] = p.v
    assert (a == smoke()).all()
    for k, n in ((0, "s10.bmp"), (1, "s9.bmp")):
        bmp(tmp_path / n, np.full((3, 5), k))
    first = lambda by: images.image_stack(spark, str(tmp_path), sort_by=by).where("z = 0").first().v
    assert first("name") == 0 and first("number") == 1
    assert images.image_stack(spark, str(tmp_path), sort_by="date").count() == 30
    with pytest.raises(ValueError):
        images.image_stack(spark, str(tmp_path), sort_by="other")


def test_colour_shape_and_missing(spark, tmp_path):
    bmp(tmp_path / "a.bmp", np.dstack([np.full((2, 2), c) for c in (100, 50, 200)]))
    assert images.single_image(spark, f"{tmp_path}/a.bmp").first().v == 82
    bmp(tmp_path / "b.bmp", np.zeros((3, 3)))
    with pytest.raises(ValueError):
        images.slices(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        images.slices(spark, str(tmp_path), pattern="*.png")
    with pytest.raises(FileNotFoundError):
        images.slices(spark, f"{tmp_path}/none")


def test_folders_are_volumes(spark, tmp_path):
    for name in ("one", "two", "Compressed"):
        (tmp_path / name).mkdir()
        bmp(tmp_path / name / "x.bmp", np.zeros((2, 2)))
    got = images.slices(spark, str(tmp_path), nested=True)
    assert sorted(r.volume_id for r in got.collect()) == ["one", "two"]


@pytest.mark.parametrize("kind", [np.int16, np.float32, np.float64, np.uint8])
def test_tiff_round_trip(kind):
    a = (np.random.default_rng(7).random((3, 4, 5)) * 200).astype(kind)
    out = io.BytesIO()
    tiff.write(out, a)
    got = list(tiff.read(out.getvalue()))
    assert len(got) == 3 and all((g == tiff.narrowed(p)).all() and g.dtype == tiff.narrowed(p).dtype for g, p in zip(got, a))
    with pytest.raises(ValueError):
        list(tiff.read(b"nothing at all"))


def test_tiff_through_spark(spark, tmp_path):
    v = voxels(spark, [[1, 2], [3, 4]], [[5, 6], [7, 8]])
    assert sinks.save_tiff(v, str(tmp_path), "volume.tif", 2, 2).first().slices == 2
    back = images.tiff_stack(spark, f"{tmp_path}/*/volume.tif")
    assert sorted((r.volume_id, r.z, r.y, r.x, r.v) for r in back.collect()) == sorted(map(tuple, v.collect()))


def test_analyzer(spark, stack, tmp_path):
    job = analyzer.Analyzer(min_area=10, normalize=False)
    found = job.run(spark, stack, (0, 3), exclude="*spr.bmp")
    s = found["region_analysis"]["cross_slice_stats"]
    assert (s["total_slices_analyzed"], s["total_regions"], s["mean_regions_per_slice"]) == (3, 6, 2.0)
    assert s["area_stats"] == {"mean": 422.0, "std": 19.0, "min": 403.0, "max": 441.0}
    assert len(found["segmentation_stats"]) == 5
    job.save(f"{tmp_path}/deep/out.json")
    assert json.load(open(f"{tmp_path}/deep/out.json"))["volume_info"]["shape"] == [5, 64, 64]
    job.save(f"{tmp_path}/out.csv")
    assert pd.read_csv(f"{tmp_path}/out.csv")["area_stats.mean"][0] == 422
    job.save(f"{tmp_path}/out.xlsx")
    with zipfile.ZipFile(f"{tmp_path}/out.xlsx") as z:
        assert z.read("xl/workbook.xml").count(b"<sheet ") == 3
    assert "Regions: 10" in job.report() and sinks.report({}) == "No analysis results available."
    with pytest.raises(ValueError):
        job.save("x", "other")
    with pytest.raises(ValueError):
        analyzer.Analyzer().segment()
    with pytest.raises(IndexError):
        job.regions((0, 99))


def test_volume_at_hand_and_plots(spark):
    v = voxels(spark, smoke()).cache()
    found = analyzer.analyze_volume(v, "manual", 10, threshold=120)
    assert found["segmentation_stats"][0]["num_regions"] == 2
    job = analyzer.Analyzer(v, min_area=10)
    job.segment()
    regions = job.regions()
    assert analyzer.region_plots(regions)["areas"].agg({"cnt": "sum"}).first()[0] == 2
    assert analyzer.comparison_plots(regions).count() == 1
    assert analyzer.slice_overlay(v, job.labels, 0).where("label > 0").count() == 844
    none = analyzer.analyze_volume(v, "manual", threshold=999)["region_analysis"]["cross_slice_stats"]
    assert none["total_regions"] == 0 and np.isnan(none["area_stats"]["mean"])


def test_command_line(stack, tmp_path, spark):
    args = [stack, "-o", f"{tmp_path}/r.json", "--min-area", "10", "--no-normalize", "--slice-range", "0", "2", "--summary-report", "--save-plots", f"{tmp_path}/plots"]
    assert analyzer.main(args) == 0
    assert (tmp_path / "r.json").exists() and (tmp_path / "plots" / "areas").exists()
    assert analyzer.main([f"{tmp_path}/none", "-o", f"{tmp_path}/q.json"]) == 1
