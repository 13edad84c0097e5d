"""The command lines of the jaw workflows, and TIFF files of other writers."""

import struct

import numpy as np
import pandas as pd
import pytest

from lamina.plans import jaw
from lamina.sources import sinks, tiff
from tests.test_blocks import tube
from tests.test_operators import voxels


def test_reslice_and_skip(spark, tmp_path):
    a = tube()
    parts, planes = str(tmp_path / "parts"), str(tmp_path / "planes")
    sinks.save_tiff(voxels(spark, *a), parts, jaw.PARTS["incisor"], *a.shape[1:]).collect()
    sinks.save_tiff(voxels(spark, *a), parts, jaw.PARTS["bone"], *a.shape[1:]).collect()
    assert jaw.made(spark, parts, jaw.PARTS["incisor"]) == {"a"} and jaw.made(spark, planes, jaw.PLANES) == set()
    assert jaw.reslice(spark, parts, planes, 9, 1.0) == ["a"]
    pages = list(tiff.read((tmp_path / "planes" / "a" / jaw.PLANES).read_bytes()))
    assert len(pages) >= 12 and pages[0].shape == (9, 9) and pages[len(pages) // 2].max() > 90
    assert jaw.reslice(spark, parts, planes, 9, 1.0) == []


def test_curve_files(spark, tmp_path):
    rows = pd.DataFrame({"volume_id": ["a", "a", "b"], "slice_percentage": [0.5, 0.0, 0.0], "enamel_areas": [1.0, 2.0, 3.0]})
    sinks.save_csv(spark.createDataFrame(rows), str(tmp_path), "{volume}_results.csv", "slice_percentage").collect()
    assert jaw.made(spark, str(tmp_path), "{volume}_results.csv") == {"a", "b"}
    assert (tmp_path / "a" / "a_results.csv").read_text().split() == ["slice_percentage,enamel_areas", "0.0,2.0", "0.5,1.0"]


def test_arguments():
    a = jaw.arguments(["reslice", "in", "out", "--slice_size", "32"])
    assert (a.stage, a.slice_size, a.spacing, a.log) == ("reslice", 32, 1.0, False)
    with pytest.raises(SystemExit):
        jaw.arguments(["other", "in", "out"])
    assert jaw.main(["enamel", "/nowhere/at/all", "/tmp/none"]) == 1


def page(body, a, how, predictor):
    """A classic little-endian file of one page."""
    fields = [(256, a.shape[1]), (257, a.shape[0]), (258, a.itemsize * 8), (259, how), (273, 8), (277, 1), (279, len(body)), (317, predictor), (339, 3 if a.dtype.kind == "f" else 1)]
    at = 8 + len(body)
    entries = b"".join(struct.pack("<HHII", tag, 4, 1, v) for tag, v in fields)
    return struct.pack("<2sHI", b"II", 42, at) + body + struct.pack("<H", len(fields)) + entries + struct.pack("<I", 0)


def lzw(data):
    """A writer of TIFF's LZW."""
    codes, table, word, width, out = [(256, 9)], {bytes([k]): k for k in range(256)}, b"", 9, ""
    size = 258
    for k in data:
        if word + bytes([k]) in table:
            word += bytes([k])
            continue
        codes.append((table[word], width))
        table[word + bytes([k])] = size
        size += 1
        width = max(9, size.bit_length())
        if size == 4094:
            codes.append((256, width))
            table, size, width = {bytes([k]): k for k in range(256)}, 258, 9
        word = bytes([k])
    codes += [(table[word], width), (257, width)]
    out = "".join(format(c, f"0{w}b") for c, w in codes)
    out += "0" * (-len(out) % 8)
    return bytes(int(out[i : i + 8], 2) for i in range(0, len(out), 8))


def test_other_writers():
    r = np.random.default_rng(4)
    a = np.cumsum(r.integers(0, 3, (90, 70)), axis=1).astype(np.uint8)
    assert tiff.unpack_lzw(lzw(a.tobytes())) == a.tobytes()
    (got,) = tiff.read(page(lzw(a.tobytes()), a, 5, 1))
    assert (got == a).all()
    steps = np.diff(a, axis=1, prepend=np.uint8(0)).astype(np.uint8)
    (got,) = tiff.read(page(lzw(steps.tobytes()), a, 5, 2))
    assert (got == a).all()
    assert tiff.unpack_bits(b"\x02abc\xfex\x80\x00y") == b"abcxxxy"
    f = r.normal(size=(5, 7)).astype(np.float32)
    planes = f.astype(">f4").view(np.uint8).reshape(5, 7, 4).swapaxes(1, 2).reshape(5, 28)
    coded = np.diff(planes, axis=1, prepend=np.uint8(0)).astype(np.uint8)
    (got,) = tiff.read(page(coded.tobytes(), f, 1, 3))
    assert (got == f).all()
    with pytest.raises(ValueError):
        list(tiff.read(page(b"", a, 7, 1)))
