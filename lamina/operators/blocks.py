"""Dense kernels over slices and slabs of a relational volume.

A slab is ``slab`` slices with ``halo`` more on both sides, cut at the ends of
the volume; a kernel's result counts for the inner slices only.  So a kernel
that looks no further than the halo gives the same voxels for any slab, and
the ends of the array that matter are the ends of the volume.  One task holds
one slab: (slab + 2 halo) slices.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Size = tuple[int, int, int]
Kernel = Callable[[np.ndarray], np.ndarray]
MASK = "volume_id string, z int, y int, x int"


def per_slab(rows: DataFrame, kernel: Kernel, size: Size, slab: int = 64, halo: int = 0, value: str | None = "v", out: str | None = "v double") -> DataFrame:
    """kernel(array[z, y, x]) on every slab; value None reads a mask, out None writes one.

    Voxels absent from rows read as 0 or false.  out names the result column
    and its type; labels (int) leave background out.
    """
    depth, height, width = size
    last = (depth - 1) // slab
    name, kind = out.split() if out else (None, None)

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        volume, s = key
        low, high = max(0, s * slab - halo), min(depth, (s + 1) * slab + halo)
        whole = value is not None and pd.api.types.is_integer_dtype(part[value])
        a = np.zeros((high - low, height, width), bool if value is None else np.int64 if whole else float)
        a[part["z"] - low, part["y"], part["x"]] = True if value is None else part[value]
        got = kernel(a)[s * slab - low : min(depth, (s + 1) * slab) - low]
        z, y, x = np.nonzero(got) if kind in (None, "int") else np.unravel_index(np.arange(got.size), got.shape)
        frame = {"volume_id": volume, "z": (z + s * slab).astype(np.int32), "y": y.astype(np.int32), "x": x.astype(np.int32)}
        if name:
            frame[name] = got[z, y, x].astype(np.int32 if kind == "int" else float)
        return pd.DataFrame(frame)

    first, to = F.greatest(F.lit(0), F.floor((F.col("z") - halo) / slab)), F.least(F.lit(last), F.floor((F.col("z") + halo) / slab))
    slim = rows.select("volume_id", "z", "y", "x", *([value] if value else []))
    slabs = slim.withColumn("__slab", F.explode(F.sequence(first.cast("int"), to.cast("int"))))
    return slabs.groupBy("volume_id", "__slab").applyInPandas(run, MASK + (f", {out}" if out else ""))


def per_slice(rows: DataFrame, kernel: Kernel, height: int, width: int, value: str | None = "v", out: str | None = "v double") -> DataFrame:
    """kernel(array[y, x]) on every slice that has rows."""
    kind = (out or " ").split(" ")[1]

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        whole = value is not None and pd.api.types.is_integer_dtype(part[value])
        a = np.zeros((height, width), bool if value is None else np.int64 if whole else float)
        a[part["y"], part["x"]] = True if value is None else part[value]
        got = kernel(a)
        y, x = np.nonzero(got) if kind in ("", "int") else np.unravel_index(np.arange(got.size), got.shape)
        frame = {"volume_id": key[0], "z": np.int32(key[1]), "y": y.astype(np.int32), "x": x.astype(np.int32)}
        if out:
            frame[out.split()[0]] = got[y, x].astype(np.int32 if kind == "int" else float)
        return pd.DataFrame(frame)

    slim = rows.select("volume_id", "z", "y", "x", *([value] if value else []))
    return slim.groupBy("volume_id", "z").applyInPandas(run, MASK + (f", {out}" if out else ""))
