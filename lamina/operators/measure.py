"""Region measurement and its roll-ups (MEA1-9, PRJ1, JON1-3, VIZ2)."""

from collections.abc import Callable

import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamina.kernels import shape
from lamina.operators.lineage import beside

KEY = ["volume_id", "z", "label"]
VOXEL = ["volume_id", "z", "y", "x"]


def _ratio(a: Column, b: Column) -> Column:
    """a / b, infinite where b is 0."""
    return F.when(b == 0, F.lit(float("inf"))).otherwise(a / b)


def regions(labels: DataFrame, voxels: DataFrame) -> DataFrame:
    """Area, centroid, bounding box, intensities and second moments of every region."""
    v, y, x = (F.col(c).cast("double") for c in ("v", "y", "x"))
    rows = labels.join(voxels, VOXEL).groupBy(*KEY).agg(
        F.count("*").alias("area"), F.avg(y).alias("cy"), F.avg(x).alias("cx"),
        F.avg(v).alias("mean_intensity"), F.min("v").alias("min_intensity"), F.max("v").alias("max_intensity"), F.stddev_pop(v).alias("std_intensity"),
        F.min("y").alias("y0"), F.min("x").alias("x0"), (F.max("y") + 1).alias("y1"), (F.max("x") + 1).alias("x1"),
        F.var_pop(y).alias("myy"), F.var_pop(x).alias("mxx"), F.covar_pop(y, x).alias("myx"),
    )
    half, gap = (F.col("myy") + F.col("mxx")) / 2, F.sqrt(F.pow(F.col("myy") - F.col("mxx"), 2) / 4 + F.pow("myx", 2))
    long, short = half + gap, F.greatest(half - gap, F.lit(0.0))
    return rows.withColumns({
        "major_axis": 4 * F.sqrt(long), "minor_axis": 4 * F.sqrt(short),
        "eccentricity": F.when(long > 0, F.sqrt(F.greatest(F.lit(0.0), 1 - short / long))).otherwise(F.lit(0.0)),
    }).drop("myy", "mxx", "myx")


#: Properties that need a region's pixels, by name.
SHAPES: dict[str, Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], float]] = {
    "perimeter": lambda y, x, mask, values: shape.perimeter(mask),
    "solidity": lambda y, x, mask, values: len(y) / shape.convex_area(mask),
    "orientation": lambda y, x, mask, values: shape.orientation(y, x),
}
DEFAULT = ("label", "area", "centroid", "mean_intensity")


def shapes(labels: DataFrame, voxels: DataFrame, names: list[str], extra: dict[str, Callable] | None = None) -> DataFrame:
    """KEY and a column of doubles for each name: those of SHAPES, and extra(mask, intensity) of each region's bounding box.

    A slice is one task's; intensity is 0 outside the region.
    """
    own = extra or {}

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for label, part in rows.groupby("label"):
            y, x = part["y"].to_numpy(np.int64), part["x"].to_numpy(np.int64)
            mask = np.zeros((y.max() - y.min() + 1, x.max() - x.min() + 1), bool)
            values = np.zeros(mask.shape, part["v"].to_numpy().dtype)
            mask[y - y.min(), x - x.min()] = True
            values[y - y.min(), x - x.min()] = part["v"]
            out.append((key[0], key[1], label, *(float(own[n](mask, values)) if n in own else SHAPES[n](y, x, mask, values) for n in names)))
        return pd.DataFrame(out, columns=[*KEY, *names])

    rows = labels.join(voxels, VOXEL).select(*VOXEL, "label", "v")
    return rows.groupBy("volume_id", "z").applyInPandas(run, "volume_id string, z int, label int" + "".join(f", `{n}` double" for n in names))


def measure_regions(labels: DataFrame, voxels: DataFrame, properties: tuple[str, ...] = DEFAULT, extra: dict[str, Callable] | None = None) -> DataFrame:
    """volume_id, z and the properties asked for of every region; a name that nothing is known of is a null column.

    extra has functions (mask, intensity) -> number by name; one is computed if
    its name is among the properties.
    """
    found = regions(labels, voxels).withColumns({"centroid": F.array("cy", "cx"), "bbox": F.array("y0", "x0", "y1", "x1")})
    kernel = [n for n in properties if n in SHAPES or n in (extra or {})]
    if kernel:
        found = found.drop(*kernel).join(shapes(labels, voxels, kernel, extra), KEY)
    return found.select("volume_id", "z", *[F.col(n) if n in found.columns else F.lit(None).cast("double").alias(n) for n in properties])


def slice_summary(measured: DataFrame) -> DataFrame:
    """Ten figures of each slice's regions; means and deviations are over regions."""
    area, mean = F.col("area").cast("double"), F.col("mean_intensity")
    return measured.groupBy("volume_id", "z").agg(
        F.count("*").alias("num_regions"), F.sum("area").alias("total_area"), F.avg(area).alias("mean_area"), F.stddev_pop(area).alias("std_area"),
        F.avg(mean).alias("mean_intensity"), F.stddev_pop(mean).alias("std_intensity"), F.max("area").alias("max_area"), F.min("area").alias("min_area"),
        F.max(mean).alias("max_intensity"), F.min(mean).alias("min_intensity"),
    )


def segmentation_stats(labels: DataFrame, slices: DataFrame) -> DataFrame:
    """Areas of each slice's regions; slices without regions have zeros."""
    area = labels.groupBy(*KEY).agg(F.count("*").alias("area"))
    stats = area.groupBy("volume_id", "z").agg(
        F.count("*").alias("num_regions"), F.sum("area").alias("total_area"), F.avg(F.col("area").cast("double")).alias("mean_area"),
        F.max("area").alias("max_area"), F.min("area").alias("min_area"), F.stddev_pop(F.col("area").cast("double")).alias("std_area"),
    )
    return slices.join(stats, ["volume_id", "z"], "left").na.fill(0)


def filter_by_area(labels: DataFrame, min_area: int = 100, max_area: int | None = None) -> DataFrame:
    """Voxels of regions within the bounds, ids kept; a max_area of None or 0 is no limit."""
    size = labels.groupBy(*KEY).agg(F.count("*").alias("n")).where((F.col("n") >= min_area) & (F.lit(not max_area) | (F.col("n") <= (max_area or 0))))
    return labels.join(size.drop("n"), KEY, "left_semi")


def largest_region(area: DataFrame) -> DataFrame:
    """Label of each slice's largest region, the lowest of equals."""
    return area.groupBy("volume_id", "z").agg(F.max_by("label", F.struct(F.col("area"), -F.col("label"))).alias("label"), F.max("area").alias("area"))


def region_intensity(labels: DataFrame, voxels: DataFrame, label: int) -> DataFrame:
    """Mean intensity of that label in each slice of voxels, 0 where it is missing."""
    v = F.when(F.col("label") == label, F.col("v").cast("double"))
    return voxels.join(labels, VOXEL, "left").groupBy("volume_id", "z").agg(F.coalesce(F.avg(v), F.lit(0.0)).alias("intensity"))


def top_regions(area: DataFrame, n: int = 5) -> DataFrame:
    """The n largest regions of each slice with their rank; equals by label."""
    rank = F.row_number().over(W.partitionBy("volume_id", "z").orderBy(F.desc("area"), "label"))
    return area.withColumn("rank", rank).where(F.col("rank") <= n)


def _compared(ranked: DataFrame, first: int, second: int) -> DataFrame:
    """Differences and ratios of the regions of those ranks in each slice; slices without one of them are left out."""
    shape_of = [c for c in ("eccentricity", "solidity") if c in ranked.columns]
    cell = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    both = ranked.where(F.col("rank").isin(first, second)).groupBy("volume_id", "z").agg(
        *[cell(k, c).alias(f"{c}_{i}") for c in ("label", "area", "mean_intensity", *shape_of) for i, k in ((1, first), (2, second))]
    )
    return both.where("label_1 IS NOT NULL AND label_2 IS NOT NULL").withColumns({
        "area_difference": F.col("area_1") - F.col("area_2"), "area_ratio": _ratio(F.col("area_1").cast("double"), F.col("area_2").cast("double")),
        "intensity_difference": F.col("mean_intensity_1") - F.col("mean_intensity_2"), "intensity_ratio": _ratio(F.col("mean_intensity_1"), F.col("mean_intensity_2")),
    })


def compare_top_two(measured: DataFrame) -> DataFrame:
    """The comparison of each slice's two largest regions (none where there is one)."""
    return _compared(top_regions(measured.select(*KEY, "area", "mean_intensity"), 2), 1, 2)


def compare_regions(measured: DataFrame, indices: tuple[int, ...] = (0, 1)) -> DataFrame:
    """The comparison of two regions by their place (from 0) among the slice's labels, with eccentricity and solidity where measured.

    A slice that lacks one of them has no row; anything but two places from 0
    on is an error.
    """
    if len(indices) != 2 or min(indices) < 0:
        raise ValueError(f"two places from 0 on are needed: {indices}")
    rank = F.row_number().over(W.partitionBy("volume_id", "z").orderBy("label")) - 1
    return _compared(measured.withColumn("rank", rank), *indices)


def cross_slice_stats(measured: DataFrame, n_slices: int) -> DataFrame:
    """Roll-up over regions of all slices; means are over regions, not pixels."""
    area = F.col("area").cast("double")
    return measured.groupBy("volume_id").agg(
        F.count("*").alias("total_regions"), (F.count("*") / F.lit(n_slices)).alias("regions_per_slice"),
        F.avg(area).alias("mean_area"), F.stddev_pop(area).alias("std_area"), F.min("area").alias("min_area"), F.max("area").alias("max_area"),
        F.avg("mean_intensity").alias("mean_of_means"), F.stddev_pop("mean_intensity").alias("std_of_means"),
    )


def keep_mask(voxels: DataFrame, mask: DataFrame) -> DataFrame:
    return voxels.join(mask, VOXEL, "left_semi")


def remove_mask(voxels: DataFrame, mask: DataFrame) -> DataFrame:
    return voxels.join(mask, VOXEL, "left_anti")


def keep_half_max(area: DataFrame) -> DataFrame:
    """Regions of at least half the volume's largest area."""
    return area.withColumn("most", F.max("area").over(W.partitionBy("volume_id"))).where(F.col("area") >= 0.5 * F.col("most")).drop("most")


def bounding_box(mask: DataFrame) -> DataFrame:
    """Half-open bounds per volume."""
    return mask.groupBy("volume_id").agg(*[f for c in "zyx" for f in (F.min(c).alias(f"{c}min"), (F.max(c) + 1).alias(f"{c}max"))])


def crop(voxels: DataFrame, box: DataFrame) -> DataFrame:
    """Voxels within the box, coordinates from its corner."""
    rows = beside(voxels, box, ["volume_id"])
    inside = [(F.col(c) >= F.col(f"{c}min")) & (F.col(c) < F.col(f"{c}max")) for c in "zyx"]
    return rows.where(inside[0] & inside[1] & inside[2]).select("volume_id", *[(F.col(c) - F.col(f"{c}min")).alias(c) for c in "zyx"], "v")
