"""Composite workflows on jaw scans (DOM1-6, SEQ1-7, SET3): parts of a mandible, and enamel against dentin.

Every step is an operator of this package on (volume_id, z, y, x) rows, so all
volumes of a data set run as one job and results are keyed by slice.  Where
a volume-wide figure steers a step it is a row a volume and joined, never
collected.  Slices without a region keep their place: values are keyed by z.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamina.operators import filters, intensity, labeling, measure, morphology, sequence
from lamina.operators.blocks import Size
from lamina.operators.lineage import cut
from lamina.operators.segmentation import segment
from lamina.plans.volume import FRAME

#: Share of bone intensity below which voxels are background, and below which they are not bone.
BACKGROUND, BONE = 0.3, 0.8
#: Dentin's intensity times these bounds the band that is neither enamel nor background.
BAND = (0.85, 1.35)


class WorkflowError(ValueError):
    """A step of a workflow found nothing that the next one could use."""


def largest_component(mask: DataFrame, slab: int = 64) -> DataFrame:
    """Voxels of each volume's largest face-connected component; the first in raster order of equals."""
    labels = labeling.label_volume(mask, slab)
    size = labels.groupBy("volume_id", "label").agg(F.count("*").alias("n"))
    best = size.groupBy("volume_id").agg(F.max_by("label", F.struct(F.col("n"), -F.col("label"))).alias("label"))
    return labels.join(best, ["volume_id", "label"], "left_semi").select(*FRAME)


def bone_intensity(voxels: DataFrame, size: Size, half: int = 15, sigma: float = 10.0, min_area: int = 200) -> DataFrame:
    """Per volume, the least over its middle slices of the largest region's mean (SEQ6).

    The Gaussian reflects at the ends of the middle slices, which are a volume of their own to it.
    """
    depth, height, width = size
    start, end = max(0, depth // 2 - half), min(depth, depth // 2 + half)
    middle = intensity.slice_range(voxels, start, end, depth).withColumn("z", F.col("z") - start)
    smooth = filters.gaussian_3d(middle, (end - start, height, width), sigma)
    labels = segment(smooth, height, width, "otsu", min_area)
    best = measure.largest_region(labels.groupBy("volume_id", "z", "label").agg(F.count("*").alias("area"))).select("volume_id", "z", "label")
    means = smooth.join(labels.join(best, ["volume_id", "z", "label"], "left_semi"), FRAME).groupBy("volume_id", "z").agg(F.avg("v").alias("m"))
    return means.groupBy("volume_id").agg(F.min("m").alias("bone"))


def _follow(voxels: DataFrame, size: Size, growth: float | None, min_area: int) -> DataFrame:
    """Mask of the region followed through the slices, from the last one down."""
    labels = segment(voxels, size[1], size[2], "otsu", min_area)
    again = labeling.label_slices(labels.withColumnRenamed("label", "part"), 1, "part")
    kept = sequence.track(measure.regions(again, voxels), growth)
    return again.join(kept, ["volume_id", "z", "label"], "left_semi").select(*FRAME)


def segment_incisor(voxels: DataFrame, size: Size, slab: int = 64, min_area: int = 200) -> DataFrame:
    """Mask of the incisor: the region that is followed (SEQ1), closed, its largest component (DOM1)."""
    found = voxels.join(_follow(voxels, size, 2.0, min_area), FRAME, "left_semi")
    return largest_component(filters.binary_closing(found, size, True, slab), slab)


def segment_bone(voxels: DataFrame, size: Size, sigma: float = 1.0, min_area: int = 100, slab: int = 64) -> DataFrame:
    """Mask of the bone by following its centroid without a bound on growth (DOM2, SEQ2)."""
    smooth = filters.gaussian_3d(voxels, size, sigma, slab)
    return largest_component(filters.closing_3d(_follow(smooth, size, None, min_area), size, 1, slab), slab)


def segment_molar_bone(voxels: DataFrame, size: Size, slab: int = 64) -> tuple[DataFrame, DataFrame]:
    """(bone, molars): the largest component, and of the others those at least half the largest of them (DOM3)."""
    smooth = filters.gaussian_3d(voxels, size, 1.0, slab)
    mask = filters.closing_3d(segment(smooth, size[1], size[2], "otsu", 100).select(*FRAME), size, 1, slab)
    labels = labeling.label_volume(mask, slab)
    area = labels.groupBy("volume_id", "label").agg(F.count("*").alias("area"))
    rank = F.row_number().over(W.partitionBy("volume_id").orderBy(F.desc("area"), "label"))
    area = area.withColumn("rank", rank)
    bone = labels.join(area.where("rank = 1"), ["volume_id", "label"], "left_semi").select(*FRAME)
    molars = labels.join(measure.keep_half_max(area.where("rank > 1")), ["volume_id", "label"], "left_semi").select(*FRAME)
    return bone, molars


def segment_mandible(voxels: DataFrame, size: Size, slab: int = 64) -> dict[str, DataFrame]:
    """The cleaned volume and raw voxels of incisor, bone and molars (DOM4).

    Raises WorkflowError where a volume has no bone to take an intensity from.
    """
    normal = intensity.normalize(voxels, "minmax")
    bone_level = cut(bone_intensity(normal, size))
    missing = voxels.select("volume_id").distinct().join(bone_level.where("bone IS NOT NULL"), "volume_id", "left_anti")
    if not missing.isEmpty():
        raise WorkflowError("no bone in the middle slices of a volume")
    both = normal.join(bone_level, "volume_id")
    level = F.greatest(F.lit(-500.0), BACKGROUND * F.col("bone"))
    clean = both.withColumn("v", F.when(F.col("v") > level, F.col("v")).otherwise(0.0))
    clean = cut(clean)
    incisor = cut(segment_incisor(clean.drop("bone"), size, slab))
    dense = keep_bone(clean)
    near = filters.dilate_3d(incisor, size, 2, slab).withColumn("near", F.lit(True))
    rest = dense.join(near, FRAME, "left").withColumn("v", F.when(F.col("near"), 0.0).otherwise(F.col("v"))).drop("near")
    bone, molars = segment_molar_bone(cut(rest), size, slab)
    return {"clean": clean.drop("bone"), "incisor": measure.keep_mask(voxels, incisor), "bone": measure.keep_mask(voxels, bone), "molars": measure.keep_mask(voxels, molars)}


def keep_bone(voxels: DataFrame) -> DataFrame:
    """v where it is at least BONE times the column bone, else 0."""
    return voxels.withColumn("v", F.when(F.col("v") >= BONE * F.col("bone"), F.col("v")).otherwise(F.lit(0).cast(voxels.schema["v"].dataType))).drop("bone")


def trim_ends(voxels: DataFrame, min_area: int = 200) -> DataFrame:
    """Slices before the first and after the last whose first region is large enough become 0; none qualifies: no change."""
    area = labeling.label_slices(voxels.where("v > 0"), 1).groupBy("volume_id", "z", "label").agg(F.count("*").alias("area"))
    rows = voxels.join(sequence.end_trim(area, min_area), "volume_id", "left")
    outside = (F.col("z") < F.col("z_first")) | (F.col("z") > F.col("z_last"))
    return rows.withColumn("v", F.when(outside, F.lit(0).cast(voxels.schema["v"].dataType)).otherwise(F.col("v"))).drop("z_first", "z_last")


def dentin_ring(voxels: DataFrame, size: Size) -> DataFrame:
    """(volume_id, z_ring) from the first fifth of the slices; volumes without a drop are left out."""
    first = voxels.where((F.col("z") < int(size[0] * 0.2)) & (F.col("v") > 0)).select(*FRAME)
    labels = labeling.label_slices(labeling.fill_holes(first, size[1], size[2]), 1)
    return sequence.ring_slice(labels.groupBy("volume_id", "z", "label").agg(F.count("*").alias("area")))


def upper_threshold(voxels: DataFrame, bins: int = 512, by: tuple[str, ...] = ("volume_id",)) -> DataFrame:
    """The upper of two Otsu thresholds over equal bins, as a bin's centre; null where there are fewer than three levels."""
    rows = intensity.binned(voxels, bins, by)
    scale = rows.groupBy(*by).agg(F.first("low").alias("low"), F.first("width").alias("width"))
    found = intensity.multi_otsu(rows.select(*by, F.col("level").alias("v")), by)
    return scale.join(found, list(by), "left").select(*by, (F.col("low") + (F.col("t2") + 0.5) * F.col("width")).alias("upper"))


def tissues(region: DataFrame) -> DataFrame:
    """Positive voxels and whether they reach their volume's upper threshold (enamel) or not (dentin)."""
    both = region.join(upper_threshold(region), "volume_id").where("v > 0")
    return both.withColumn("bright", F.col("v") >= F.col("upper")).drop("upper")


def dentin_intensity(voxels: DataFrame, depths: DataFrame) -> DataFrame:
    """Per volume, the mean of the first 3-D component of dark voxels in the middle fifth (SEQ7); depths has (volume_id, depth)."""
    part = F.floor(F.col("depth") * 0.1)
    middle = voxels.join(depths, "volume_id").where((F.col("z") >= F.floor(F.col("depth") / 2) - part) & (F.col("z") < F.floor(F.col("depth") / 2) + part)).drop("depth")
    dark = middle.join(upper_threshold(middle), "volume_id").where("v > 0 AND v <= upper").drop("upper")
    labels = labeling.label_volume(dark.select(*FRAME))
    first = labels.groupBy("volume_id").agg(F.min("label").alias("label"))
    return dark.join(labels.join(first, ["volume_id", "label"], "left_semi"), FRAME).groupBy("volume_id").agg(F.avg("v").alias("dentin"))


def unknown_bounds(voxels: DataFrame, dentin: DataFrame, size: Size, limit: int = 100) -> DataFrame:
    """(volume_id, lower, upper): the slice where the enamel's area falls through limit, and where it rises through it again (SEQ5).

    Slices are true ones also where some hold no region; both bounds are null
    where there is no such fall or rise.  The state is that of a fold: the
    last area other than limit itself decides, and a later fall replaces an
    earlier one until the rise.
    """
    rows = voxels.join(dentin, "volume_id")
    mask = rows.where((F.col("v") > 0) & ((F.col("v") <= BAND[0] * F.col("dentin")) | (F.col("v") >= BAND[1] * F.col("dentin")))).select(*FRAME)
    labels = labeling.label_slices(morphology.erode(mask, size[1], size[2], morphology.disk(2), False), 1)
    area = labels.groupBy("volume_id", "z", "label").agg(F.count("*").alias("area")).groupBy("volume_id", "z").agg(F.max("area").alias("area"))
    before = F.lag("area").over(W.partitionBy("volume_id").orderBy("z"))
    steps = area.withColumn("before", before)
    rise = steps.where((F.col("before") < limit) & (F.col("area") > limit)).groupBy("volume_id").agg(F.min("z").alias("upper"))
    falls = steps.where((F.col("before") > limit) & (F.col("area") < limit)).join(rise, "volume_id", "left").where("upper IS NULL OR z < upper")
    fall = falls.groupBy("volume_id").agg(F.max("z").alias("lower"))
    return voxels.select("volume_id").distinct().join(fall, "volume_id", "left").join(rise, "volume_id", "left")


def _selected(mask: DataFrame, voxels: DataFrame, by: str) -> DataFrame:
    """(volume_id, z, area, mean) of each slice's region with the greatest ``by``, the lowest label of equals."""
    found = measure.regions(labeling.label_slices(mask, 1), voxels)
    best = F.max_by(F.struct("area", "mean_intensity"), F.struct(F.col(by), -F.col("label")))
    return found.groupBy("volume_id", "z").agg(best.alias("r")).select("volume_id", "z", F.col("r.area").alias("area"), F.col("r.mean_intensity").alias("mean"))


def _ratios(enamel: DataFrame, dentin: DataFrame) -> DataFrame:
    e, d = enamel.toDF("volume_id", "z", "enamel_area", "enamel_mean"), dentin.toDF("volume_id", "z", "dentin_area", "dentin_mean")
    return e.join(d, ["volume_id", "z"]).select("volume_id", "z", (F.col("enamel_mean") / F.col("dentin_mean")).alias("intensity_ratios"), F.col("enamel_mean").alias("intensity_intensities"), F.col("enamel_area").cast("double").alias("enamel_areas"))


def analyze_before(region: DataFrame, size: Size) -> DataFrame:
    """Slices before the unknown region: bright after equalisation is dentin, the rest, opened, enamel (DOM5a)."""
    equal = intensity.equalize(region, 512)
    both = region.join(equal.withColumnRenamed("v", "e"), FRAME).join(upper_threshold(equal, 512, ("volume_id", "z")), ["volume_id", "z"]).where("v > 0")
    dentin = both.where("e > upper").select(*FRAME)
    enamel = morphology.opening(both.where("NOT e > upper").select(*FRAME), size[1], size[2], morphology.disk(2))
    return _ratios(_selected(enamel, region, "cy"), _selected(dentin, region, "area"))


def analyze_after(region: DataFrame) -> DataFrame:
    """Slices after it: one threshold a volume parts enamel (bright) from dentin (DOM5b)."""
    both = tissues(region)
    return _ratios(_selected(both.where("bright").select(*FRAME), region, "area"), _selected(both.where("NOT bright").select(*FRAME), region, "area"))


def enamel_curve(voxels: DataFrame, size: Size, min_area: int = 200) -> DataFrame:
    """Per slice, from the other end of the tooth: enamel's intensity against dentin's, its intensity and area (DOM6).

    Slices of the unknown region have 1 in every column; slices of the others
    in which enamel or dentin isn't found have 1, 0 and 0.  A volume without
    bounds is an error of that workflow and has no rows.
    """
    depth = size[0]
    turned = cut(trim_ends(voxels, min_area).withColumn("z", (F.lit(depth - 1) - F.col("z")).cast("int")))
    ring = dentin_ring(turned, size)
    start = F.coalesce("z_ring", F.lit(0))
    cropped = turned.join(ring, "volume_id", "left").where(F.col("z") >= start).withColumn("z", (F.col("z") - start).cast("int")).drop("z_ring")
    slices = cropped.select("volume_id", "z").distinct()
    depths = slices.groupBy("volume_id").agg((F.max("z") + 1).alias("depth"))
    cropped = cut(cropped)
    # A row a volume each; written, as several branches below read them.
    dentin = cut(dentin_intensity(cropped, depths))
    bounds = cut(unknown_bounds(cropped, dentin, size).where("lower IS NOT NULL AND upper IS NOT NULL"))
    rows = cropped.join(bounds, "volume_id")
    found = cut(analyze_before(rows.where("z < lower").drop("lower", "upper"), size)).unionByName(analyze_after(rows.where("z >= upper").drop("lower", "upper")))
    numbered = sequence.slice_percentage(slices.join(bounds, "volume_id")).join(found, ["volume_id", "z"], "left")
    unknown = (F.col("z") >= F.col("lower")) & (F.col("z") < F.col("upper"))
    column = lambda c, none: F.when(unknown, 1.0).otherwise(F.coalesce(c, F.lit(none))).alias(c)
    return numbered.select("volume_id", "z", "slice_percentage", column("intensity_ratios", 1.0), column("intensity_intensities", 0.0), column("enamel_areas", 0.0))


def save_curve(curve: DataFrame, path: str) -> None:
    """The curve as CSV with a header, a folder a volume, in slice order within it."""
    curve.repartition("volume_id").sortWithinPartitions("volume_id", "z").write.mode("overwrite").option("header", True).partitionBy("volume_id").csv(path)
