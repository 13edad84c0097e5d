"""Operators along the slices of a volume (SEQ1-4, SEQ8-9, GEO5)."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def end_trim(area: DataFrame, min_area: int = 200) -> DataFrame:
    """First and last slice whose first label reaches min_area; null where none does (nothing is trimmed)."""
    hit = F.when((F.col("label") == 1) & (F.col("area") >= min_area), F.col("z"))
    return area.groupBy("volume_id").agg(F.min(hit).alias("z_first"), F.max(hit).alias("z_last"))


def ring_slice(area: DataFrame, share: float = 0.5) -> DataFrame:
    """From the last slice down, the slice before the first drop of label 1 below share of the one before."""
    first = area.where("label = 1")
    before = F.lag("area").over(W.partitionBy("volume_id").orderBy(F.desc("z")))
    drops = first.withColumn("before", before).where(F.col("area") < share * F.col("before"))
    return drops.groupBy("volume_id").agg((F.max("z") + 1).alias("z_ring"))


def track(regions: DataFrame, max_growth: float | None = 2.0) -> DataFrame:
    """Per volume, the region of each slice that follows the one kept before, from the last slice down.

    The first is the leftmost; then the nearest centroid.  A region over
    max_growth times the last kept area is skipped and leaves the state as it
    is.  State makes it a fold: per-slice arrays of regions (small) are folded
    in slice order inside one expression.
    """
    near = F.array_sort(F.collect_list(F.struct("cx", "cy", "label", "area")))
    slices = regions.groupBy("volume_id", "z").agg(near.alias("r"))
    ordered = slices.groupBy("volume_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("z", "r")))).alias("s"))
    growth = f"AND best.area > {max_growth} * acc.area" if max_growth else "AND false"
    fold = f"""aggregate(s,
      named_struct('cy', CAST(NULL AS DOUBLE), 'cx', CAST(NULL AS DOUBLE), 'area', CAST(NULL AS BIGINT), 'kept', CAST(array() AS ARRAY<STRUCT<z:INT,label:INT>>)),
      (acc, t) -> element_at(transform(array(
          IF(acc.area IS NULL, t.r[0], array_min(transform(t.r, q -> named_struct('d', (q.cy - acc.cy) * (q.cy - acc.cy) + (q.cx - acc.cx) * (q.cx - acc.cx), 'q', q))).q)),
        best -> IF(acc.area IS NOT NULL {growth}, acc,
          named_struct('cy', best.cy, 'cx', best.cx, 'area', best.area, 'kept', concat(acc.kept, array(named_struct('z', t.z, 'label', best.label)))))), 1),
      acc -> acc.kept)"""
    return ordered.select("volume_id", F.explode(F.expr(fold)).alias("k")).select("volume_id", "k.z", "k.label")


def slice_percentage(slices: DataFrame) -> DataFrame:
    """z over the number of slices: 0 up to, but not including, 1."""
    return slices.withColumn("slice_percentage", F.col("z") / F.count("*").over(W.partitionBy("volume_id")))


def local_frames(curve: DataFrame) -> DataFrame:
    """Unit tangent, normal and binormal along curve(volume_id, i, z, y, x); differences are central, one-sided at the ends."""
    w = W.partitionBy("volume_id").orderBy("i")

    def slope(c: str):
        after, before = F.lead(c).over(w), F.lag(c).over(w)
        return F.when(before.isNull(), after - F.col(c)).when(after.isNull(), F.col(c) - before).otherwise((after - before) / 2)

    t = curve.select("volume_id", "i", *[slope(c).alias(f"t{c}") for c in "zyx"])
    size = F.sqrt(F.col("tz") * F.col("tz") + F.col("ty") * F.col("ty") + F.col("tx") * F.col("tx"))
    t = t.select("volume_id", "i", *[(F.col(f"t{c}") / size).alias(f"t{c}") for c in "zyx"])
    # tangent x (0, 0, 1) in (z, y, x) order is (ty, -tz, 0)
    flat = F.sqrt(F.col("ty") * F.col("ty") + F.col("tz") * F.col("tz"))
    n = t.select("*", *[F.when(flat < 1e-5, F.lit(d)).otherwise(v / flat).alias(k) for k, d, v in (("nz", 1.0, F.col("ty")), ("ny", 0.0, -F.col("tz")), ("nx", 0.0, F.lit(0.0)))])
    return n.select("*", F.expr("ty * nx - tx * ny AS bz"), F.expr("tx * nz - tz * nx AS by"), F.expr("tz * ny - ty * nz AS bx"))
