"""Volume statistics, normalisation and point operators (AGG1, NRM1-5, PNT1, PRD2-5)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lamina.operators.lineage import beside

BY = ["volume_id"]


def _with_stats(voxels: DataFrame, **stats: Column) -> DataFrame:
    """voxels beside their volume's statistics."""
    return beside(voxels, voxels.groupBy(*BY).agg(*[c.alias(k) for k, c in stats.items()]), BY)


def volume_info(voxels: DataFrame) -> DataFrame:
    """Shape, extremes, mean and population deviation of each volume."""
    v = F.col("v").cast("double")
    size = [(F.max(c) + 1).cast("bigint").alias(n) for c, n in (("z", "depth"), ("y", "height"), ("x", "width"))]
    return voxels.groupBy(*BY).agg(*size, F.min("v").alias("min_v"), F.max("v").alias("max_v"), F.avg(v).alias("mean_v"), F.stddev_pop(v).alias("std_v"))


def normalize(voxels: DataFrame, method: str = "minmax", bins: int = 256) -> DataFrame:
    """voxels with v in [0, 1] (minmax, histogram) or as z-scores; a constant volume gives NaN."""
    v = F.col("v").cast("double")
    nan = F.lit(float("nan"))
    if method == "minmax":
        rows = _with_stats(voxels, lo=F.min(v), hi=F.max(v))
        out = F.when(F.col("hi") > F.col("lo"), (v - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(nan)
        return rows.withColumn("v", out).drop("lo", "hi")
    if method == "zscore":
        rows = _with_stats(voxels, mu=F.avg(v), sd=F.stddev_pop(v))
        return rows.withColumn("v", F.when(F.col("sd") > 0, (v - F.col("mu")) / F.col("sd")).otherwise(nan)).drop("mu", "sd")
    if method == "histogram":
        return equalize(voxels, bins)
    raise ValueError(f"unknown normalisation: {method}")


def histogram(voxels: DataFrame, bins: int, by: tuple[str, ...] = ("volume_id",)) -> DataFrame:
    """bin, centre and cnt of equal-width bins over each group's range, empty bins included; the last is closed."""
    v = F.col("v").cast("double")
    span = voxels.groupBy(*by).agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width > 0, F.least(F.floor((v - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    counts = beside(voxels, span, list(by)).groupBy(*by, at.alias("bin")).agg(F.count("*").alias("cnt"))
    every = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = every.join(counts, [*by, "bin"], "left")
    return full.select(*by, "bin", (F.col("lo") + (F.col("bin") + 0.5) * width).alias("centre"), F.coalesce("cnt", F.lit(0)).cast("bigint").alias("cnt"))


def equalize(voxels: DataFrame, bins: int = 256) -> DataFrame:
    """Histogram equalisation: the cumulative share, linear between bin centres and flat outside them."""
    h = histogram(voxels, bins)
    run = W.partitionBy(*BY).orderBy("bin")
    total = F.sum("cnt").over(W.partitionBy(*BY))
    cdf = h.withColumn("c", F.sum("cnt").over(run) / total)
    cdf = cdf.withColumn("c1", F.lead("c").over(run)).withColumn("next", F.lead("centre").over(run))
    v = F.col("v").cast("double")
    rows = _with_stats(voxels, lo=F.min(v), hi=F.max(v))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width > 0, F.greatest(F.lit(0), F.least(F.floor((v - F.col("lo")) / width - 0.5), F.lit(bins - 1)))).otherwise(F.lit(0)).cast("int")
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - F.col("centre")) / (F.col("next") - F.col("centre"))))
    out = F.when(F.col("next").isNull() | (F.col("next") <= F.col("centre")), F.col("c")).otherwise(F.col("c") + (F.col("c1") - F.col("c")) * part)
    return beside(rows.withColumn("bin", at), cdf, [*BY, "bin"]).select(*voxels.drop("v").columns, out.alias("v"))


def background_subtract(voxels: DataFrame) -> DataFrame:
    return _with_stats(voxels, lo=F.min("v")).withColumn("v", F.col("v") - F.col("lo")).drop("lo")


def adjust_gamma(voxels: DataFrame, gamma: float = 1.0, scale: float = 255.0) -> DataFrame:
    """scale * (v / scale) ** gamma; scale is the range of the values' type."""
    return voxels.withColumn("v", F.pow(F.col("v") / F.lit(scale), F.lit(gamma)) * scale)


def band(voxels: DataFrame, low: float, high: float) -> DataFrame:
    """Positive voxels outside the open band (PRD2)."""
    return voxels.where((F.col("v") > 0) & ((F.col("v") <= low) | (F.col("v") >= high)))


def clamp(voxels: DataFrame, mean: float) -> DataFrame:
    """v where above max(-500, 0.3 mean), else 0 (PRD3)."""
    return voxels.withColumn("v", F.when(F.col("v") > max(-500.0, 0.3 * mean), F.col("v")).otherwise(0))


def slice_range(rows: DataFrame, start: int, end: int, depth: int) -> DataFrame:
    """Rows of slices start <= z < end; bounds outside the volume are an error (PRD6)."""
    if not 0 <= start <= end <= depth:
        raise IndexError(f"slice range {start}..{end} of {depth} slices")
    return rows.where((F.col("z") >= start) & (F.col("z") < end))


def binned(voxels: DataFrame, bins: int, by: tuple[str, ...] = ("volume_id",)) -> DataFrame:
    """voxels with ``level``, the bin of v, and ``low`` and ``width`` to turn a bin back into a value."""
    v = F.col("v").cast("double")
    span = voxels.groupBy(*by).agg(F.min(v).alias("low"), ((F.max(v) - F.min(v)) / bins).alias("width"))
    level = F.when(F.col("width") > 0, F.least(F.floor((v - F.col("low")) / F.col("width")), F.lit(bins - 1))).otherwise(0)
    return beside(voxels, span, list(by)).withColumn("level", level.cast("int"))


def _levels(voxels: DataFrame, by: tuple[str, ...], bins: int) -> DataFrame:
    """k, value and count of the levels of a group: one a value of integers, else one of equal bins, whose value is its centre."""
    if isinstance(voxels.schema["v"].dataType, IntegralType):
        return voxels.groupBy(*by, F.col("v").cast("bigint").alias("k")).agg(F.count("*").alias("c")).withColumn("value", F.col("k"))
    value = F.when(F.col("width") > 0, F.col("low") + (F.col("level") + 0.5) * F.col("width")).otherwise(F.col("low"))
    return binned(voxels, bins, by).groupBy(*by, F.col("level").cast("bigint").alias("k"), value.alias("value")).agg(F.count("*").alias("c"))


def _moments(voxels: DataFrame, by: tuple[str, ...], bins: int) -> DataFrame:
    """Levels with the count and sum of values up to each (n0, s0) and of all (n, s)."""
    run, whole = W.partitionBy(*by).orderBy("k"), W.partitionBy(*by)
    part = F.col("c") * F.col("value")
    return _levels(voxels, by, bins).select(*by, "k", "value", F.sum("c").over(run).alias("n0"), F.sum(part).over(run).alias("s0"), F.sum("c").over(whole).alias("n"), F.sum(part).over(whole).alias("s"))


def otsu(voxels: DataFrame, by: tuple[str, ...] = ("volume_id", "z"), bins: int = 256) -> DataFrame:
    """Otsu's threshold, one level a value of integers and ``bins`` equal bins else; the first of equal maxima, a constant's own value."""
    levels = _moments(voxels, by, bins)
    n0, n1 = F.col("n0").cast("double"), (F.col("n") - F.col("n0")).cast("double")
    apart = F.col("s0") / n0 - F.when(n1 > 0, (F.col("s") - F.col("s0")) / n1)
    score = F.round(F.coalesce(n0 * n1 * apart * apart, F.lit(0.0)), 3)
    return levels.groupBy(*by).agg(F.max_by("value", F.struct(score, -F.col("k"))).alias("threshold"))


def multi_otsu(voxels: DataFrame, by: tuple[str, ...] = ("volume_id",), classes: int = 3, bins: int = 256) -> DataFrame:
    """The thresholds t1, t2, ... between ``classes`` classes: levels as for otsu, of equal scores the first.

    One step a class extends the best split that ends at each level to every
    later level: pairs of levels, never of voxels nor tuples of them.  Groups
    with fewer levels than classes are left out.
    """
    if classes < 2:
        raise ValueError(f"classes must be 2 or more: {classes}")
    m = _moments(voxels, by, bins).select(*by, "k", "value", *[F.col(c).cast("double").alias(c) for c in ("n0", "s0", "n", "s")])
    now = m.select(*by, F.col("k").alias("end"), F.col("n0").alias("m0"), F.col("s0").alias("r0"), (F.col("s0") * F.col("s0") / F.col("n0")).alias("score"), F.array("k").alias("path"), F.array(F.col("value")).alias("t"))
    gain = (F.col("s0") - F.col("r0")) * (F.col("s0") - F.col("r0")) / (F.col("n0") - F.col("m0"))
    for _ in range(classes - 2):
        longer = now.join(m, list(by)).where("end < k").withColumn("score", F.col("score") + gain)
        best = F.max_by(F.struct("n0", "s0", "score", "path", "t"), F.struct(F.round("score", 3), F.transform("path", lambda x: -x))).alias("b")
        kept = longer.groupBy(*by, "k", "value").agg(best)
        now = kept.select(*by, F.col("k").alias("end"), F.col("b.n0").alias("m0"), F.col("b.s0").alias("r0"), F.col("b.score").alias("score"), F.concat("b.path", F.array("k")).alias("path"), F.concat("b.t", F.array("value")).alias("t"))
    whole = m.groupBy(*by).agg(F.max("n").alias("n"), F.max_by("s", "k").alias("s"))
    last = (F.col("s") - F.col("r0")) * (F.col("s") - F.col("r0")) / (F.col("n") - F.col("m0"))
    ended = now.join(whole, list(by)).where("m0 < n").withColumn("score", F.round(F.col("score") + last, 3))
    found = ended.groupBy(*by).agg(F.max_by("t", F.struct(F.col("score"), F.transform("path", lambda x: -x))).alias("t"))
    return found.select(*by, *[F.col("t")[i].alias(f"t{i + 1}") for i in range(classes - 1)])


def valley_inputs(voxels: DataFrame) -> DataFrame:
    """The 1st and 99th percentile of positive voxels, linearly interpolated (THR5's clip range)."""
    p = F.percentile(F.col("v").cast("double"), F.array(F.lit(0.01), F.lit(0.99)))
    return voxels.where("v > 0").groupBy(*BY).agg(p.alias("p")).select(*BY, F.col("p")[0].alias("p1"), F.col("p")[1].alias("p99"))
