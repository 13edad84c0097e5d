"""Named queries over the driver's tables, each with SQL that gives the same rows where SQL can.

All run on the canonical volume (``plans.volume``) and derive their regions
from its foreground after opening and closing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators import filters as N
from lamina.operators import intensity as I
from lamina.operators import labeling as L
from lamina.operators import measure as M
from lamina.operators import morphology as P
from lamina.operators import reslice as R
from lamina.operators import segmentation as G
from lamina.operators import sequence as S
from lamina.operators.lineage import shared_folder
from lamina.plans import analyzer, dental
from lamina.plans.volume import DEPTH, HEIGHT, ORACLE_CTE, WIDTH, canonical, foreground
from lamina.sources import images, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SIZE = (HEIGHT, WIDTH)
FULL = (DEPTH, HEIGHT, WIDTH)
FG = "fg AS (SELECT volume_id, z, y, x FROM vox WHERE v > 100)"
IN = "y BETWEEN 0 AND 31 AND x BETWEEN 0 AND 31"


def _moved(source: str, steps: list[tuple[int, int]] = P.CROSS) -> str:
    rows = ", ".join(f"({a}, {b})" for a, b in steps)
    return f"SELECT volume_id, z, y + a AS y, x + b AS x FROM {source}, (VALUES {rows}) s(a, b)"


def _dilated(name: str, source: str, steps: list[tuple[int, int]] = P.CROSS) -> str:
    return f"{name} AS (SELECT DISTINCT volume_id, z, y, x FROM ({_moved(source, steps)}) WHERE {IN})"


def _eroded(name: str, source: str, steps: list[tuple[int, int]] = P.CROSS, outside: bool = True) -> str:
    need = " + ".join(f"(y + {a} BETWEEN 0 AND 31 AND x + {b} BETWEEN 0 AND 31)::INT" for a, b in steps) if outside else str(len(steps))
    return f"{name} AS (SELECT volume_id, z, y, x FROM ({_moved(source, steps)}) WHERE {IN} GROUP BY ALL HAVING count(*) = {need})"


def _labels(name: str, source: str, join: str) -> str:
    """Recursive labelling: each pixel's least reachable raster key, then ranks of those keys."""
    return f"""{name}_r AS (
  SELECT volume_id, z, y, x, y * 32 + x AS k FROM {source}
  UNION SELECT b.volume_id, b.z, b.y, b.x, a.k FROM {name}_r a JOIN {source} b ON a.volume_id = b.volume_id AND a.z = b.z AND {join}
), {name} AS (
  SELECT volume_id, z, y, x, (DENSE_RANK() OVER (PARTITION BY volume_id, z ORDER BY k))::INT AS label
  FROM (SELECT volume_id, z, y, x, min(k) AS k FROM {name}_r GROUP BY ALL)
)"""


EIGHT = "abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1"
FOUR = "abs(a.y - b.y) + abs(a.x - b.x) = 1"
SMOOTH = ", ".join([FG, _eroded("er", "fg"), _dilated("op", "er"), _dilated("di", "op"), _eroded("cl", "di")])
LABELLED = f"{SMOOTH}, {_labels('lab', 'cl', EIGHT)}"
AREA = f"{LABELLED}, area AS (SELECT volume_id, z, label, count(*) AS area FROM lab GROUP BY ALL)"
MEASURED = AREA + """, reg AS (
  SELECT volume_id, z, label, count(*) AS area, avg(y) AS cy, avg(x) AS cx, avg(v) AS mean_intensity, min(v) AS min_intensity, max(v) AS max_intensity,
    stddev_pop(v) AS std_intensity, min(y) AS y0, min(x) AS x0, max(y) + 1 AS y1, max(x) + 1 AS x1, var_pop(y) AS myy, var_pop(x) AS mxx, covar_pop(y, x) AS myx
  FROM lab JOIN vox USING (volume_id, z, y, x) GROUP BY ALL
)"""


def smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.open_close(foreground(canonical(spark, sf_dir)), *SIZE)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.label_slices(smooth(spark, sf_dir))


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).groupBy("volume_id", "z", "label").agg(F.count("*").alias("area"))


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.regions(labelled(spark, sf_dir), canonical(spark, sf_dir))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(name: str, build: Query, sql: str | None, ctes: str = "") -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(build(spark, sf_dir))
    if sql:
        ORACLES[name] = f"WITH RECURSIVE {ORACLE_CTE}{', ' + ctes if ctes else ''} {sql}"


def voxel_query(name: str, op: Callable[[DataFrame], DataFrame], sql: str, ctes: str = "") -> None:
    query(name, lambda spark, sf_dir: op(canonical(spark, sf_dir)), sql, ctes)


def mask_query(name: str, op: Callable[[DataFrame], DataFrame], sql: str, ctes: str) -> None:
    query(name, lambda spark, sf_dir: op(foreground(canonical(spark, sf_dir))), sql, ctes)


voxel_query("volume_info", I.volume_info, """SELECT volume_id, (max(z) + 1)::BIGINT AS depth, (max(y) + 1)::BIGINT AS height, (max(x) + 1)::BIGINT AS width,
  min(v) AS min_v, max(v) AS max_v, round(avg(v), 6) AS mean_v, round(stddev_pop(v), 6) AS std_v FROM vox GROUP BY volume_id""")
voxel_query("normalize_minmax", lambda d: I.normalize(d, "minmax"), "SELECT volume_id, z, y, x, round((v - min(v) OVER w)::DOUBLE / (max(v) OVER w - min(v) OVER w), 6) AS v FROM vox WINDOW w AS (PARTITION BY volume_id)")
voxel_query("normalize_zscore", lambda d: I.normalize(d, "zscore"), "SELECT volume_id, z, y, x, round((v - m) / s, 6) AS v FROM vox, (SELECT avg(v) AS m, stddev_pop(v) AS s FROM vox)")
HIST = """span AS (SELECT volume_id, min(v)::DOUBLE AS lo, max(v)::DOUBLE AS hi FROM vox GROUP BY 1),
hist AS (SELECT s.volume_id, b.i::INT AS bin, lo + (b.i + 0.5::DOUBLE) * ((hi - lo) / 256) AS centre, count(v.v) AS cnt, any_value(lo) AS lo, any_value(hi) AS hi
  FROM span s CROSS JOIN range(256) b(i) LEFT JOIN vox v ON v.volume_id = s.volume_id AND least(floor((v.v - lo) / (hi - lo) * 256), 255) = b.i GROUP BY s.volume_id, b.i, lo, hi)"""
voxel_query("histogram", lambda d: I.histogram(d, 256), "SELECT volume_id, bin, round(centre, 6) AS centre, cnt FROM hist", HIST)
EQUALIZED = """SELECT v.volume_id, z, y, x, round(CASE WHEN nx IS NULL THEN c ELSE c + (c1 - c) * greatest(0, least(1, (v - centre) / (nx - centre))) END, 6) AS v
  FROM vox v JOIN cdf ON bin = greatest(0, least(floor((v - lo) / ((hi - lo) / 256) - 0.5::DOUBLE), 255))"""
voxel_query("histogram_equalize", I.equalize, EQUALIZED,
  HIST + ", cdf0 AS (SELECT *, sum(cnt) OVER (ORDER BY bin)::DOUBLE / sum(cnt) OVER () AS c FROM hist), cdf AS (SELECT *, lead(c) OVER (ORDER BY bin) AS c1, lead(centre) OVER (ORDER BY bin) AS nx FROM cdf0)")
voxel_query("background_subtract", I.background_subtract, "SELECT volume_id, z, y, x, v - min(v) OVER (PARTITION BY volume_id) AS v FROM vox")
voxel_query("gamma", lambda d: I.adjust_gamma(d, 0.5), "SELECT volume_id, z, y, x, round(pow(v / 255::DOUBLE, 0.5::DOUBLE) * 255, 6) AS v FROM vox")
voxel_query("band_predicate", lambda d: I.band(d, 20, 150), "SELECT * FROM vox WHERE v > 0 AND (v <= 20 OR v >= 150)")
voxel_query("clamp", lambda d: I.clamp(d, 200.0), "SELECT volume_id, z, y, x, CASE WHEN v > 60 THEN v ELSE 0 END AS v FROM vox")
voxel_query("slice_range", lambda d: I.slice_range(d, 1, 4, DEPTH), "SELECT * FROM vox WHERE z >= 1 AND z < 4")
voxel_query("manual_threshold", foreground, "SELECT * FROM fg", FG)
OTSU = """lv AS (SELECT volume_id, z, v::BIGINT AS v, count(*) AS c FROM vox GROUP BY ALL),
ps AS (SELECT volume_id, z, v, sum(c) OVER w AS n0, sum(c * v) OVER w AS s0, sum(c) OVER p AS n, sum(c * v) OVER p AS s FROM lv WINDOW w AS (PARTITION BY volume_id, z ORDER BY v), p AS (PARTITION BY volume_id, z))"""
voxel_query("otsu_per_slice", I.otsu, """SELECT volume_id, z, arg_max(v, (round(COALESCE(n0::DOUBLE * (n - n0)::DOUBLE * (s0 / n0::DOUBLE - (s - s0) / NULLIF(n - n0, 0)::DOUBLE) * (s0 / n0::DOUBLE - (s - s0) / NULLIF(n - n0, 0)::DOUBLE), 0), 3), -v)) AS threshold FROM ps GROUP BY volume_id, z""", OTSU)
MULTI = """lv AS (SELECT volume_id, v::BIGINT AS v, count(*) AS c FROM vox GROUP BY ALL),
ps AS (SELECT volume_id, v, (sum(c) OVER w)::DOUBLE AS n0, (sum(c * v) OVER w)::DOUBLE AS s0, (sum(c) OVER p)::DOUBLE AS n, (sum(c * v) OVER p)::DOUBLE AS s FROM lv WINDOW w AS (PARTITION BY volume_id ORDER BY v), p AS (PARTITION BY volume_id)),
sc AS (SELECT a.volume_id, a.v AS t1, b.v AS t2, round(a.s0 * a.s0 / a.n0 + (b.s0 - a.s0) * (b.s0 - a.s0) / (b.n0 - a.n0) + (a.s - b.s0) * (a.s - b.s0) / (a.n - b.n0), 3) AS sc
  FROM ps a JOIN ps b ON a.volume_id = b.volume_id AND a.v < b.v AND b.n0 < a.n)"""
voxel_query("multi_otsu", I.multi_otsu, "SELECT volume_id, t1, t2 FROM sc QUALIFY row_number() OVER (PARTITION BY volume_id ORDER BY sc DESC, t1, t2) = 1", MULTI)
voxel_query("valley_inputs", I.valley_inputs, "SELECT volume_id, round(quantile_cont(v::DOUBLE, 0.01), 6) AS p1, round(quantile_cont(v::DOUBLE, 0.99), 6) AS p99 FROM vox WHERE v > 0 GROUP BY 1")
mask_query("dilate", lambda m: P.dilate(m, *SIZE), "SELECT * FROM di", f"{FG}, {_dilated('di', 'fg')}")
mask_query("erode", lambda m: P.erode(m, *SIZE), "SELECT * FROM er", f"{FG}, {_eroded('er', 'fg')}")
query("open_close", smooth, "SELECT * FROM cl", SMOOTH)
query("label_2d_8", labelled, "SELECT * FROM lab", LABELLED)
mask_query("label_2d_4", lambda m: L.label_slices(m, 1), "SELECT * FROM lab", f"{FG}, {_labels('lab', 'fg', FOUR)}")
mask_query("label_3d_6", lambda m: L.label_volume(m, slab=3), "SELECT volume_id, z, y, x, min(k) AS label FROM r GROUP BY ALL", FG + """, r AS (
  SELECT volume_id, z, y, x, z::BIGINT * 1099511627776 + y::BIGINT * 1048576 + x AS k FROM fg
  UNION SELECT b.volume_id, b.z, b.y, b.x, a.k FROM r a JOIN fg b ON abs(a.y - b.y) + abs(a.x - b.x) + abs(a.z - b.z) = 1)""")
query("remove_small", lambda s, d: P.remove_small(L.label_slices(smooth(s, d), 1), 100), "SELECT l4.* FROM l4 SEMI JOIN a4 USING (volume_id, z, label)",
  f"{SMOOTH}, {_labels('l4', 'cl', FOUR)}, a4 AS (SELECT volume_id, z, label FROM l4 GROUP BY ALL HAVING count(*) >= 100)")
query("fill_holes", lambda s, d: L.fill_holes(I.slice_range(canonical(s, d), 0, DEPTH, DEPTH).where("v BETWEEN 1 AND 38").select("volume_id", "z", "y", "x"), *SIZE), """
  SELECT volume_id, z, y, x FROM vox WHERE (z, y, x) NOT IN (SELECT (z, y, x) FROM r)""", """bg AS (SELECT * FROM vox WHERE NOT v BETWEEN 1 AND 38), r AS (
  SELECT z, y, x FROM bg WHERE y IN (0, 31) OR x IN (0, 31) UNION SELECT b.z, b.y, b.x FROM r a JOIN bg b ON a.z = b.z AND abs(a.y - b.y) + abs(a.x - b.x) = 1)""")
query("region_measure", measured, """SELECT volume_id, z, label, area, round(cy, 6) AS cy, round(cx, 6) AS cx, round(mean_intensity, 6) AS mean_intensity, min_intensity, max_intensity,
  round(std_intensity, 6) AS std_intensity, y0, x0, y1, x1, round(4 * sqrt(l1), 6) AS major_axis, round(4 * sqrt(l2), 6) AS minor_axis, round(sqrt(greatest(0, 1 - l2 / l1)), 6) AS eccentricity
  FROM (SELECT *, (myy + mxx) / 2 + sqrt((myy - mxx) * (myy - mxx) / 4 + myx * myx) AS l1, greatest((myy + mxx) / 2 - sqrt((myy - mxx) * (myy - mxx) / 4 + myx * myx), 0) AS l2 FROM reg)""", MEASURED)
query("segmentation_stats", lambda s, d: M.segmentation_stats(labelled(s, d), canonical(s, d).select("volume_id", "z").distinct()), """SELECT 'canonical' AS volume_id, i::INT AS z, count(area) AS num_regions, COALESCE(sum(area), 0)::BIGINT AS total_area,
  round(COALESCE(avg(area), 0), 6) AS mean_area, COALESCE(max(area), 0) AS max_area, COALESCE(min(area), 0) AS min_area, round(COALESCE(stddev_pop(area), 0), 6) AS std_area FROM range(7) t(i) LEFT JOIN area ON z = i GROUP BY i""", AREA)
query("area_filter", lambda s, d: M.filter_by_area(labelled(s, d), 50, 100), "SELECT lab.* FROM lab JOIN area USING (volume_id, z, label) WHERE area BETWEEN 50 AND 100", AREA)
query("largest_region", lambda s, d: M.largest_region(areas(s, d)), "SELECT volume_id, z, label, area FROM area QUALIFY row_number() OVER (PARTITION BY volume_id, z ORDER BY area DESC, label) = 1", AREA)
query("region_intensity", lambda s, d: M.region_intensity(labelled(s, d), canonical(s, d), 2), "SELECT volume_id, z, round(COALESCE(avg(v) FILTER (label = 2), 0), 6) AS intensity FROM vox LEFT JOIN lab USING (volume_id, z, y, x) GROUP BY ALL", LABELLED)
query("top_regions", lambda s, d: M.top_regions(areas(s, d)), "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY volume_id, z ORDER BY area DESC, label)::INT AS rank FROM area) WHERE rank <= 5", AREA)
query("region_compare", lambda s, d: M.compare_top_two(measured(s, d)), """SELECT a.volume_id, a.z, a.label AS label_1, b.label AS label_2, a.area AS area_1, b.area AS area_2, round(a.mean_intensity, 6) AS mean_intensity_1, round(b.mean_intensity, 6) AS mean_intensity_2,
  a.area - b.area AS area_difference, round(a.area / b.area::DOUBLE, 6) AS area_ratio, round(a.mean_intensity - b.mean_intensity, 6) AS intensity_difference, round(a.mean_intensity / b.mean_intensity, 6) AS intensity_ratio
  FROM rk a JOIN rk b ON a.volume_id = b.volume_id AND a.z = b.z AND a.rn = 1 AND b.rn = 2""", MEASURED + ", rk AS (SELECT *, row_number() OVER (PARTITION BY volume_id, z ORDER BY area DESC, label) AS rn FROM reg)")
query("cross_slice_stats", lambda s, d: M.cross_slice_stats(measured(s, d), DEPTH), """SELECT volume_id, count(*) AS total_regions, round(count(*) / 7::DOUBLE, 6) AS regions_per_slice, round(avg(area), 6) AS mean_area, round(stddev_pop(area), 6) AS std_area,
  min(area) AS min_area, max(area) AS max_area, round(avg(mean_intensity), 6) AS mean_of_means, round(stddev_pop(mean_intensity), 6) AS std_of_means FROM reg GROUP BY volume_id""", MEASURED)
query("mask_keep", lambda s, d: M.keep_mask(canonical(s, d), foreground(canonical(s, d))), "SELECT * FROM vox WHERE v > 100")
query("mask_remove", lambda s, d: M.remove_mask(canonical(s, d), foreground(canonical(s, d))), "SELECT * FROM vox WHERE NOT v > 100")
query("keep_half_max", lambda s, d: M.keep_half_max(areas(s, d)), "SELECT * FROM area WHERE area >= 0.5 * (SELECT max(area) FROM area)", AREA)
BOX = "box AS (SELECT volume_id, min(z) AS zmin, max(z) + 1 AS zmax, min(y) AS ymin, max(y) + 1 AS ymax, min(x) AS xmin, max(x) + 1 AS xmax FROM fg GROUP BY 1)"
mask_query("bounding_box", M.bounding_box, "SELECT * FROM box", f"{FG}, {BOX}")
query("crop", lambda s, d: M.crop(canonical(s, d), M.bounding_box(foreground(canonical(s, d)))), "SELECT v.volume_id, z - zmin AS z, y - ymin AS y, x - xmin AS x, v FROM vox v JOIN box ON z >= zmin AND z < zmax AND y >= ymin AND y < ymax AND x >= xmin AND x < xmax", f"{FG}, {BOX}")
query("end_trim", lambda s, d: S.end_trim(areas(s, d), 80), "SELECT volume_id, min(z) FILTER (label = 1 AND area >= 80) AS z_first, max(z) FILTER (label = 1 AND area >= 80) AS z_last FROM area GROUP BY 1", AREA)
query("ring_slice", lambda s, d: S.ring_slice(areas(s, d), 1.01), "SELECT volume_id, max(z) + 1 AS z_ring FROM (SELECT *, lag(area) OVER (PARTITION BY volume_id ORDER BY z DESC) AS b FROM area WHERE label = 1) WHERE area < 1.01 * b GROUP BY 1", AREA)
query("track_region", lambda s, d: S.track(measured(s, d)), """SELECT volume_id, z, label FROM tr WHERE kept""", MEASURED + """, tr AS (
  (SELECT volume_id, z, label, cy, cx, area, TRUE AS kept FROM reg WHERE z = 6 ORDER BY cx, cy LIMIT 1)
  UNION ALL (SELECT t.volume_id, r.z, r.label, r.cy, r.cx, r.area, TRUE FROM tr t JOIN reg r ON r.z = t.z - 1 AND r.area <= 2 * t.area
    QUALIFY row_number() OVER (ORDER BY (r.cy - t.cy) * (r.cy - t.cy) + (r.cx - t.cx) * (r.cx - t.cx)) = 1))""")
query("slice_percentage", lambda s, d: S.slice_percentage(canonical(s, d).select("volume_id", "z").distinct()), "SELECT DISTINCT volume_id, z, round(z / 7::DOUBLE, 6) AS slice_percentage FROM vox")
CURVE = "cv AS (SELECT volume_id, z AS i, z::DOUBLE AS z, avg(y) AS y, avg(x) AS x FROM vox WHERE v BETWEEN 120 AND 159 GROUP BY volume_id, vox.z)"
query("local_frames", lambda s, d: S.local_frames(canonical(s, d).where("v BETWEEN 120 AND 159").groupBy("volume_id", F.col("z").alias("i")).agg(F.avg("z").alias("z"), F.avg("y").alias("y"), F.avg("x").alias("x"))), """
  SELECT volume_id, i, round(tz, 6) AS tz, round(ty, 6) AS ty, round(tx, 6) AS tx, round(nz, 6) AS nz, round(ny, 6) AS ny, 0::DOUBLE AS nx, round(- tx * ny, 6) AS bz, round(tx * nz, 6) AS by, round(tz * ny - ty * nz, 6) AS bx
  FROM (SELECT *, ty / sqrt(ty * ty + tz * tz) AS nz, -tz / sqrt(ty * ty + tz * tz) AS ny FROM (SELECT volume_id, i, dz / n AS tz, dy / n AS ty, dx / n AS tx FROM (SELECT *, sqrt(dz * dz + dy * dy + dx * dx) AS n FROM (
    SELECT volume_id, i, (COALESCE(lead(z) OVER w, z) - COALESCE(lag(z) OVER w, z)) / k AS dz, (COALESCE(lead(y) OVER w, y) - COALESCE(lag(y) OVER w, y)) / k AS dy, (COALESCE(lead(x) OVER w, x) - COALESCE(lag(x) OVER w, x)) / k AS dx
    FROM (SELECT *, CASE WHEN i IN (0, 6) THEN 1 ELSE 2 END AS k FROM cv) WINDOW w AS (ORDER BY i)))))""", CURVE)
_W = P.gaussian_weights(1.0)
GAUSS = "gw(d, w) AS (VALUES " + ", ".join(f"({k - len(_W) // 2}, {w!r}::DOUBLE)" for k, w in enumerate(_W)) + ")"
REFLECT = "CASE WHEN {0} + d < 0 THEN -1 - {0} - d WHEN {0} + d > 31 THEN 63 - {0} - d ELSE {0} + d END"
voxel_query("gaussian_2d", lambda d: P.gaussian_2d(d, *SIZE, 1.0), "SELECT a.volume_id, a.z, a.y, a.x, round(sum(b.v * w), 6) AS v FROM g1 a, gw JOIN g1 b ON b.z = a.z AND b.y = a.y AND b.x = " + REFLECT.format("a.x") + " GROUP BY ALL",
  GAUSS + ", g1 AS (SELECT a.volume_id, a.z, a.y, a.x, sum(b.v * w) AS v FROM vox a, gw JOIN vox b ON b.z = a.z AND b.x = a.x AND b.y = " + REFLECT.format("a.y") + " GROUP BY ALL)")
EDGE = "sb(dy, dx, gy, gx) AS (VALUES " + ", ".join(f"({a}, {b}, {a * (2 - abs(b))}, {b * (2 - abs(a))})" for a in (-1, 0, 1) for b in (-1, 0, 1)) + ")"
CLAMP = "b.z = a.z AND b.y = greatest(0, least(31, a.y + dy)) AND b.x = greatest(0, least(31, a.x + dx))"
GRADIENT = "sqrt(pow(sum(b.v * gy), 2) + pow(sum(b.v * gx), 2))"
voxel_query("sobel", lambda d: P.sobel(d, *SIZE), f"SELECT a.volume_id, a.z, a.y, a.x, round({GRADIENT}, 6) AS v FROM vox a, sb JOIN vox b ON {CLAMP} GROUP BY ALL", EDGE)


# Slab and slice kernels.  Slabs of three slices, so that halos are in use on the seven-slice volume.
BALL = "(VALUES (0, 0, 0), (-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)) s(a, b, c)"
IN3 = f"z BETWEEN 0 AND 6 AND {IN}"


def _dilated_3d(name: str, source: str) -> str:
    return f"{name} AS (SELECT DISTINCT volume_id, z, y, x FROM (SELECT volume_id, z + a AS z, y + b AS y, x + c AS x FROM {source}, {BALL}) WHERE {IN3})"


def _eroded_3d(name: str, source: str, outside: bool) -> str:
    need = "7 - (z = 0)::INT - (z = 6)::INT - (y = 0)::INT - (y = 31)::INT - (x = 0)::INT - (x = 31)::INT" if outside else "7"
    return f"{name} AS (SELECT volume_id, z, y, x FROM (SELECT volume_id, z + a AS z, y + b AS y, x + c AS x FROM {source}, {BALL}) WHERE {IN3} GROUP BY ALL HAVING count(*) = {need})"


DEEP = "CASE WHEN a.z + d < 0 THEN -1 - a.z - d WHEN a.z + d > 6 THEN 13 - a.z - d ELSE a.z + d END"
voxel_query("gaussian_3d", lambda d: N.gaussian_3d(d, FULL, 1.0, 3), "SELECT a.volume_id, a.z, a.y, a.x, round(sum(b.v * w), 6) AS v FROM g2 a, gw JOIN g2 b ON b.y = a.y AND b.x = a.x AND b.z = " + DEEP + " GROUP BY ALL",
  GAUSS + ", g1 AS (SELECT a.volume_id, a.z, a.y, a.x, sum(b.v * w) AS v FROM vox a, gw JOIN vox b ON b.z = a.z AND b.x = a.x AND b.y = " + REFLECT.format("a.y") + " GROUP BY ALL)"
  + ", g2 AS (SELECT a.volume_id, a.z, a.y, a.x, sum(b.v * w) AS v FROM g1 a, gw JOIN g1 b ON b.z = a.z AND b.y = a.y AND b.x = " + REFLECT.format("a.x") + " GROUP BY ALL)")
mask_query("closing_3d", lambda m: N.closing_3d(m, FULL, 1, 3), "SELECT * FROM c3", f"{FG}, {_dilated_3d('d3', 'fg')}, {_eroded_3d('c3', 'd3', True)}")
mask_query("opening_3d", lambda m: N.opening_3d(m, FULL, 1, 3), "SELECT * FROM o3", f"{FG}, {_eroded_3d('e3', 'fg', True)}, {_dilated_3d('o3', 'e3')}")
mask_query("dilate_3d", lambda m: N.dilate_3d(m, FULL, 1, 3), "SELECT * FROM d3", f"{FG}, {_dilated_3d('d3', 'fg')}")
mask_query("erode_3d", lambda m: N.erode_3d(m, FULL, 1, 3), "SELECT * FROM e3", f"{FG}, {_eroded_3d('e3', 'fg', False)}")
mask_query("distance_transform", lambda m: N.distance_transform(m, *SIZE), "SELECT a.volume_id, a.z, a.y, a.x, round(sqrt(min((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x))), 6) AS v FROM fg a JOIN vox b ON a.z = b.z AND b.v <= 100 GROUP BY ALL", FG)
mask_query("neighbour_graph", lambda m: R.skeleton_edges(m).selectExpr("volume_id", *[f"{e}.{c} AS {e}_{c}" for e in ("src", "dst") for c in "zyx"], "weight"), """
  SELECT a.volume_id, a.z AS src_z, a.y AS src_y, a.x AS src_x, b.z AS dst_z, b.y AS dst_y, b.x AS dst_x, round(sqrt(abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x)), 6) AS weight
  FROM fg a JOIN fg b ON abs(a.z - b.z) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND (a.z, a.y, a.x) < (b.z, b.y, b.x)""", FG)
voxel_query("segment_manual", lambda d: G.segment(d, *SIZE, "manual", 100, threshold=100), "SELECT * FROM lab", f"""{SMOOTH}, {_labels('l4', 'cl', FOUR)},
  a4 AS (SELECT z, label FROM l4 GROUP BY ALL HAVING count(*) >= 100), big AS (SELECT volume_id, z, y, x FROM l4 SEMI JOIN a4 USING (z, label)), {_labels('lab', 'big', EIGHT)}""")
query("area_histogram", lambda s, d: analyzer.plot_histogram(areas(s, d), "area", 50), """SELECT i::INT AS bin, round(lo + (i + 0.5::DOUBLE) * ((hi - lo) / 50), 6) AS centre, count(area) AS cnt
  FROM (SELECT min(area)::DOUBLE AS lo, max(area)::DOUBLE AS hi FROM area) CROSS JOIN range(50) t(i) LEFT JOIN area ON least(floor((area - lo) / (hi - lo) * 50), 49) = i GROUP BY i, lo, hi""", AREA)
query("slice_overlay", lambda s, d: analyzer.slice_overlay(canonical(s, d), labelled(s, d), 3), "SELECT volume_id, vox.z, vox.y, vox.x, v, COALESCE(label, 0) AS label FROM vox LEFT JOIN lab USING (volume_id, z, y, x) WHERE z = 3", LABELLED)
query("comparison_chart", lambda s, d: analyzer.comparison_plots(measured(s, d)), """SELECT a.volume_id, a.z, a.area - b.area AS area_difference, round(a.mean_intensity - b.mean_intensity, 6) AS intensity_difference,
  round(a.area / b.area::DOUBLE, 6) AS area_ratio, round(a.mean_intensity / b.mean_intensity, 6) AS intensity_ratio FROM rk a JOIN rk b ON a.volume_id = b.volume_id AND a.z = b.z AND a.rn = 1 AND b.rn = 2""",
  MEASURED + ", rk AS (SELECT *, row_number() OVER (PARTITION BY volume_id, z ORDER BY area DESC, label) AS rn FROM reg)")
voxel_query("reverse_slices", analyzer.slice_numbers, "SELECT volume_id, 6 - z AS z, y, x, v FROM vox")
voxel_query("trim_ends", lambda d: dental.trim_ends(d.withColumn("v", F.expr("CASE WHEN z BETWEEN 1 AND 5 AND v > 100 THEN v WHEN y = 31 AND x = 31 THEN 7 ELSE 0 END")), 20),
  "SELECT volume_id, z, y, x, CASE WHEN z NOT BETWEEN 1 AND 5 THEN 0 WHEN v > 100 THEN v WHEN y = 31 AND x = 31 THEN 7 ELSE 0 END AS v FROM vox")


def curve(voxels: DataFrame) -> DataFrame:
    return voxels.where("v BETWEEN 120 AND 159").groupBy("volume_id", F.col("z").alias("i")).agg(F.avg("z").alias("z"), F.avg("y").alias("y"), F.avg("x").alias("x"))


def framed_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = curve(canonical(spark, sf_dir))
    return line.join(S.local_frames(line), ["volume_id", "i"])


FRAMES = CURVE + """, fr AS (SELECT *, -tx * ny AS bz, tx * nz AS "by", tz * ny - ty * nz AS bx FROM (SELECT *, ty / sqrt(ty * ty + tz * tz) AS nz, -tz / sqrt(ty * ty + tz * tz) AS ny, 0::DOUBLE AS nx FROM (
    SELECT *, dz / n AS tz, dy / n AS ty, dx / n AS tx FROM (SELECT *, sqrt(dz * dz + dy * dy + dx * dx) AS n FROM (
    SELECT volume_id, i, z, y, x, (COALESCE(lead(z) OVER w, z) - COALESCE(lag(z) OVER w, z)) / k AS dz, (COALESCE(lead(y) OVER w, y) - COALESCE(lag(y) OVER w, y)) / k AS dy, (COALESCE(lead(x) OVER w, x) - COALESCE(lag(x) OVER w, x)) / k AS dx
    FROM (SELECT *, CASE WHEN i IN (0, 6) THEN 1 ELSE 2 END AS k FROM cv) WINDOW w AS (ORDER BY i))))))"""
query("resample", lambda s, d: R.resample(canonical(s, d), framed_curve(s, d), 9, 1.0), """SELECT p.volume_id, p.i AS z, p.row AS y, p.col AS x,
    round(round(CASE WHEN pz BETWEEN 0 AND 6 AND py BETWEEN 0 AND 31 AND px BETWEEN 0 AND 31 THEN sum((CASE WHEN oz = 1 THEN fz ELSE 1 - fz END) * (CASE WHEN oy = 1 THEN fy ELSE 1 - fy END) * (CASE WHEN ox = 1 THEN fx ELSE 1 - fx END) * COALESCE(v, 0)) ELSE 0 END, 9))::INT AS v
  FROM (SELECT *, pz - floor(pz) AS fz, py - floor(py) AS fy, px - floor(px) AS fx FROM (SELECT fr.volume_id, i, w.k::INT AS row, u.k::INT AS col, z + tu * nz + tw * bz AS pz, y + tu * ny + tw * fr."by" AS py, x + tu * nx + tw * bx AS px
    FROM fr, (SELECT k, -4.5::DOUBLE + k * 1.125::DOUBLE AS tu FROM range(9) r(k)) u, (SELECT k, -4.5::DOUBLE + k * 1.125::DOUBLE AS tw FROM range(9) r(k)) w)) p
  CROSS JOIN (SELECT oz.i AS oz, oy.i AS oy, ox.i AS ox FROM range(2) oz(i), range(2) oy(i), range(2) ox(i)) LEFT JOIN vox ON vox.z = floor(pz) + oz AND vox.y = floor(py) + oy AND vox.x = floor(px) + ox GROUP BY p.volume_id, p.i, p.row, p.col, pz, py, px""", FRAMES)
query("rasterise", lambda s, d: R.rasterise(curve(canonical(s, d)), M.bounding_box(canonical(s, d))), "SELECT DISTINCT volume_id, round_even(z, 0)::INT AS z, round_even(y, 0)::INT AS y, round_even(x, 0)::INT AS x FROM cv", CURVE)


def _gauss(name: str, sigma: float) -> str:
    w = P.gaussian_weights(sigma)
    return f"{name}(d, w) AS (VALUES " + ", ".join(f"({k - len(w) // 2}, {x!r}::DOUBLE)" for k, x in enumerate(w)) + ")"


def _mirror(c: str, size: int) -> str:
    """Coordinate c + d reflected at half samples, as often as it takes."""
    turn = f"((({c} + d) % {2 * size} + {2 * size}) % {2 * size})"
    return f"(CASE WHEN {turn} < {size} THEN {turn} ELSE {2 * size - 1} - {turn} END)"


def _blurred(name: str, source: str, weights: str, axes: dict[str, int]) -> str:
    """Passes of a separable Gaussian along the axes given, as CTEs; the last is called name."""
    out, of = [], source
    for i, (axis, size) in enumerate(axes.items()):
        to = name if i == len(axes) - 1 else f"{name}_{axis}"
        rest = " AND ".join(f"b.{c} = a.{c}" for c in "zyx" if c != axis)
        out.append(f"{to} AS (SELECT a.volume_id, a.z, a.y, a.x, sum(b.v * w) AS v FROM {of} a, {weights} JOIN {of} b ON {rest} AND b.{axis} = {_mirror('a.' + axis, size)} GROUP BY ALL)")
        of = to
    return ", ".join(out)


def _cleaned(mask: str, least: int) -> str:
    """Opening, closing, edge-connected regions below least dropped and corner-connected labels of the rest, as lab."""
    steps = [_eroded("er", mask), _dilated("op", "er"), _dilated("di", "op"), _eroded("cl", "di"), _labels("l4", "cl", FOUR)]
    return ", ".join(steps) + f""", a4 AS (SELECT z, label FROM l4 GROUP BY ALL HAVING count(*) >= {least}), big AS (SELECT volume_id, z, y, x FROM l4 SEMI JOIN a4 USING (z, label)), {_labels('lab', 'big', EIGHT)}"""


ALONG = {"z": DEPTH, "y": HEIGHT, "x": WIDTH}
FLAT = {"y": HEIGHT, "x": WIDTH}
voxel_query("difference_of_gaussians", lambda d: N.difference_of_gaussians(d, FULL, 1.0, 2.0, 3), "SELECT volume_id, z, y, x, round(a.v - b.v, 6) AS v FROM lo a JOIN hi b USING (volume_id, z, y, x)",
  f"{_gauss('w1', 1.0)}, {_gauss('w2', 2.0)}, {_blurred('lo', 'vox', 'w1', ALONG)}, {_blurred('hi', 'vox', 'w2', ALONG)}")
SPREAD = "SELECT volume_id, z, y, x, round((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w), 6) AS v FROM {} WINDOW w AS (PARTITION BY volume_id, z)"
EDGES = f"{_gauss('w1', 1.0)}, {_blurred('sm', 'vox', 'w1', ALONG)}, {EDGE}, gr AS (SELECT a.volume_id, a.z, a.y, a.x, {GRADIENT} AS v FROM sm a, sb JOIN sm b ON {CLAMP} GROUP BY ALL)"
voxel_query("edges_plain", lambda d: N.enhance_edges(d, FULL, 1.0, False, 3), SPREAD.format("gr"), EDGES)
voxel_query("gaussian_nearest", lambda d: N.gaussian_slice(d, *SIZE, 1.0), "SELECT a.volume_id, a.z, a.y, a.x, round(sum(b.v * w), 6) AS v FROM g1 a, w1 JOIN g1 b ON b.z = a.z AND b.y = a.y AND b.x = greatest(0, least(31, a.x + d)) GROUP BY ALL",
  f"{_gauss('w1', 1.0)}, g1 AS (SELECT a.volume_id, a.z, a.y, a.x, sum(b.v / 255::DOUBLE * w) AS v FROM vox a, w1 JOIN vox b ON b.z = a.z AND b.x = a.x AND b.y = greatest(0, least(31, a.y + d)) GROUP BY ALL)")
LOCAL = f"{_gauss('wl', 14 / 6)}, {_blurred('mean', 'vox', 'wl', FLAT)}, above AS (SELECT vox.volume_id, vox.z, vox.y, vox.x FROM vox JOIN mean USING (volume_id, z, y, x) WHERE vox.v > mean.v)"
voxel_query("local_threshold", lambda d: N.local_threshold(d, *SIZE, 15), "SELECT * FROM above", LOCAL)
voxel_query("segment_local", lambda d: G.segment(d, *SIZE, "local", 20, block_size=15), "SELECT * FROM lab", f"{LOCAL}, {_cleaned('above', 20)}")
AT = """SELECT volume_id, z, arg_max(v, (round(COALESCE(n0::DOUBLE * (n - n0)::DOUBLE * (s0 / n0::DOUBLE - (s - s0) / NULLIF(n - n0, 0)::DOUBLE) * (s0 / n0::DOUBLE - (s - s0) / NULLIF(n - n0, 0)::DOUBLE), 0), 3), -v)) AS t FROM ps GROUP BY volume_id, z"""
voxel_query("segment_otsu", lambda d: G.segment(d, *SIZE, "otsu", 20), "SELECT * FROM lab", f"{OTSU}, ot AS ({AT}), fo AS (SELECT volume_id, z, y, x FROM vox JOIN ot USING (volume_id, z) WHERE v > t), {_cleaned('fo', 20)}")
UNIT = "nv AS (SELECT volume_id, z, y, x, (v - min(v) OVER w)::DOUBLE / (max(v) OVER w - min(v) OVER w) AS v FROM vox WINDOW w AS (PARTITION BY volume_id))"


def _float_levels(bins: int, by: str, source: str = "nv") -> str:
    """Levels k of equal bins with their centre v, counts and running moments, as ps."""
    return f"""sp AS (SELECT {by}, min(v)::DOUBLE AS lo, (max(v)::DOUBLE - min(v)) / {bins} AS wd FROM {source} GROUP BY ALL),
    lv AS (SELECT {by}, least(floor((v - lo) / wd), {bins - 1})::BIGINT AS k, count(*) AS c, any_value(lo) AS lo, any_value(wd) AS wd FROM {source} JOIN sp USING ({by}) GROUP BY {by}, k),
    cv AS (SELECT *, lo + (k + 0.5::DOUBLE) * wd AS v FROM lv),
    ps AS (SELECT {by}, k, v, (sum(c) OVER w)::DOUBLE AS n0, sum(c * v) OVER w AS s0, (sum(c) OVER p)::DOUBLE AS n, sum(c * v) OVER p AS s FROM cv WINDOW w AS (PARTITION BY {by} ORDER BY k), p AS (PARTITION BY {by}))"""


def _split(levels: int) -> str:
    """Scores of all tuples of that many levels, one threshold each."""
    names = [chr(97 + i) for i in range(levels)]
    terms = ["a.s0 * a.s0 / a.n0"] + [f"({y}.s0 - {x}.s0) * ({y}.s0 - {x}.s0) / ({y}.n0 - {x}.n0)" for x, y in zip(names, names[1:])] + [f"({names[-1]}.s - {names[-1]}.s0) * ({names[-1]}.s - {names[-1]}.s0) / ({names[-1]}.n - {names[-1]}.n0)"]
    joins = " ".join(f"JOIN ps {y} ON {x}.volume_id = {y}.volume_id AND {x}.k < {y}.k" for x, y in zip(names, names[1:]))
    cuts = ", ".join(f"{x}.v AS t{i + 1}, {x}.k AS k{i + 1}" for i, x in enumerate(names))
    return f"sc AS (SELECT a.volume_id, {cuts}, round({' + '.join(terms)}, 3) AS sc FROM ps a {joins} WHERE {names[-1]}.n0 < {names[-1]}.n)"


def _best(levels: int) -> str:
    ts = range(1, levels + 1)
    return f"SELECT volume_id, {', '.join(f'round(t{i}, 6) AS t{i}' for i in ts)} FROM sc QUALIFY row_number() OVER (PARTITION BY volume_id ORDER BY sc DESC, {', '.join(f'k{i}' for i in ts)}) = 1"


voxel_query("otsu_float", lambda d: I.otsu(I.normalize(d), ("volume_id", "z")), "SELECT volume_id, z, round(arg_max(v, (round(COALESCE(n0 * (n - n0) * (s0 / n0 - (s - s0) / NULLIF(n - n0, 0)) * (s0 / n0 - (s - s0) / NULLIF(n - n0, 0)), 0), 3), -k)), 6) AS threshold FROM ps GROUP BY ALL",
  f"{UNIT}, {_float_levels(256, 'volume_id, z')}")
voxel_query("multi_otsu_float", lambda d: I.multi_otsu(I.normalize(d), bins=128), _best(2), f"{UNIT}, {_float_levels(128, 'volume_id')}, {_split(2)}")
voxel_query("multi_otsu_4", lambda d: I.multi_otsu(I.normalize(d), classes=4, bins=64), _best(3), f"{UNIT}, {_float_levels(64, 'volume_id')}, {_split(3)}")
voxel_query("upper_threshold", dental.upper_threshold, "SELECT volume_id, round(lo + (t2 + 0.5::DOUBLE) * wd, 6) AS upper FROM (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY volume_id ORDER BY sc DESC, k1, k2) = 1) JOIN sp USING (volume_id)",
  f"""sp AS (SELECT volume_id, min(v)::DOUBLE AS lo, (max(v) - min(v))::DOUBLE / 512 AS wd FROM vox GROUP BY 1), lv AS (SELECT volume_id, least(floor((v - lo) / wd), 511)::BIGINT AS v, count(*) AS c FROM vox JOIN sp USING (volume_id) GROUP BY ALL),
  ps AS (SELECT volume_id, v, v AS k, (sum(c) OVER w)::DOUBLE AS n0, (sum(c * v) OVER w)::DOUBLE AS s0, (sum(c) OVER p)::DOUBLE AS n, (sum(c * v) OVER p)::DOUBLE AS s FROM lv WINDOW w AS (PARTITION BY volume_id ORDER BY v), p AS (PARTITION BY volume_id)), {_split(2)}""")  # fmt: skip
voxel_query("valley_threshold", lambda d: N.valley_threshold(d, sigma=4.0), """SELECT volume_id, round(COALESCE(min(((i + 0.5::DOUBLE) / 512)) FILTER (rk = 1), 0), 6) AS threshold
  FROM (SELECT volume_id, i, row_number() OVER (PARTITION BY volume_id ORDER BY h, i) AS rk, 1 AS there FROM sm JOIN two USING (volume_id) WHERE i BETWEEN least(p1, p2) AND greatest(p1, p2)
    UNION ALL SELECT DISTINCT volume_id, NULL, 0, 0 FROM sm) GROUP BY volume_id""", f"""pq AS (SELECT volume_id, quantile_cont(v::DOUBLE, 0.01) AS q1, quantile_cont(v::DOUBLE, 0.99) AS q99 FROM vox WHERE v > 0 GROUP BY 1),
  bn AS (SELECT volume_id, least(511, floor(greatest(0, least(1, (v - q1) / (q99 - q1 + 1e-6::DOUBLE))) * 512)) AS i, count(*) AS c FROM vox JOIN pq USING (volume_id) WHERE v > 0 GROUP BY ALL),
  hs AS (SELECT pq.volume_id, r.i, COALESCE(c, 0)::DOUBLE AS c FROM pq CROSS JOIN range(512) r(i) LEFT JOIN bn ON bn.volume_id = pq.volume_id AND bn.i = r.i),
  {_gauss('wv', 4.0)}, sm AS (SELECT a.volume_id, a.i, round(sum(b.c * w), 9) AS h FROM hs a, wv JOIN hs b ON b.volume_id = a.volume_id AND b.i = {_mirror('a.i', 512)} GROUP BY ALL),
  st AS (SELECT *, CASE WHEN h = lag(h) OVER (PARTITION BY volume_id ORDER BY i) THEN 0 ELSE 1 END AS new FROM sm), rn AS (SELECT *, sum(new) OVER (PARTITION BY volume_id ORDER BY i) AS run FROM st),
  pl AS (SELECT volume_id, run, min(i) AS i0, max(i) AS i1, any_value(h) AS h FROM rn GROUP BY ALL), pk AS (SELECT *, lag(h) OVER w AS ph, lead(h) OVER w AS nh FROM pl WINDOW w AS (PARTITION BY volume_id ORDER BY run)),
  tp AS (SELECT volume_id, (i0 + i1) // 2 AS p, h FROM pk WHERE ph < h AND nh < h), f1 AS (SELECT volume_id, arg_max(p, (h, p)) AS p1 FROM tp GROUP BY 1),
  two AS (SELECT volume_id, any_value(p1) AS p1, arg_max(p, (h, p)) AS p2 FROM tp JOIN f1 USING (volume_id) WHERE abs(p - p1) >= 51 GROUP BY 1)""")
voxel_query("equalize_512", lambda d: I.normalize(d, "histogram", 512), EQUALIZED.replace("/ 256", "/ 512").replace("255", "511"),
  (HIST + ", cdf0 AS (SELECT *, sum(cnt) OVER (ORDER BY bin)::DOUBLE / sum(cnt) OVER () AS c FROM hist), cdf AS (SELECT *, lead(c) OVER (ORDER BY bin) AS c1, lead(centre) OVER (ORDER BY bin) AS nx FROM cdf0)").replace("256", "512").replace("255", "511"))
DISK = P.disk(2)
mask_query("opening_disk", lambda m: P.opening(m, *SIZE, DISK), "SELECT * FROM o2", f"{FG}, {_eroded('e2', 'fg', DISK)}, {_dilated('o2', 'e2', DISK)}")
voxel_query("keep_bone", lambda d: dental.keep_bone(d.withColumn("bone", F.lit(230.0))), "SELECT volume_id, z, y, x, CASE WHEN v >= 0.8 * 230 THEN v ELSE 0 END AS v FROM vox")
voxel_query("tissue_split", dental.tissues, "SELECT volume_id, z, y, x, v, v >= upper AS bright FROM vox JOIN up USING (volume_id) WHERE v > 0",
  ORACLES["upper_threshold"].split(ORACLE_CTE + ", ")[1].replace(" SELECT volume_id, round(lo + (t2 + 0.5::DOUBLE) * wd, 6) AS upper", ", up AS (SELECT volume_id, lo + (t2 + 0.5::DOUBLE) * wd AS upper") + ")")
query("track_free", lambda s, d: S.track(measured(s, d), None), """SELECT volume_id, z, label FROM tr""", MEASURED + """, tr AS (
  (SELECT volume_id, z, label, cy, cx FROM reg WHERE z = 6 ORDER BY cx, cy LIMIT 1)
  UNION ALL (SELECT t.volume_id, r.z, r.label, r.cy, r.cx FROM tr t JOIN reg r ON r.z = t.z - 1 QUALIFY row_number() OVER (ORDER BY (r.cy - t.cy) * (r.cy - t.cy) + (r.cx - t.cx) * (r.cx - t.cx)) = 1))""")
TOOTH = "CASE WHEN v <= 100 OR (z BETWEEN 2 AND 4 AND y > 22) THEN 0 ELSE v END"
voxel_query("unknown_bounds", lambda d: dental.unknown_bounds(d.withColumn("v", F.expr(TOOTH)), d.select("volume_id", F.lit(130.0).alias("dentin")).distinct(), FULL, 60), """SELECT volume_id, (SELECT max(z) FROM st WHERE before > 60 AND area < 60 AND z < COALESCE((SELECT upper FROM ri), 99)) AS lower,
  (SELECT upper FROM ri) AS upper FROM vox GROUP BY volume_id""", f"""bd AS (SELECT volume_id, z, y, x FROM (SELECT volume_id, z, y, x, {TOOTH} AS v FROM vox) WHERE v > 0 AND (v <= 0.85 * 130 OR v >= 1.35 * 130)),
  {_eroded('eb', 'bd', DISK, False)}, {_labels('l4', 'eb', FOUR)}, ar AS (SELECT z, max(n) AS area FROM (SELECT z, label, count(*) AS n FROM l4 GROUP BY ALL) GROUP BY z),
  st AS (SELECT *, lag(area) OVER (ORDER BY z) AS before FROM ar), ri AS (SELECT min(z) AS upper FROM st WHERE before < 60 AND area > 60)""")
query("region_of_label", lambda s, d: labelled(s, d).withColumn("first", F.col("label") == 1), "SELECT *, label = 1 AS first FROM lab", LABELLED)
mask_query("label_3d_26", lambda m: L.label_volume(m, 3, 3, True), "SELECT volume_id, z, y, x, (dense_rank() OVER (PARTITION BY volume_id ORDER BY k))::INT AS label FROM (SELECT volume_id, z, y, x, min(k) AS k FROM r GROUP BY ALL)", FG + """, r AS (
  SELECT volume_id, z, y, x, z::BIGINT * 1024 + y * 32 + x AS k FROM fg
  UNION SELECT b.volume_id, b.z, b.y, b.x, a.k FROM r a JOIN fg b ON abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND abs(a.z - b.z) <= 1)""")


def centre_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical(spark, sf_dir).where("v BETWEEN 120 AND 159").groupBy("volume_id", "z").agg(F.min("y").alias("y"), F.min("x").alias("x"))


_WALK = """{0} AS (SELECT z, y, x, 0::DOUBLE AS d, [z] AS seen, [[z, y, x]] AS path FROM {1}
  UNION ALL SELECT p.z, p.y, p.x, r.d + sqrt(abs(p.z - r.z) + abs(p.y - r.y) + abs(p.x - r.x)), list_append(r.seen, p.z), list_append(r.path, [p.z, p.y, p.x])
  FROM {0} r JOIN pt p ON abs(p.z - r.z) <= 1 AND abs(p.y - r.y) <= 1 AND abs(p.x - r.x) <= 1 AND NOT list_contains(r.seen, p.z))"""
query("farthest_path", lambda s, d: R.path_points(centre_points(s, d)), "SELECT 'canonical' AS volume_id, (i - 1)::INT AS i, path[i][1]::DOUBLE AS z, path[i][2]::DOUBLE AS y, path[i][3]::DOUBLE AS x FROM (SELECT path FROM w2 ORDER BY d DESC LIMIT 1), range(1, 8) r(i) WHERE i <= len(path)",
  "pt AS (SELECT z, min(y) AS y, min(x) AS x FROM vox WHERE v BETWEEN 120 AND 159 GROUP BY z), p0 AS (SELECT * FROM pt ORDER BY z, y, x LIMIT 1), " + _WALK.format("w1", "p0") + ", p1 AS (SELECT z, y, x FROM w1 ORDER BY d DESC LIMIT 1), " + _WALK.format("w2", "p1"))
# Shapes: border codes by a join of neighbours, the hull by half-planes through all pairs of its outermost points.
SHAPE = LABELLED + """, bp AS (SELECT a.z, a.label, a.y, a.x FROM lab a LEFT JOIN lab b ON a.z = b.z AND a.label = b.label AND abs(a.y - b.y) + abs(a.x - b.x) = 1 GROUP BY ALL HAVING count(b.y) < 4),
code AS (SELECT a.z, a.label, 1 + 2 * count(*) FILTER (abs(a.y - b.y) + abs(a.x - b.x) = 1) + 10 * count(*) FILTER (abs(a.y - b.y) + abs(a.x - b.x) = 2) AS code
  FROM bp a JOIN bp b ON a.z = b.z AND a.label = b.label AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY a.z, a.label, a.y, a.x),
pm AS (SELECT z, label, sum(CASE WHEN code IN (5, 7, 15, 17, 25, 27) THEN 1::DOUBLE WHEN code IN (21, 33) THEN sqrt(2::DOUBLE) WHEN code IN (13, 23) THEN (1 + sqrt(2::DOUBLE)) / 2 ELSE 0 END) AS perimeter FROM code GROUP BY ALL),
tip AS (SELECT z, label, 2 * y + dy AS r, 2 * x + dx AS c FROM lab, (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) s(dy, dx)),
out AS (SELECT z, label, r, unnest([min(c), max(c)]) AS c FROM tip GROUP BY z, label, r), op_ AS (SELECT DISTINCT * FROM out),
edge AS (SELECT a.z, a.label, a.r AS r1, a.c AS c1, b.r AS r2, b.c AS c2 FROM op_ a JOIN op_ b ON a.z = b.z AND a.label = b.label AND (a.r, a.c) <> (b.r, b.c) JOIN op_ p ON p.z = a.z AND p.label = a.label
  GROUP BY ALL HAVING min((b.r - a.r) * (p.c - a.c) - (b.c - a.c) * (p.r - a.r)) >= 0),
bx AS (SELECT z, label, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1, count(*) AS area, count(*) * sum(y * y) - sum(y) * sum(y) AS yy, count(*) * sum(x * x) - sum(x) * sum(x) AS xx, count(*) * sum(y * x) - sum(y) * sum(x) AS yx FROM lab GROUP BY ALL),
hull AS (SELECT z, label, count(*) AS n FROM (SELECT b.z, b.label, g.i AS y, h.i AS x FROM bx b, range(32) g(i), range(32) h(i) JOIN edge e ON e.z = b.z AND e.label = b.label
  WHERE g.i BETWEEN y0 AND y1 AND h.i BETWEEN x0 AND x1 GROUP BY ALL HAVING min((r2 - r1) * (2 * h.i - c1) - (c2 - c1) * (2 * g.i - r1)) >= 0) GROUP BY ALL)"""
query("region_properties", lambda s, d: M.measure_regions(labelled(s, d), canonical(s, d), ("label", "area", "perimeter", "solidity", "orientation", "euler_number")), """SELECT 'canonical' AS volume_id, z, label, area, round(perimeter, 6) AS perimeter, round(area::DOUBLE / n, 6) AS solidity,
  round(CASE WHEN yy = xx THEN CASE WHEN yx > 0 THEN pi() / 4 ELSE -pi() / 4 END ELSE 0.5::DOUBLE * atan2((2 * yx)::DOUBLE, (yy - xx)::DOUBLE) END, 6) AS orientation, NULL::DOUBLE AS euler_number FROM bx JOIN pm USING (z, label) JOIN hull USING (z, label)""", SHAPE)
query("region_extra", lambda s, d: M.measure_regions(labelled(s, d), canonical(s, d), ("label", "bright_share", "extent"), {"bright_share": lambda mask, values: (values[mask] >= 140).mean(), "extent": lambda mask, values: mask.mean(), "unasked": lambda mask, values: 1 / 0}),
  "SELECT volume_id, z, label, round(avg((v >= 140)::INT), 6) AS bright_share, round(count(*)::DOUBLE / ((max(y) - min(y) + 1) * (max(x) - min(x) + 1)), 6) AS extent FROM lab JOIN vox USING (volume_id, z, y, x) GROUP BY volume_id, z, label", LABELLED)
query("default_properties", lambda s, d: M.measure_regions(labelled(s, d), canonical(s, d)).select("volume_id", "z", "label", "area", F.round(F.col("centroid")[0], 6).alias("centroid_y"), F.round(F.col("centroid")[1], 6).alias("centroid_x"), "mean_intensity"),
  "SELECT volume_id, z, label, area, round(cy, 6) AS centroid_y, round(cx, 6) AS centroid_x, round(mean_intensity, 6) AS mean_intensity FROM reg", MEASURED)
query("slice_summary", lambda s, d: M.slice_summary(measured(s, d)), """SELECT volume_id, z, count(*) AS num_regions, sum(area)::BIGINT AS total_area, round(avg(area), 6) AS mean_area, round(stddev_pop(area), 6) AS std_area, round(avg(mean_intensity), 6) AS mean_intensity,
  round(stddev_pop(mean_intensity), 6) AS std_intensity, max(area) AS max_area, min(area) AS min_area, round(max(mean_intensity), 6) AS max_intensity, round(min(mean_intensity), 6) AS min_intensity FROM reg GROUP BY ALL""", MEASURED)
query("compare_by_place", lambda s, d: M.compare_regions(M.measure_regions(labelled(s, d), canonical(s, d), ("label", "area", "mean_intensity", "solidity")), (1, 0)), """SELECT a.volume_id, a.z, a.label AS label_1, b.label AS label_2, a.area AS area_1, b.area AS area_2, round(a.mean_intensity, 6) AS mean_intensity_1, round(b.mean_intensity, 6) AS mean_intensity_2,
  round(a.area::DOUBLE / ha.n, 6) AS solidity_1, round(b.area::DOUBLE / hb.n, 6) AS solidity_2, a.area - b.area AS area_difference, round(a.area / b.area::DOUBLE, 6) AS area_ratio, round(a.mean_intensity - b.mean_intensity, 6) AS intensity_difference, round(a.mean_intensity / b.mean_intensity, 6) AS intensity_ratio
  FROM reg a JOIN reg b ON a.volume_id = b.volume_id AND a.z = b.z AND a.label = 2 AND b.label = 1 JOIN hull ha ON ha.z = a.z AND ha.label = a.label JOIN hull hb ON hb.z = b.z AND hb.label = b.label""", SHAPE + MEASURED.removeprefix(AREA))


def tiff_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The volume written as a TIFF file and read again."""
    folder = f"{shared_folder(spark)}/tiff-{uuid.uuid4().hex}"
    sinks.save_tiff(canonical(spark, sf_dir), folder.removeprefix("file:"), "volume.tif", *SIZE).collect()
    return images.tiff_stack(spark, f"{folder}/canonical")


query("tiff_roundtrip", tiff_roundtrip, "SELECT volume_id, z, y, x, v::DOUBLE AS v FROM vox")
# Jaw workflows: what the steps above give, put together.
CENTRES = "rg AS (SELECT volume_id, z, label, avg(y) AS cy, avg(x) AS cx, count(*) AS area FROM l5 GROUP BY ALL)"
NEAREST = "QUALIFY row_number() OVER (ORDER BY (r.cy - t.cy) * (r.cy - t.cy) + (r.cx - t.cx) * (r.cx - t.cx)) = 1"


def _followed(growth: str) -> str:
    """fw: pixels of the region followed from the last slice down, among the edge-connected parts of lab."""
    return f"""{_labels('l5', 'lab', FOUR)}, {CENTRES}, tr AS ((SELECT volume_id, z, label, cy, cx, area FROM rg WHERE z = 6 ORDER BY cx, cy LIMIT 1)
      UNION ALL (SELECT t.volume_id, r.z, r.label, r.cy, r.cx, r.area FROM tr t JOIN rg r ON r.z = t.z - 1 {growth} {NEAREST})), fw AS (SELECT volume_id, z, y, x FROM l5 SEMI JOIN tr USING (volume_id, z, label))"""


def _solid(name: str, source: str) -> str:
    """Face-connected 3-D labels k (the least raster key) of a mask, as name, and their sizes, as name_n."""
    return f"""{name}_r AS (SELECT volume_id, z, y, x, z * 1024 + y * 32 + x AS k FROM {source}
      UNION SELECT b.volume_id, b.z, b.y, b.x, a.k FROM {name}_r a JOIN {source} b ON abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) = 1),
      {name} AS (SELECT volume_id, z, y, x, min(k) AS k FROM {name}_r GROUP BY ALL), {name}_n AS (SELECT k, count(*) AS n FROM {name} GROUP BY k)"""


def _closed(name: str, source: str) -> str:
    return f"{_dilated_3d(name + '_d', source)}, {_eroded_3d(name, name + '_d', True)}"


FLOAT_AT = "SELECT volume_id, z, arg_max(v, (round(COALESCE(n0 * (n - n0) * (s0 / n0 - (s - s0) / NULLIF(n - n0, 0)) * (s0 / n0 - (s - s0) / NULLIF(n - n0, 0)), 0), 6), -k)) AS t FROM ps GROUP BY ALL"
LARGEST = "SELECT volume_id, z, y, x FROM sd WHERE k = (SELECT arg_max(k, (n, -k)) FROM sd_n)"
voxel_query("incisor", lambda d: dental.segment_incisor(d, FULL, 3, 50), LARGEST, f"{OTSU}, ot AS ({AT}), fo AS (SELECT volume_id, z, y, x FROM vox JOIN ot USING (volume_id, z) WHERE v > t), {_cleaned('fo', 50)}, {_followed('AND r.area <= 2 * t.area')}, {_closed('sh', 'fw')}, {_solid('sd', 'sh')}")
SMOOTHED = f"{_gauss('w1', 1.0)}, {_blurred('sm', 'vox', 'w1', ALONG)}, {_float_levels(256, 'volume_id, z', 'sm')}, ot AS ({FLOAT_AT}), fo AS (SELECT sm.volume_id, sm.z, y, x FROM sm JOIN ot USING (volume_id, z) WHERE sm.v > t)"
voxel_query("jaw_bone", lambda d: dental.segment_bone(d, FULL, 1.0, 50, 3), LARGEST, f"{SMOOTHED}, {_cleaned('fo', 50)}, {_followed('')}, {_closed('sh', 'fw')}, {_solid('sd', 'sh')}")


def molar_bone(voxels: DataFrame) -> DataFrame:
    bone, molars = dental.segment_molar_bone(voxels, FULL, 3)
    return bone.withColumn("part", F.lit("bone")).unionByName(molars.withColumn("part", F.lit("molars")))


#: A second disc that is large enough to be a tooth.
JAW = "CASE WHEN (x - 8) * (x - 8) + (y - 8 - z) * (y - 8 - z) <= 45 THEN 150 ELSE v END"
voxel_query("molar_bone", lambda d: molar_bone(d.withColumn("v", F.expr(JAW))), """SELECT volume_id, z, y, x, CASE WHEN rk = 1 THEN 'bone' ELSE 'molars' END AS part FROM sd JOIN rk USING (k) WHERE rk = 1 OR n >= 0.5 * (SELECT max(n) FROM rk WHERE rk > 1)""",
  f"jv AS (SELECT volume_id, z, y, x, {JAW} AS v FROM vox), {SMOOTHED.replace('vox', 'jv')}, {_cleaned('fo', 100)}, ms AS (SELECT volume_id, z, y, x FROM lab), {_closed('sh', 'ms')}, {_solid('sd', 'sh')}, rk AS (SELECT *, row_number() OVER (ORDER BY n DESC, k) AS rk FROM sd_n)")
voxel_query("bone_intensity", lambda d: dental.bone_intensity(d, FULL, 2, 1.0, 20), """SELECT volume_id, round(min(m), 6) AS bone FROM (SELECT sm.volume_id, sm.z, avg(sm.v) AS m FROM sm JOIN lab USING (volume_id, z, y, x) SEMI JOIN lg ON lg.z = sm.z AND lg.label = lab.label GROUP BY sm.volume_id, sm.z) GROUP BY 1""",
  f"""{_gauss('w1', 1.0)}, md AS (SELECT volume_id, z - 1 AS z, y, x, v FROM vox WHERE z BETWEEN 1 AND 4), {_blurred('sm', 'md', 'w1', ALONG | {'z': 4})}, {_float_levels(256, 'volume_id, z', 'sm')}, ot AS ({FLOAT_AT}),
  fo AS (SELECT sm.volume_id, sm.z, y, x FROM sm JOIN ot USING (volume_id, z) WHERE sm.v > t), {_cleaned('fo', 20)}, lg AS (SELECT z, arg_max(label, (n, -label)) AS label FROM (SELECT z, label, count(*) AS n FROM lab GROUP BY ALL) GROUP BY z)""")  # fmt: skip
def _tiled(source: str) -> str:
    """Clipped histograms of 8 x 8 tiles of 4 x 4 pixels (a bin keeps one), their curves, and what pixels read of the four nearest, as co."""
    slice_ = "volume_id, z"
    near = lambda c: f"greatest(0, least(7, ({c} + 0.5::DOUBLE) / 4 - 0.5::DOUBLE))"
    part = lambda k, c: f"CASE WHEN {k} = 0 THEN 1 - (p{c} - {c}0) ELSE p{c} - {c}0 END"
    return f"""cb AS (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi FROM {source} WINDOW w AS (PARTITION BY {slice_})),
    cg AS (SELECT {slice_}, y, x, y // 4 AS ty, x // 4 AS tx, least(floor((v - lo)::DOUBLE / (hi - lo)::DOUBLE * 256), 255)::INT AS g FROM cb),
    ch AS (SELECT {slice_}, ty, tx, g, count(*) AS n FROM cg GROUP BY ALL), ce AS (SELECT {slice_}, ty, tx, sum(n - 1)::DOUBLE / 256 AS spread FROM ch GROUP BY ALL),
    cl AS (SELECT {slice_}, ty, tx, p.g, spread, count(ch.n) OVER (PARTITION BY {slice_}, ty, tx ORDER BY p.g) AS below FROM ce CROSS JOIN range(256) p(g) LEFT JOIN ch USING ({slice_}, ty, tx, g)),
    cc AS (SELECT {slice_}, ty, tx, g, (below + spread * (g + 1)) / 16 AS c FROM cl),
    ct AS (SELECT *, least(floor(py), 6)::INT AS y0, least(floor(px), 6)::INT AS x0 FROM (SELECT *, {near('y')} AS py, {near('x')} AS px FROM cg)),
    co AS (SELECT t.volume_id, t.z, t.y, t.x, sum(({part('a', 'y')}) * ({part('b', 'x')}) * c) AS v FROM ct t CROSS JOIN range(2) i(a) CROSS JOIN range(2) j(b)
      JOIN cc ON cc.volume_id = t.volume_id AND cc.z = t.z AND cc.ty = y0 + a AND cc.tx = x0 + b AND cc.g = t.g GROUP BY ALL)"""


voxel_query("clahe", lambda d: N.clahe(d, *SIZE), SPREAD.format("co"), _tiled("vox"))
voxel_query("enhance_edges", lambda d: N.enhance_edges(d, FULL, 1.0, True, 3), SPREAD.format("co"), f"{EDGES}, {_tiled('gr')}")
# Sequential algorithms: hand-made goldens in the tests stand for SQL.
voxel_query("watershed", lambda d: G.segment(d, *SIZE, "watershed", 20, min_distance=4), "")
voxel_query("skeleton", lambda d: N.skeleton(foreground(d)), "")
voxel_query("curved_reslice", lambda d: R.cmpr(d.where("v BETWEEN 120 AND 159"), FULL, 9, 1.0, 1.0, 3)["volume"], "")
voxel_query("centerline_mask", lambda d: R.cmpr(d.where("v BETWEEN 120 AND 159"), FULL, 9, 1.0, 1.0, 3)["centerline_mask"], "")
