"""The canonical volume: voxels derived from the driver's lineitem table.

voxels(volume_id, z, y, x, v) is the engine's relational form of a volume; a
mask is the same without v, holding true voxels only; labels add ``label``.
"""

from pyspark.sql import DataFrame, SparkSession

DEPTH, HEIGHT, WIDTH = 7, 32, 32
FRAME = ["volume_id", "z", "y", "x"]

_BODY = """
noise AS (
  SELECT l_linenumber - 1 AS z, l_orderkey % 32 AS y, l_partkey % 32 AS x,
         CAST(SUM(CAST(l_quantity AS BIGINT)) % 40 AS BIGINT) AS nz
  FROM {lineitem} GROUP BY 1, 2, 3
), vox AS (
  SELECT 'canonical' AS volume_id, CAST(g.z AS INT) AS z, CAST(g.y AS INT) AS y, CAST(g.x AS INT) AS x,
         CAST(COALESCE(nz, 0) + CASE WHEN (g.x - 8) * (g.x - 8) + (g.y - 8 - g.z) * (g.y - 8 - g.z) <= 25 THEN 120
                                     WHEN (g.x - 22) * (g.x - 22) + (g.y - 22) * (g.y - 22) <= 49 THEN 190
                                     ELSE 0 END AS INT) AS v
  FROM grid g LEFT JOIN noise n ON n.z = g.z AND n.y = g.y AND n.x = g.x
)
"""
#: The same CTEs for DuckDB, to stand before an oracle's own.
ORACLE_CTE = "grid AS (SELECT z.i AS z, y.i AS y, x.i AS x FROM range(7) z(i), range(32) y(i), range(32) x(i))," + _BODY.format(lineitem="lineitem")


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = "grid AS (SELECT z.id AS z, y.id AS y, x.id AS x FROM range(7) z, range(32) y, range(32) x),"
    return spark.sql(f"WITH {grid} {_BODY.format(lineitem='{lineitem}')} SELECT * FROM vox", lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def foreground(voxels: DataFrame, threshold: float = 100) -> DataFrame:
    """Mask of the voxels strictly above a manual threshold (THR4, PRD1 at 0)."""
    return voxels.where(voxels.v > threshold).select(*FRAME)
