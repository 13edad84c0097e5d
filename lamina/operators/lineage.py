"""Cuts of lineage for operators that iterate."""

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where the session names none on one machine (as in tests)."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lamina"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder, so what follows reads it and a lost executor costs a read."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a table that is sent to every executor: a few hundred bytes each.
SENT_ROWS = 100_000


def beside(rows: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """rows joined with a table that has a few rows a volume.

    The table is written and counted first, and sent to all executors up to
    SENT_ROWS rows, so the voxels stay where they are; beyond that it is a join
    by key.
    """
    small = cut(small)
    return rows.join(F.broadcast(small) if small.count() <= SENT_ROWS else small, on)
