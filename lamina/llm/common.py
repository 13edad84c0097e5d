"""What the operators of this subpackage share: lineage cuts and table paths."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


T = TypeVar("T")
#: Rows of an Arrow batch for tables with texts; a batch is held in memory on both sides of the pipe.
BATCH_ROWS = 1000
_held: dict[object, object] = {}


def held(key: object, make: Callable[[], T]) -> T:
    """A worker's one large object: what make() gave for this key; that of another key is let go.

    Spark reuses Python workers for later stages, so caches of one operator
    would otherwise sit beside those of the next.
    """
    if key not in _held:
        _held.clear()
        trim()
        _held[key] = make()
    return _held[key]  # type: ignore[return-value]


def trim() -> None:
    """Gives freed memory back to the system, where the C library can."""
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release:
        release(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; the session's Arrow batches are made small, unless it has set a size itself."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``.

    Only where none is set on a single machine (as in tests) is a temporary one
    made; a cluster without one is an error, as executors share no local folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints"))
    return sc.getCheckpointDir()


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder in whatever store it is in."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """df, written to the shared folder, so that its lineage ends and a lost executor costs a read."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def training_row(column: str = "doc_id") -> F.Column:
    """Rows a model may learn from: crc32 of the id as text, modulo 3, is not 1."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 != 1, F.lit(False))


def held_out(column: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))
