"""Command lines of the jaw workflows (ORC8, ORC9): scans to parts, incisor to resliced planes, planes to enamel curves.

    python -m lamina.plans.jaw segment SCANS PARTS
    python -m lamina.plans.jaw reslice PARTS PLANES --slice_size 64 --spacing 1.0
    python -m lamina.plans.jaw enamel PLANES CURVES

A folder holds a sub-folder for each volume; a volume whose last file is there
already is left out.  Volumes of one size are one job.
"""

from __future__ import annotations

import argparse
import logging
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators.blocks import Size
from lamina.operators.reslice import cmpr
from lamina.plans import dental
from lamina.sources import images, sinks

log = logging.getLogger("lamina")
PARTS = {"incisor": "incisor_volume.tif", "bone": "bone_volume.tif", "molars": "molar_volume.tif"}
PLANES = "resliced_volume.tif"


def made(spark: SparkSession, folder: str, name: str) -> set[str]:
    """Volumes whose sub-folder of folder has a file of that name, ``{volume}`` in it standing for the volume's."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/*/{name.replace('{volume}', '*')}")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    return {f.getPath().getParent().getName() for f in found}


def by_size(voxels: DataFrame) -> dict[Size, list[str]]:
    """Volumes by (depth, height, width); a row a volume comes to the driver."""
    out: dict[Size, list[str]] = {}
    for r in voxels.groupBy("volume_id").agg(*[(F.max(c) + 1).alias(c) for c in "zyx"]).collect():
        out.setdefault((r.z, r.y, r.x), []).append(r.volume_id)
    return out


def stage(voxels: DataFrame, done: set[str], work: Callable[[DataFrame, Size], None]) -> list[str]:
    """work on the volumes that aren't done, those of one size together; their names."""
    rows = voxels.where(~F.col("volume_id").isin(sorted(done))) if done else voxels
    todo = by_size(rows)
    for size, names in todo.items():
        log.info("%s: %s", size, ", ".join(sorted(names)))
        work(rows.where(F.col("volume_id").isin(names)), size)
    return sorted(n for names in todo.values() for n in names)


def segment(spark: SparkSession, scans: str, parts: str) -> list[str]:
    """Incisor, bone and molars of every scan that has none yet, as TIFF files."""

    def work(voxels: DataFrame, size: Size) -> None:
        found = dental.segment_mandible(voxels, size)
        for part, name in reversed(PARTS.items()):
            sinks.save_tiff(found[part], parts, name, *size[1:], depth=size[0]).collect()

    return stage(images.image_stack(spark, scans, nested=True), made(spark, parts, PARTS["incisor"]), work)


def reslice(spark: SparkSession, parts: str, planes: str, slice_size: int = 64, spacing: float = 1.0) -> list[str]:
    """Planes across every incisor's centre line, as TIFF files."""

    def work(voxels: DataFrame, size: Size) -> None:
        sinks.save_tiff(cmpr(voxels, size, slice_size, spacing)["volume"], planes, PLANES, slice_size, slice_size).collect()

    return stage(images.tiff_stack(spark, f"{parts}/*", PARTS["incisor"]), made(spark, planes, PLANES), work)


def enamel(spark: SparkSession, planes: str, curves: str) -> list[str]:
    """Enamel against dentin along every volume's planes, as <volume>_results.csv."""

    def work(voxels: DataFrame, size: Size) -> None:
        sinks.save_csv(dental.enamel_curve(voxels, size).drop("z"), curves, "{volume}_results.csv", "slice_percentage").collect()

    return stage(images.tiff_stack(spark, f"{planes}/*", PLANES), made(spark, curves, "{volume}_results.csv"), work)


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="jaw", description="Parts of a mandible, planes across the incisor, enamel curves.")
    stages = p.add_subparsers(dest="stage", required=True)
    for name, what in (("segment", "scans to parts"), ("reslice", "incisors to planes"), ("enamel", "planes to curves")):
        s = stages.add_parser(name, help=what)
        s.add_argument("input")
        s.add_argument("output")
        s.add_argument("-l", "--log", action="store_true")
        if name == "reslice":
            s.add_argument("--slice_size", type=int, default=64)
            s.add_argument("--spacing", type=float, default=1.0)
    return p.parse_args(given)


def main(given: list[str] | None = None) -> int:
    """0, or 1 where something failed."""
    a = arguments(given)
    logging.basicConfig(level=logging.INFO if a.log else logging.WARNING, format="%(asctime)s %(levelname)s %(message)s")
    spark = SparkSession.builder.appName("jaw").getOrCreate()
    try:
        if a.stage == "reslice":
            new = reslice(spark, a.input, a.output, a.slice_size, a.spacing)
        else:
            new = {"segment": segment, "enamel": enamel}[a.stage](spark, a.input, a.output)
        log.info("%d volumes done, the others were there", len(new))
    except Exception:
        log.exception("the stage failed")
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
