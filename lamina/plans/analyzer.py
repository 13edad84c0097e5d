"""The whole analysis of one volume, as an object and as a command line (ORC1-7, VIZ2-6, MEA9)."""

from __future__ import annotations

import argparse
import logging
import sys
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamina.operators import intensity, measure
from lamina.operators.segmentation import METHODS, segment
from lamina.sources import images, sinks

log = logging.getLogger("lamina")


@dataclass
class Analyzer:
    """Loads, segments and measures a volume; frames stay lazy, roll-ups are in ``results``.

    Options of loading and of segmenting are separate dictionaries.
    """

    voxels: DataFrame | None = None
    method: str = "otsu"
    min_area: int = 100
    normalize: bool = True
    normalization: str = "minmax"
    options: dict = field(default_factory=dict)
    results: dict = field(default_factory=dict)
    labels: DataFrame | None = None
    shape: tuple[int, int, int] | None = None

    def load(self, spark: SparkSession, directory: str, **loading) -> DataFrame:
        found = images.image_stack(spark, directory, **loading)
        self.voxels = intensity.normalize(found, self.normalization) if self.normalize else found
        i = intensity.volume_info(self.voxels).first()
        self.shape = (i.depth, i.height, i.width)
        self.results["volume_info"] = {"shape": list(self.shape), "dtype": dict(self.voxels.dtypes)["v"], "min_value": i.min_v, "max_value": i.max_v, "mean_value": i.mean_v, "std_value": i.std_v}
        return self.voxels

    def segment(self) -> DataFrame:
        if self.voxels is None:
            raise ValueError("no volume: load one first")
        if self.shape is None:
            i = intensity.volume_info(self.voxels).first()
            self.shape = (i.depth, i.height, i.width)
        self.labels = segment(self.voxels, *self.shape[1:], self.method, self.min_area, **self.options).persist()
        every = self.voxels.select("volume_id", "z").distinct()
        self.results["segmentation_stats"] = [r.asDict() for r in measure.segmentation_stats(self.labels, every).drop("volume_id").orderBy("z").collect()]
        return self.labels

    def regions(self, slice_range: tuple[int, int] | None = None) -> DataFrame:
        """Regions of the slices asked for, and their roll-up in results."""
        if self.labels is None:
            raise ValueError("not segmented: segment first")
        start, end = slice_range or (0, self.shape[0])
        labels = intensity.slice_range(self.labels, start, end, self.shape[0])
        # The same bounds on both sides, so both scans read the range only.
        found = measure.regions(labels, intensity.slice_range(self.voxels, start, end, self.shape[0])).persist()
        rows = [r.asDict() for r in found.drop("volume_id").orderBy("z", "label").collect()]
        self.results["region_analysis"] = {"cross_slice_stats": roll_up(found, end - start), "regions": rows}
        return found

    def run(self, spark: SparkSession, directory: str, slice_range: tuple[int, int] | None = None, **loading) -> dict:
        self.load(spark, directory, **loading)
        self.segment()
        self.regions(slice_range)
        self.results["metadata"] = {"input_directory": directory, "segmentation_method": self.method, "min_area": self.min_area, "slice_range": list(slice_range) if slice_range else None,
                                    "analyzed_at": datetime.now(timezone.utc).isoformat()}
        return self.results

    def save(self, path: str, format: str | None = None) -> None:
        sinks.save(self.results, path, format)

    def report(self) -> str:
        return sinks.report(self.results)


def analyze_volume(voxels: DataFrame, method: str = "otsu", min_area: int = 100, slice_range: tuple[int, int] | None = None, **options) -> dict:
    """Segmentation and region roll-ups of a volume at hand, as it is."""
    a = Analyzer(voxels, method, min_area, options=options)
    a.segment()
    a.regions(slice_range)
    return a.results


def roll_up(regions: DataFrame, n_slices: int) -> dict:
    """Over regions of all slices, not pixels; without regions means are NaN and extremes 0."""
    stats = lambda c: [F.avg(c), F.stddev_pop(c), F.min(c), F.max(c)]
    n, *v = regions.agg(F.count("*"), *stats(F.col("area").cast("double")), *stats(F.col("mean_intensity"))).first()
    nan = float("nan")
    pack = lambda x: {"mean": x[0], "std": x[1], "min": x[2], "max": x[3]} if n else {"mean": nan, "std": nan, "min": 0.0, "max": 0.0}
    return {"total_slices_analyzed": n_slices, "total_regions": n, "mean_regions_per_slice": n / n_slices if n_slices else 0.0, "area_stats": pack(v[:4]), "intensity_stats": pack(v[4:])}


def plot_histogram(rows: DataFrame, column: str, bins: int) -> DataFrame:
    """bin, centre and cnt of a column over all rows: what a histogram draws."""
    return intensity.histogram(rows.select(F.lit("all").alias("volume_id"), F.col(column).cast("double").alias("v")), bins).drop("volume_id")


def region_plots(regions: DataFrame) -> dict[str, DataFrame]:
    """Data of the region charts: regions per slice, areas, intensities, area against intensity."""
    return {"per_slice": regions.groupBy("volume_id", "z").agg(F.count("*").alias("num_regions")), "areas": plot_histogram(regions, "area", 50),
            "intensities": plot_histogram(regions, "mean_intensity", 50), "pairs": regions.select("volume_id", "z", "label", "area", "mean_intensity")}


def segmentation_plots(stats: DataFrame) -> dict[str, DataFrame]:
    """Data of the segmentation charts: counts and areas per slice, a histogram of counts."""
    return {"per_slice": stats.select("volume_id", "z", "num_regions", "total_area", "mean_area"), "counts": plot_histogram(stats, "num_regions", 20)}


def comparison_plots(regions: DataFrame) -> DataFrame:
    """Differences and ratios of each slice's two largest regions; infinite ratios are drawn as 1."""
    found = measure.compare_top_two(regions)
    finite = lambda c: F.when(F.col(c) == float("inf"), F.lit(1.0)).otherwise(F.col(c)).alias(c)
    return found.select("volume_id", "z", "area_difference", "intensity_difference", finite("area_ratio"), finite("intensity_ratio"))


def slice_overlay(voxels: DataFrame, labels: DataFrame, z: int) -> DataFrame:
    """One slice's pixels with their label, 0 for background."""
    at = F.col("z") == z
    return voxels.where(at).join(labels.where(at), ["volume_id", "z", "y", "x"], "left").na.fill(0, ["label"])


def skipping_done(volumes: DataFrame, done: DataFrame) -> DataFrame:
    """Volumes that have no result yet."""
    return volumes.join(done, "volume_id", "left_anti")


def slice_numbers(rows: DataFrame) -> DataFrame:
    """Slices of each volume numbered from the other end."""
    return rows.withColumn("z", F.max("z").over(W.partitionBy("volume_id")) - F.col("z"))


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="lamina", description="Segments and measures a folder of image slices.")
    p.add_argument("input_directory")
    p.add_argument("-o", "--output", required=True, help="a .json, .csv or .xlsx file")
    p.add_argument("--segmentation-method", choices=METHODS, default="otsu")
    p.add_argument("--min-area", type=int, default=100)
    p.add_argument("--slice-range", nargs=2, type=int, metavar=("START", "END"))
    p.add_argument("--normalize", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--normalization-method", choices=("minmax", "zscore", "histogram"), default="minmax")
    p.add_argument("--visualize", action="store_true", help="compute the data of the charts")
    p.add_argument("--save-plots", metavar="FOLDER", help="write that data there as Parquet")
    p.add_argument("--summary-report", action="store_true")
    p.add_argument("-v", "--verbose", action="store_true")
    return p.parse_args(given)


def main(given: list[str] | None = None) -> int:
    """0, or 1 where something failed."""
    a = arguments(given)
    logging.basicConfig(level=logging.DEBUG if a.verbose else logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = SparkSession.builder.appName("lamina").getOrCreate()
    try:
        job = Analyzer(method=a.segmentation_method, min_area=a.min_area, normalize=a.normalize, normalization=a.normalization_method)
        job.run(spark, a.input_directory, tuple(a.slice_range) if a.slice_range else None)
        job.save(a.output)
        if a.summary_report:
            print(job.report())
        if a.visualize or a.save_plots:
            found = job.regions(tuple(a.slice_range) if a.slice_range else None)
            charts = region_plots(found) | {f"segmentation_{k}": v for k, v in segmentation_plots(measure.segmentation_stats(job.labels, job.voxels.select("volume_id", "z").distinct())).items()}
            charts["comparison"] = comparison_plots(found)
            for name, frame in charts.items():
                if a.save_plots:
                    frame.write.mode("overwrite").parquet(f"{a.save_plots}/{name}")
                else:
                    frame.show(truncate=False)
    except Exception:
        log.exception("the analysis failed")
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
