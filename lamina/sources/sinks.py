"""Results as JSON, CSV, workbook, text and TIFF (SNK1-8).

Tables of voxels stay distributed: write them with ``DataFrame.write``.  What
is collected here is the roll-up of an analysis: a row a slice or less, or a
row a region for the workbook's third sheet.
"""

from __future__ import annotations

import csv
import json
import os
import zipfile
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from lamina.sources import tiff

FORMATS = {"json": "json", "csv": "csv", "xlsx": "excel", "xls": "excel"}


def format_of(path: str) -> str:
    """The format that a file name's ending asks for; JSON for any other."""
    return FORMATS.get(path.rsplit(".", 1)[-1].lower(), "json")


def save(results: dict, path: str, format: str | None = None) -> None:
    """Writes an analysis; bare file names are fine, an unknown format is an error.

    Numbers stay numbers.  CSV is the cross-slice roll-up, nested cells
    flattened as ``area_stats.mean``; a workbook has the sheets Summary,
    Segmentation and Regions.
    """
    if not results:
        raise ValueError("no results to save")
    format = format or format_of(path)
    folder = os.path.dirname(path)
    if folder:
        os.makedirs(folder, exist_ok=True)
    region = results.get("region_analysis") or {}
    if format == "json":
        with open(path, "w", encoding="utf-8") as f:
            json.dump(results, f, indent=2)
    elif format == "csv":
        row = _flat(region.get("cross_slice_stats", {}))
        with open(path, "w", newline="", encoding="utf-8") as f:
            out = csv.writer(f)
            out.writerows([list(row), list(row.values())])
    elif format == "excel":
        workbook(path, {"Summary": [_flat(region.get("cross_slice_stats", {}))], "Segmentation": results.get("segmentation_stats", []), "Regions": region.get("regions", [])})
    else:
        raise ValueError(f"unknown format: {format}")


def _flat(row: dict, before: str = "") -> dict:
    out = {}
    for k, v in row.items():
        out |= _flat(v, f"{before}{k}.") if isinstance(v, dict) else {before + k: v}
    return out


def workbook(path: str, sheets: dict[str, list[dict]]) -> None:
    """A minimal Office Open XML workbook, one sheet a table."""
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    link = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"

    def cell(v) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, (int, float)) and not isinstance(v, bool) and np.isfinite(v):
            return f"<c><v>{v}</v></c>"
        return f'<c t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'

    def sheet(rows: list[dict]) -> str:
        lines = [list(rows[0])] + [list(r.values()) for r in rows] if rows else []
        return f'{head}<worksheet xmlns="{main}"><sheetData>' + "".join(f"<row>{''.join(map(cell, r))}</row>" for r in lines) + "</sheetData></worksheet>"

    ids = range(1, len(sheets) + 1)
    names = "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="r{k}"/>' for k, n in zip(ids, sheets))
    rels = "".join(f'<Relationship Id="r{k}" Type="{link}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in ids)
    types = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>' for k in ids)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{types}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{pack}/relationships"><Relationship Id="r0" Type="{link}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{link}"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{pack}/relationships">{rels}</Relationships>')
        for k, rows in zip(ids, sheets.values()):
            z.writestr(f"xl/worksheets/sheet{k}.xml", sheet(rows))


def report(results: dict) -> str:
    """A short text of what was found; parts that weren't computed are left out."""
    if not results:
        return "No analysis results available."
    rule, lines = "=" * 50, ["VOLUME ANALYSIS SUMMARY"]
    if info := results.get("volume_info"):
        lines += ["", "Volume:", f"  Shape: {tuple(info['shape'])}", f"  Values: {info['min_value']} - {info['max_value']}", f"  Mean: {info['mean_value']:.2f}"]
    if "segmentation_stats" in results:
        n = [s["num_regions"] for s in results["segmentation_stats"]]
        lines += ["", "Segmentation:", f"  Regions: {sum(n)}", f"  Regions per slice: {sum(n) / len(n) if n else 0:.1f}"]
    if region := results.get("region_analysis"):
        s = region["cross_slice_stats"]
        lines += ["", "Regions:", f"  Slices: {s['total_slices_analyzed']}", f"  Regions: {s['total_regions']}", f"  Per slice: {s['mean_regions_per_slice']:.1f}"]
        if a := s.get("area_stats"):
            lines += [f"  Area: mean {a['mean']:.1f}, deviation {a['std']:.1f}, {a['min']:.1f} - {a['max']:.1f}"]
    return "\n".join([rule, *lines, rule])


def _whole(folder: str, volume: str, name: str, write) -> str:
    """The path of a volume's file, which appears under its name only once write has ended."""
    os.makedirs(os.path.join(folder, volume), exist_ok=True)
    path = os.path.join(folder, volume, name)
    part = f"{path}.{os.getpid()}"
    with open(part, "wb") as f:
        write(f)
    os.replace(part, path)
    return path


def save_csv(rows: DataFrame, folder: str, name: str, order: str) -> DataFrame:
    """Writes ``folder/<volume_id>/name`` (``{volume}`` in it standing for the id) for each volume, in order of a column, and returns (volume_id, path).

    folder must be one that all executors reach; a volume is one task.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        volume = part["volume_id"].iloc[0]
        text = part.drop(columns="volume_id").sort_values(order).to_csv(index=False)
        path = _whole(folder, volume, name.replace("{volume}", volume), lambda f: f.write(text.encode()))
        return pd.DataFrame({"volume_id": [volume], "path": [path]})

    return rows.groupBy("volume_id").applyInPandas(run, "volume_id string, path string")


def save_tiff(voxels: DataFrame, folder: str, name: str, height: int, width: int, depth: int | None = None) -> DataFrame:
    """Writes ``folder/<volume_id>/name`` for each volume and returns (volume_id, path, slices).

    folder must be one that all executors reach; a volume is one task, its
    slices in order, a page at a time; depth None ends at the last slice with
    voxels.  The file appears under its name only
    once it is whole, so a task that is run again does no harm.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        volume = rows["volume_id"].iloc[0]
        deep = depth or int(rows["z"].max()) + 1
        by = {z: g for z, g in rows.groupby("z")}

        def pages():
            for z in range(deep):
                a = np.zeros((height, width), rows["v"].dtype)
                if z in by:
                    a[by[z]["y"], by[z]["x"]] = by[z]["v"]
                yield a

        path = _whole(folder, volume, name, lambda f: tiff.write(f, pages()))
        return pd.DataFrame({"volume_id": [volume], "path": [path], "slices": [deep]})

    return voxels.select("volume_id", "z", "y", "x", "v").groupBy("volume_id").applyInPandas(run, "volume_id string, path string, slices int")
