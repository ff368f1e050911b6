"""The report: a nested document and the grids in tiles, packed into a page."""

from __future__ import annotations

import base64
import gzip
import io
import json
from typing import TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import density, smooth
from .folders import written

#: Scaled values from here on are drawn.
SHOWN = 0.02

PAGE = """<!doctype html>
<meta charset="utf-8"><title>Point density</title>
<h1>Point density</h1>
<canvas id="map" width="1440" height="720"></canvas>
<p>Grid: <select id="grid"></select></p>
<pre id="summary"></pre>
"""

#: One part of the report each; the first is the document, the others are tiles.
PART = '<script class="{kind}" type="application/gzip+base64">{packed}</script>\n'

DRAWING = """<script>
const unpack = part => new Response(new Blob([Uint8Array.from(atob(part.textContent), c => c.charCodeAt(0))]).stream().pipeThrough(new DecompressionStream("gzip"))).json();
const canvas = document.getElementById("map"), pen = canvas.getContext("2d"), choice = document.getElementById("grid");
const place = ([lon, lat]) => [(lon + 180) * 4, (90 - lat) * 4];
const outline = lines => {
  pen.strokeStyle = "#888";
  for (const line of lines) {
    pen.beginPath();
    line.forEach((p, k) => k ? pen.lineTo(...place(p)) : pen.moveTo(...place(p)));
    pen.stroke();
  }
};
const fill = (x, y, step, z) => {
  pen.fillStyle = `rgba(200, 30, 0, ${z})`;
  pen.fillRect(x * step, 720 - (y + 1) * step, step, step);
};
// A grid as it was counted, tile by tile.
const draw = async (report, res) => {
  const most = Math.log(1 + report.histograms[res].max);
  for (const part of document.querySelectorAll(`.tile-${res}`)) {
    const tile = await unpack(part);
    let at = 0;
    tile.steps.forEach((step, k) => {
      at += step;
      fill(tile.tx * report.tile + Math.floor(at / report.tile), tile.ty * report.tile + at % report.tile, 1440 / res, Math.log(1 + tile.values[k]) / most);
    });
  }
};
unpack(document.querySelector(".document")).then(report => {
  outline(report.boundaries);
  report.shown.forEach(c => fill(c.x, c.y, 1440 / report.shown_resolution, c.z));
  choice.add(new Option("blurred", ""));
  Object.keys(report.histograms).forEach(res => choice.add(new Option(res, res)));
  choice.onchange = async () => {
    pen.clearRect(0, 0, 1440, 720);
    outline(report.boundaries);
    if (choice.value) await draw(report, choice.value); else report.shown.forEach(c => fill(c.x, c.y, 1440 / report.shown_resolution, c.z));
  };
  document.getElementById("summary").textContent = JSON.stringify({points: report.total_points, peaks: report.peaks, views: report.local_views.map(v => v.total_points), states: report.state_counts}, null, 1);
});
</script>
"""


def document(points: DataFrame, resolutions: list[int], n_peaks: int = 10, radius_km: float = 50.0, local_resolution: int = 200, zones: DataFrame | None = None, boundaries: DataFrame | None = None, sigma: float = 0.0, power: float = 2.0) -> DataFrame:
    """(part, document): the report as JSON texts; part 0 is the nested document, the others are tiles of the grids.

    The page draws the coarsest grid, blurred by ``sigma`` and scaled by ``power``, or a grid as it was
    counted. The document is bounded by the coarsest and the local resolution, the number of peaks and
    the boundary lists, and a tile by its side, so no row grows with the finest resolution.
    """
    spark = points.sparkSession
    # The grid is far smaller than the points, which are scanned for it, for the local views and for their number.
    grid = written(density.histogram(points, resolutions), "grid")
    found = written(density.peaks(grid, n_peaks, finest=max(resolutions)), "peaks")
    boxes = density.local_boxes(found, radius_km)
    local = density.local_histograms(points, boxes, local_resolution).groupBy("rank").agg(F.sort_array(F.collect_list(F.struct("x", "y", "cnt"))).alias("cells"))
    views = density.local_summaries(points, boxes).join(local, "rank", "left")
    none = F.array().cast("array<string>")
    drawn = min(resolutions)
    scaled = smooth.above(smooth.normalise(smooth.blur(grid.where(F.col("res") == drawn), sigma, drawn, drawn // 2), power), SHOWN)
    parts = [
        _shapes(grid).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("res").cast("string"), F.struct("shape", "max", "sum"))))).alias("histograms"), F.lit(density.TILE).alias("tile")),
        found.agg(F.sort_array(F.collect_list(F.struct("rank", "lat", "lon", "cnt"))).alias("peaks")),
        views.agg(F.sort_array(F.collect_list(F.struct("rank", "lat_min", "lat_max", "lon_min", "lon_max", "total_points", "cells"))).alias("local_views")),
        scaled.agg(F.lit(drawn).alias("shown_resolution"), F.sort_array(F.collect_list(F.struct("x", "y", F.round("z", 4).alias("z")))).alias("shown")),
        density.point_counts(points).select(F.col("valid").alias("total_points")),
        spark.range(1).select(none.alias("state_counts")) if zones is None else zones.agg(F.collect_list(F.struct(*zones.columns)).alias("state_counts")),
        spark.range(1).select(none.alias("boundaries")) if boundaries is None else boundaries.agg(F.collect_list("line").alias("boundaries")),
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.crossJoin(F.broadcast(p))  # of one row each
    head = whole.select(F.lit(0).cast("long").alias("part"), F.to_json(F.struct(*whole.columns)).alias("document"))
    tiles = density.payload_tiles(grid).select((F.monotonically_increasing_id() + 1).alias("part"), F.to_json(F.struct("res", "tx", "ty", "steps", "values")).alias("document"))
    return head.unionByName(tiles)


def _shapes(grid: DataFrame) -> DataFrame:
    sums = grid.where("cnt > 0").groupBy("res").agg(F.max("cnt").cast("double").alias("max"), F.sum("cnt").cast("double").alias("sum"))
    return sums.withColumn("shape", F.array("res", F.floor(F.col("res") / 2).cast("int")))


def write_page(report: DataFrame, file: TextIO) -> None:
    """The page with the report packed in, part by part: compact JSON, gzip, base64."""
    file.write(PAGE)
    for r in report.where("part = 0").union(report.where("part > 0")).toLocalIterator():
        value = json.loads(r["document"])
        kind = f"tile-{value['res']}" if r["part"] else "document"
        packed = base64.b64encode(gzip.compress(json.dumps(value, separators=(",", ":")).encode(), mtime=0)).decode()
        file.write(PART.format(kind=kind, packed=packed))
    file.write(DRAWING)


def page(report: DataFrame) -> str:
    out = io.StringIO()
    write_page(report, out)
    return out.getvalue()


def load_page(text: str) -> dict:
    """The report out of a page, its grids put together again: indices and values, in x, then y order."""
    parts = [json.loads(gzip.decompress(base64.b64decode(p.split("</script>", 1)[0]))) for p in text.split('type="application/gzip+base64">')[1:]]
    report, side = parts[0], parts[0]["tile"]
    cells: dict[str, list] = {res: [] for res in report["histograms"]}
    for tile in parts[1:]:
        at = 0
        for step, value in zip(tile["steps"], tile["values"], strict=True):
            at += step
            cells[str(tile["res"])].append([[tile["tx"] * side + at // side, tile["ty"] * side + at % side], value])
    for res, found in cells.items():
        found.sort()
        report["histograms"][res] |= {"indices": [c for c, _ in found], "values": [v for _, v in found]}
    return report
