"""Vertices and bars that a viewer draws, one row per vertex or bar."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.display import colour, first_label, human_count, sphere, tile_lat, tile_lon, tile_x, tile_y
from ..functions.predicates import computed

#: Corners of a column of the mesh: 0 to 3 below, 4 to 7 above; these take the east or north edge of the cell.
EAST, NORTH = (1, 2), (2, 3)
DARK, LOCAL_DARK = 0.6, 0.5
#: Two triangles per face, by corner: the top, and each side between a lower corner k, its neighbour and the corners above.
FACES = ((4, 5, 6), (4, 6, 7), *(t for k in range(4) for n in [(k + 1) % 4] for t in ((k, k + 4, n), (n, k + 4, n + 4))))


def _corners(cells: DataFrame) -> tuple[DataFrame, Column, Column, Column]:
    each = cells.withColumn("corner", F.explode(F.array(*[F.lit(k) for k in range(8)])))
    on = lambda corners: (F.col("corner") % 4).isin(*corners).cast("double")
    return each, F.col("x") + on(EAST), F.col("y") + on(NORTH), F.col("corner") >= 4


def _shaded(z: Column, above: Column, dark: float) -> list[Column]:
    rgb, shade = colour(z), F.when(above, F.lit(1.0)).otherwise(F.lit(dark))
    return [(rgb[c] / F.lit(255.0) * shade).alias(c) for c in ("red", "green", "blue")]


def globe_vertices(cells: DataFrame, width: int, height: int, height_scale: float, radius: float = 1.0) -> DataFrame:
    """Eight vertices per cell (x, y, z): corner, position on or above the sphere, colour."""
    each, east, north, above = _corners(cells)
    lon, lat = east / F.lit(float(width)) * F.lit(360.0) - F.lit(180.0), north / F.lit(float(height)) * F.lit(180.0) - F.lit(90.0)
    r = F.when(above, F.lit(radius) + F.col("z") * F.lit(height_scale * radius)).otherwise(F.lit(radius * 1.001))
    return each.select("x", "y", "corner", *[c.alias(n) for n, c in sphere(lon, lat, r).items()], *_shaded(F.col("z"), above, DARK))


def plane_vertices(cells: DataFrame, width: int, height: int, height_scale: float, aspect: float, side: float = 8.0) -> DataFrame:
    """The same on a plane, ``aspect`` times as high as wide, for a local view."""
    each, east, north, above = _corners(cells)
    px = (east / F.lit(float(width)) - F.lit(0.5)) * F.lit(side)
    py = (north / F.lit(float(height)) - F.lit(0.5)) * F.lit(side * aspect)
    pz = F.when(above, F.col("z") * F.lit(height_scale * 4)).otherwise(F.lit(0.0))
    return each.select("x", "y", "corner", px.alias("px"), py.alias("py"), pz.alias("pz"), *_shaded(F.col("z"), above, LOCAL_DARK))


def triangles(cells: DataFrame) -> DataFrame:
    """Ten triangles per cell, as corners of the cell."""
    faces = F.array(*[F.struct(*[F.lit(c).alias(n) for n, c in zip("abc", f, strict=True)]) for f in FACES])
    return cells.select("x", "y", F.posexplode(faces).alias("triangle", "t")).select("x", "y", "triangle", "t.*")


def ring_on_sphere(lines: DataFrame, radius: float = 1.0) -> DataFrame:
    """Boundary lines (line: array of [lon, lat]) as arrays of positions; lines of one point go."""
    at = lambda p: F.struct(*[c.alias(n) for n, c in sphere(p[0].cast("double"), p[1].cast("double"), radius).items()])
    return computed(lines.where(F.size("line") >= 2), positions=F.transform("line", at))


def ranked_bars(counts: DataFrame, most: int = 24) -> DataFrame:
    """The ``most`` largest counts (name, n) as bars around a circle: length, angle, shift."""
    top = counts.orderBy(F.desc("n"), "name").limit(most)
    ranked, whole = Window.orderBy(F.desc("n"), "name"), Window.partitionBy()
    numbered = top.withColumn("i", F.row_number().over(ranked) - 1).withColumn("items", F.count(F.lit(1)).over(whole)).withColumn("largest", F.max("n").over(whole))
    return numbered.select("name", "n", F.round(F.greatest(F.lit(0.1), F.col("n") / F.col("largest") * F.lit(1.5)), 6).alias("length"), F.round(F.col("i") / F.col("items") * F.lit(2 * math.pi), 6).alias("angle"), F.round((F.col("i") % 3 - 1) * F.lit(0.15), 6).alias("shift"))


def peak_rows(peaks: DataFrame) -> DataFrame:
    """Peaks as a panel shows them."""
    return peaks.select("rank", F.format_number("lat", 2).alias("lat"), F.format_number("lon", 2).alias("lon"), F.format_number("cnt", 0).alias("cnt"), human_count(F.col("cnt")).alias("label"))


def bar_labels(counts: DataFrame) -> DataFrame:
    return counts.withColumn("label", first_label(F.col("abbrev"), F.col("fip"), F.col("name")))


def tiles(boxes: DataFrame, zoom: Column) -> DataFrame:
    """Every map tile of each box, with its place in the box: left and top edge, width and height, as shares."""
    ranged = boxes.withColumn("zoom", zoom)
    x = F.sequence(tile_x(F.col("lon_min"), F.col("zoom")), tile_x(F.col("lon_max"), F.col("zoom")))
    y = F.sequence(tile_y(F.col("lat_max"), F.col("zoom")), tile_y(F.col("lat_min"), F.col("zoom")))
    each = ranged.withColumn("tile_x", F.explode(x)).withColumn("tile_y", F.explode(y))
    west, east = tile_lon(F.col("tile_x"), F.col("zoom")), tile_lon(F.col("tile_x") + 1, F.col("zoom"))
    top, bottom = tile_lat(F.col("tile_y"), F.col("zoom")), tile_lat(F.col("tile_y") + 1, F.col("zoom"))
    wide, high = F.col("lon_max") - F.col("lon_min"), F.col("lat_max") - F.col("lat_min")
    return each.withColumns({"left": (west - F.col("lon_min")) / wide, "top": (F.col("lat_max") - top) / high, "width": (east - west) / wide, "height": (top - bottom) / high})
