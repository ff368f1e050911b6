"""An index of zones by cells, so that a position meets no edge, or the few edges of its own cell.

Cells are squares of a degree, those with many edges are quartered again and again. A cell that no
edge of a zone goes through is inside or outside it as a whole. In a border cell, a position is
compared with the cell's reference point: of the edges in the cell, those count that are crossed on
the way from the position straight east or west to the reference point's longitude, and from there
north or south to it. Only where that way passes an edge too closely to tell in floating point, the
position is held against all edges of its latitude (``zones.by_bands``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import written

#: Edges of a cell before it is quartered, and how often that is done: to less than a thousandth of a degree.
CELL_EDGES, MOST_LEVELS = 64, 10
#: Degrees that rounding can't reach.
MARGIN = 1e-9
#: The reference point's place in its cell: seldom in line with the corners of shapes.
AT_X, AT_Y = 0.3819660112501051, 0.6180339887498949

CELL = ["level", "cx", "cy"]


def scale_of(level: Column) -> Column:
    """Cells to a degree."""
    return F.pow(F.lit(2.0), level)


def cell_of(value: Column, level: Column) -> Column:
    return F.floor(value * scale_of(level)).cast("long")


def _through(edges: DataFrame, level: Column) -> DataFrame:
    """(zone, e, level, cx, cy): every cell of the level that an edge, or its margin, goes through."""
    scale = scale_of(level)
    low, high = F.least("e.y1", "e.y2") - MARGIN, F.greatest("e.y1", "e.y2") + MARGIN
    rows = edges.withColumn("level", level).withColumn("cy", F.explode(F.sequence(F.floor(low * scale).cast("long"), F.floor(high * scale).cast("long"))))

    def x_at(y: Column) -> Column:
        share = F.coalesce(F.try_divide(y - F.col("e.y1"), F.col("e.y2") - F.col("e.y1")), F.lit(0.0))
        return F.col("e.x1") + (F.col("e.x2") - F.col("e.x1")) * F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))

    level_edge = F.abs(F.col("e.y2") - F.col("e.y1")) < MARGIN
    a, b = x_at(F.col("cy") / scale - MARGIN), x_at((F.col("cy") + 1) / scale + MARGIN)
    a, b = F.when(level_edge, F.col("e.x1")).otherwise(a), F.when(level_edge, F.col("e.x2")).otherwise(b)
    columns = F.sequence(F.floor((F.least(a, b) - MARGIN) * scale).cast("long"), F.floor((F.greatest(a, b) + MARGIN) * scale).cast("long"))
    return rows.withColumn("cx", F.explode(columns)).select("zone", "e", *CELL)


def _quarters(cells: DataFrame) -> DataFrame:
    quarter = F.explode(F.array(*[F.struct((F.col("cx") * 2 + i).alias("cx"), (F.col("cy") * 2 + j).alias("cy")) for i in (0, 1) for j in (0, 1)])).alias("q")
    return cells.select((F.col("level") + 1).alias("level"), quarter).select("level", "q.cx", "q.cy")


def cell_index(zone_edges: DataFrame) -> DataFrame:
    """(level, cx, cy, zone, odd, edges): the cells that a zone has a part in, as a table.

    ``odd`` says whether the cell's reference point is in the zone, ``edges`` are the zone's edges that
    go through the cell, null where there are none.
    """
    edges = written(zone_edges.select("zone", F.struct("x1", "y1", "x2", "y2").alias("e")), "edges")
    leaves: list[DataFrame] = []
    borders: list[DataFrame] = []
    box = edges.groupBy("zone").agg(*[f(F.least(f"e.{c}1", f"e.{c}2") if f is F.min else F.greatest(f"e.{c}1", f"e.{c}2")).alias(f"{c}{n}") for c in "xy" for f, n in ((F.min, "_low"), (F.max, "_high"))])
    span = lambda c: F.explode(F.sequence(F.floor(f"{c}_low").cast("long"), F.floor(f"{c}_high").cast("long")))
    cells = box.withColumn("cx", span("x")).select("cx", "y_low", "y_high").withColumn("cy", span("y")).select(F.lit(0).alias("level"), "cx", "cy").distinct()
    through = written(_through(edges, F.lit(0)), "through")
    for level in range(MOST_LEVELS + 1):
        full = through.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL_EDGES).select(*CELL)
        full = written(full.limit(0) if level == MOST_LEVELS else full, "full-cells")
        leaves.append(cells.join(full, CELL, "left_anti"))
        borders.append(through.join(full, CELL, "left_anti"))
        if full.isEmpty():
            break
        cells = written(_quarters(full), "cells")
        finer = through.join(full, CELL, "left_semi").select("zone", "e").distinct()
        through = written(_through(finer, F.lit(level + 1)).join(cells, CELL, "left_semi"), "through")
    leaf, border = leaves[0], borders[0]
    for more, crossed in zip(leaves[1:], borders[1:], strict=True):
        leaf, border = leaf.unionByName(more), border.unionByName(crossed)
    leaf = written(leaf, "leaves")
    held = border.groupBy(*CELL, "zone").agg(F.collect_list("e").alias("edges"))
    known = _parities(edges, leaf).join(held, [*CELL, "zone"], "full").withColumn("odd", F.coalesce("odd", F.lit(False)))
    return written(known.where("odd OR edges IS NOT NULL"), "zone-cells")


def reference(level: Column, cx: Column, cy: Column) -> tuple[Column, Column]:
    scale = scale_of(level)
    return (cx + F.lit(AT_X)) / scale, (cy + F.lit(AT_Y)) / scale


def _crossing(lat: Column, e: str = "e") -> Column:
    """Where an edge crosses a latitude; what the even-odd rule compares a longitude with."""
    return (F.col(f"{e}.x2") - F.col(f"{e}.x1")) * F.try_divide(lat - F.col(f"{e}.y1"), F.col(f"{e}.y2") - F.col(f"{e}.y1")) + F.col(f"{e}.x1")


def _parities(edges: DataFrame, leaf: DataFrame) -> DataFrame:
    """(level, cx, cy, zone, odd): whether a cell's reference point is in the zone, for the cells west of some edge of the zone in their row.

    Per zone and row of cells, the reference points and the edges' crossings with their latitude are
    put in one order from the east, and crossings counted.
    """
    rows = leaf.select("level", "cy").distinct()
    x, y = reference(F.col("level"), F.lit(0), F.col("cy"))
    levels = [r["level"] for r in leaf.select("level").distinct().collect()]  # MOST_LEVELS + 1 at most
    near = edges.select("zone", "e", F.explode(F.array(*[F.lit(k) for k in levels]).cast("array<int>")).alias("level"))
    scale = scale_of(F.col("level"))
    spanned = F.sequence(F.floor(F.least("e.y1", "e.y2") * scale).cast("long"), F.floor(F.greatest("e.y1", "e.y2") * scale).cast("long"))
    met = near.withColumn("cy", F.explode(spanned)).join(rows, ["level", "cy"], "left_semi").where((F.col("e.y1") > y) != (F.col("e.y2") > y))
    crossings = met.select("zone", "level", "cy", _crossing(y).alias("x"), F.lit(1).alias("one"), F.lit(None).cast("long").alias("cx"))
    zones_of_row = crossings.groupBy("level", "cy", "zone").agg(F.max("x").alias("east"))
    x, _ = reference(F.col("level"), F.col("cx"), F.col("cy"))
    places = leaf.join(zones_of_row, ["level", "cy"]).where(x < F.col("east")).select("zone", "level", "cy", x.alias("x"), F.lit(0).alias("one"), "cx")
    # At the same longitude the reference point comes first: an edge counts where the point is west of it.
    east = Window.partitionBy("zone", "level", "cy").orderBy(F.desc("x"), "one").rowsBetween(Window.unboundedPreceding, 0)
    return crossings.unionByName(places).withColumn("odd", F.sum("one").over(east) % 2 == 1).where("cx IS NOT NULL").select(*CELL, "zone", "odd")


def locate(places: DataFrame, index: DataFrame) -> DataFrame:
    """``places`` (lon, lat, ...) with zone and sure, for every zone of whose cell they are in a part.

    Where not ``sure``, the position isn't known to be in the zone. Zones that hold it surely have a row.
    """
    base = lambda c: F.floor(F.col(c) / scale_of(F.col("level"))).cast("long").alias(c)
    levels = index.select(base("cx"), base("cy"), "level").groupBy("cx", "cy").agg(F.collect_set("level").alias("levels"))
    here = places.withColumn("cx", F.floor("lon").cast("long")).withColumn("cy", F.floor("lat").cast("long")).join(levels, ["cx", "cy"])
    each = here.drop("cx", "cy").withColumn("level", F.explode("levels")).drop("levels")
    met = each.withColumn("cx", cell_of(F.col("lon"), F.col("level"))).withColumn("cy", cell_of(F.col("lat"), F.col("level"))).join(index, CELL)
    rx, ry = reference(F.col("level"), F.col("cx"), F.col("cy"))

    def ways(e: Column) -> Column:
        spans, over = (e["y1"] > F.col("lat")) != (e["y2"] > F.col("lat")), (e["x1"] > rx) != (e["x2"] > rx)
        x = (e["x2"] - e["x1"]) * F.try_divide(F.col("lat") - e["y1"], e["y2"] - e["y1"]) + e["x1"]
        y = (e["y2"] - e["y1"]) * F.try_divide(rx - e["x1"], e["x2"] - e["x1"]) + e["y1"]
        level = spans & ((F.col("lon") < x) != (rx < x))
        upright = over & ((F.col("lat") < y) != (ry < y))
        # Too near to tell: to the corner of the way, by either measure, or an end of the edge to its longitude or latitude there.
        close = (spans & (F.abs(rx - x) < MARGIN)) | (over & ((F.abs(F.col("lat") - y) < MARGIN) | (F.abs(ry - y) < MARGIN))) | (F.abs(e["x1"] - rx) < MARGIN) | (F.abs(e["x2"] - rx) < MARGIN)
        return F.struct((level != upright).alias("odd"), close.alias("close"))

    seen = met.withColumn("ways", F.transform("edges", ways))
    odd = F.aggregate("ways", F.col("odd"), lambda o, w: o != w["odd"])
    inside = F.when(F.col("edges").isNull(), F.col("odd")).otherwise(odd)
    sure = F.col("edges").isNull() | ~F.exists("ways", lambda w: w["close"])
    return seen.withColumn("inside", inside).withColumn("sure", sure).where("inside OR NOT sure").select(*places.columns, "zone", "sure")
