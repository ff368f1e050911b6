"""Areas of many parts as one: edges that two parts share go, and what is left is stitched into rings.

Every edge points to the one that follows it, and rings are told apart by pointers that double: after
k rounds an edge knows the smallest edge among the next 2^k, and how far away it is. So a ring of a
million edges takes 20 rounds of joins, and neither a ring nor a zone meets in one task before its
ring is put together.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import written
from .zones import edges


def outline(zone_edges: DataFrame) -> DataFrame:
    """The edges of a zone that bound it: those that a part has in one direction, and no other in the opposite one."""
    forward = (F.col("x1") < F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") < F.col("y2")))
    low = lambda a, b: F.when(forward, F.col(a)).otherwise(F.col(b))
    named = zone_edges.select("zone", low("x1", "x2").alias("ax"), low("y1", "y2").alias("ay"), low("x2", "x1").alias("bx"), low("y2", "y1").alias("by"), F.when(forward, 1).otherwise(-1).alias("way"))
    left = named.groupBy("zone", "ax", "ay", "bx", "by").agg(F.sum("way").alias("way")).where("way <> 0")
    # Where several parts lie over each other, an edge still bounds the zone once.
    to = lambda a, b: F.when(F.col("way") > 0, F.col(a)).otherwise(F.col(b))
    return left.select("zone", to("ax", "bx").alias("x1"), to("ay", "by").alias("y1"), to("bx", "ax").alias("x2"), to("by", "ay").alias("y2"))


def followers(bounds: DataFrame) -> DataFrame:
    """(id, next) of edges (id, zone, x1, y1, x2, y2): the edge that begins where one ends, with the area on the same side.

    Where rings touch, several begin there: the first one counts in the sense against the clock, seen
    from the way back, as the area lies on the right. So areas that touch in a corner stay apart.
    """
    ends = bounds.select("zone", F.col("x2").alias("x"), F.col("y2").alias("y"), "id", F.atan2(F.col("y1") - F.col("y2"), F.col("x1") - F.col("x2")).alias("back"))
    begins = bounds.select("zone", F.col("x1").alias("x"), F.col("y1").alias("y"), F.col("id").alias("next"), F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")).alias("on"))
    turn = F.pmod(F.col("on") - F.col("back"), F.lit(2 * math.pi))
    met = ends.join(begins, ["zone", "x", "y"]).withColumn("turn", F.when(turn <= 0, F.lit(2 * math.pi)).otherwise(turn))
    return met.groupBy("id").agg(F.min(F.struct("turn", "next")).alias("n")).select("id", F.col("n.next").alias("next"))


def rank_rings(follow: DataFrame) -> DataFrame:
    """(id, head, away) of edges (id, next): the smallest id of the edge's ring, and how many edges on that is."""
    state = written(follow.select("id", "next", F.col("id").alias("head"), F.lit(0).cast("long").alias("away")), "rings")
    step = 1
    while True:
        on = state.select(F.col("id").alias("next"), F.col("next").alias("next2"), F.col("head").alias("head2"), F.col("away").alias("away2"))
        lower = F.col("head2") < F.col("head")
        joined = state.join(on, "next").select("id", F.col("next2").alias("next"), F.when(lower, F.col("head2")).otherwise(F.col("head")).alias("head"), F.when(lower, F.col("away2") + step).otherwise(F.col("away")).alias("away"), lower.alias("moved"))
        moved = written(joined, "rings")
        state = moved.drop("moved")
        if moved.where("moved").isEmpty():  # then no edge within reach is smaller, around the whole ring
            return state.select("id", "head", "away")
        step *= 2


def dissolve(rings: DataFrame) -> DataFrame:
    """(zone, ring, points) of whole zones out of those of their parts.

    Rings have their area on the right, as shapefiles have them: outer ones run with the clock, holes
    against it. Parts must share whole edges, corner by corner, for these to go. Rings begin at their
    smallest corner, the outer and inner ones of a zone are numbered by it, and aren't closed by a
    repeated point.
    """
    bounds = outline(edges(rings))
    bounds = written(bounds.withColumn("id", F.monotonically_increasing_id()), "outline")
    ranked = rank_rings(followers(bounds))
    placed = bounds.join(ranked, "id").groupBy("zone", "head").agg(F.sort_array(F.collect_list(F.struct((-F.col("away")).alias("at"), F.array("x1", "y1").alias("p")))).alias("edges"))
    # The head has 0 to go, and the edge after it all but one: so after the head comes what is farthest away.
    points = F.transform("edges", lambda e: e["p"])
    first = F.array_min(points)
    at = F.array_position(points, first).cast("int") - 1
    turned = F.concat(F.slice(points, at + 1, F.size(points) - at), F.slice(points, 1, at))
    number = F.row_number().over(Window.partitionBy("zone").orderBy(F.col("points")[0])) - 1
    return placed.select("zone", turned.alias("points")).withColumn("ring", number).select("zone", "ring", "points")


def areas(rings: DataFrame) -> DataFrame:
    """(zone, rings, area, outline): how many rings a zone has, its area in square degrees, holes not counted, and its length in degrees."""
    each = edges(rings).groupBy("zone").agg(
        F.sum((F.col("x2") - F.col("x1")) * (F.col("y1") + F.col("y2")) / 2).alias("area"), F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("outline")
    )
    return each.join(rings.groupBy("zone").agg(F.count(F.lit(1)).alias("rings")), "zone").select("zone", "rings", "area", "outline")
