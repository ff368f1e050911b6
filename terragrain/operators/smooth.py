"""Gaussian blur and scaling of grids in long form."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LARGEST_KERNEL = 101


def kernel(sigma: float, width: int) -> list[float] | None:
    """The normalised weights of a blur, odd in number; None where the blur is below half a pixel."""
    pixels = sigma * width * 0.04
    if pixels < 0.5:
        return None
    size = min(LARGEST_KERNEL, math.ceil(pixels * 3) * 2 + 1)
    raw = [math.exp(-((k - size // 2) ** 2) / (2 * pixels * pixels)) for k in range(size)]
    total = math.fsum(raw)
    return [w / total for w in raw]


def _spread(cells: DataFrame, weights: list[float]) -> DataFrame:
    """Every cell once per step of the kernel, with step and weight."""
    half = len(weights) // 2
    steps = F.array(*[F.struct(F.lit(k - half).alias("step"), F.lit(w).alias("weight")) for k, w in enumerate(weights)])
    return cells.withColumn("s", F.explode(steps)).select("*", "s.step", "s.weight")


def blur(grid: DataFrame, sigma: float, width: int, height: int) -> DataFrame:
    """(x, y, v) of the blurred grid (x, y, cnt): wrapped around in x, the outermost row repeated in y.

    Either pass spreads each cell to its neighbours with a kernel of at most 101 rows and sums per
    cell, partly before the shuffle. The rows beyond the first and last are those rows again, so what
    they add is spread from there.
    """
    own = grid.select("x", "y", F.col("cnt").cast("double").alias("v"))
    weights = kernel(sigma, width)
    if weights is None:
        return own
    half = len(weights) // 2
    across = _spread(own, weights).groupBy(F.pmod(F.col("x") - F.col("step"), F.lit(width)).alias("x"), "y").agg(F.sum(F.col("v") * F.col("weight")).alias("v"))
    # How often row y stands for itself and for the rows beyond the edge that it repeats.
    source = F.when(F.col("y") == 0, F.sequence(F.lit(-half), F.lit(0))).otherwise(F.array(F.col("y")))
    last = F.when(F.col("y") == height - 1, F.sequence(F.lit(height - 1), F.lit(height - 1 + half)))
    both = F.when(F.lit(height == 1), F.sequence(F.lit(-half), F.lit(half))).otherwise(F.coalesce(last, source))
    rows = _spread(across.withColumn("row", F.explode(both)), weights).withColumn("to", F.col("row") - F.col("step"))
    return rows.where(F.col("to").between(0, height - 1)).groupBy("x", F.col("to").alias("y")).agg(F.sum(F.col("v") * F.col("weight")).alias("v"))


def normalise(grid: DataFrame, power: float = 2.0) -> DataFrame:
    """(x, y, z): log1p of the values to a power, against the largest, for the values above 0."""
    raised = grid.where("v > 0").withColumn("raised", F.pow(F.log1p("v"), F.lit(power)))
    largest = raised.agg(F.max("raised").alias("largest"))
    return raised.crossJoin(F.broadcast(largest)).select("x", "y", (F.col("raised") / F.col("largest")).alias("z"))


def above(grid: DataFrame, threshold: float) -> DataFrame:
    return grid.where(F.col("z") >= threshold)
