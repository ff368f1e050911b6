"""Which cell of a grid a coordinate falls into.

Cell edges are evenly spaced, rounded to single precision; cells are half-open, but the last one holds its upper edge.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

WORLD = {"lon": (-180.0, 180.0), "lat": (-90.0, 90.0)}


def edge(i: Column, lo: Column | float, hi: Column | float, n: int) -> Column:
    """The lower edge of cell ``i`` of ``n`` between ``lo`` and ``hi``."""
    lo, hi = (F.lit(v) if isinstance(v, float) else v for v in (lo, hi))
    return F.when(i >= n, hi).otherwise(lo + i * ((hi - lo) / F.lit(float(n)))).cast("float").cast("double")


def bin_index(v: Column, lo: Column | float, hi: Column | float, n: int) -> Column:
    """The cell of ``v``: a guess by division, moved by one where the rounded edges say so, kept within the grid."""
    low, high = (F.lit(x) if isinstance(x, float) else x for x in (lo, hi))
    guess = F.floor((v - low) / (high - low) * F.lit(float(n))).cast("int")
    moved = F.when(v < edge(guess, lo, hi, n), guess - 1).when(v >= edge(guess + 1, lo, hi, n), guess + 1).otherwise(guess)
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), moved))


def cell_of(lon: Column, lat: Column, resolution: int) -> tuple[Column, Column]:
    """(x, y) of a point in the world grid, which has half as many rows as columns."""
    return bin_index(lon, *WORLD["lon"], resolution), bin_index(lat, *WORLD["lat"], resolution // 2)


def _edges(lo: float, hi: float, n: int) -> np.ndarray:
    out = lo + np.arange(n + 1) * ((hi - lo) / n)
    out[n] = hi
    return out.astype(np.float32)


def contains_grid(fine: int, coarse: int) -> bool:
    """Whether every cell of the coarse world grid is made of whole cells of the fine one, rounded edges included."""
    step = fine // coarse
    if fine % coarse or fine // 2 != (coarse // 2) * step:
        return False
    return all(np.array_equal(_edges(*WORLD[axis], f)[::step], _edges(*WORLD[axis], c)) for axis, f, c in (("lon", fine, coarse), ("lat", fine // 2, coarse // 2)))


def centre_of(x: Column, y: Column, resolution: int) -> tuple[Column, Column]:
    """(lon, lat) of a cell's centre."""
    lon = (x + F.lit(0.5)) / F.lit(float(resolution)) * F.lit(360.0) - F.lit(180.0)
    lat = (y + F.lit(0.5)) / F.lit(float(resolution // 2)) * F.lit(180.0) - F.lit(90.0)
    return lon, lat


#: The same in SQL, for oracles.
def edge_sql(i: str, lo: str, hi: str, n: int) -> str:
    return f"CAST(CAST(CASE WHEN {i} >= {n} THEN {hi} ELSE {lo} + ({i}) * (({hi} - {lo}) / CAST({n} AS DOUBLE)) END AS FLOAT) AS DOUBLE)"


def bin_sql(v: str, lo: str, hi: str, n: int) -> str:
    lo, hi = f"CAST({lo} AS DOUBLE)", f"CAST({hi} AS DOUBLE)"
    guess = f"CAST(floor(({v} - {lo}) / ({hi} - {lo}) * CAST({n} AS DOUBLE)) AS INTEGER)"
    return f"greatest(0, least({n - 1}, CASE WHEN {v} < {edge_sql(guess, lo, hi, n)} THEN {guess} - 1 WHEN {v} >= {edge_sql(guess + ' + 1', lo, hi, n)} THEN {guess} + 1 ELSE {guess} END))"
