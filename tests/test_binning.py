import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terragrain.functions.binning import bin_index
from terragrain.operators import density

POINTS = "lon double, lat double"


@pytest.mark.parametrize("resolution", [100, 180, 250, 720, 8640])
def test_cells_equal_numpy(spark, resolution):
    rng = np.random.default_rng(resolution)
    lon, lat = rng.integers(-18000, 18001, 4000) / 100, rng.integers(-9000, 9001, 4000) / 100
    lon[:4], lat[:4] = (-180, 180, 180, -180), (-90, 90, -90, 90)
    xs, ys = np.linspace(-180, 180, resolution + 1).astype(np.float32), np.linspace(-90, 90, resolution // 2 + 1).astype(np.float32)
    dense = np.histogram2d(lon, lat, bins=[xs, ys])[0]
    wanted = {(int(x), int(y)): int(dense[x, y]) for x, y in zip(*np.nonzero(dense), strict=True)}
    points = spark.createDataFrame([(float(a), float(b)) for a, b in zip(lon, lat, strict=True)], POINTS)
    assert {(r.x, r.y): r.cnt for r in density.histogram(points, [resolution]).collect()} == wanted


def test_edges_belong_to_the_upper_cell_and_the_last_to_the_last(spark):
    values = [(-180.0, 0), (-179.0, 1), (-179.5, 0), (180.0, 359), (179.999, 359)]
    df = spark.createDataFrame(values, "v double, wanted int").select("wanted", bin_index(F.col("v"), -180.0, 180.0, 360).alias("got"))
    assert all(r.got == r.wanted for r in df.collect())


def test_every_resolution_counts_every_valid_point_and_repeats_count_once(spark):
    rows = [(float(k % 360 - 180), float(k % 181 - 90)) for k in range(1000)] + [(181.0, 0.0), (0.0, -91.0), (math.nan, 0.0), (None, 1.0)]
    grid = density.histogram(spark.createDataFrame(rows, POINTS), [180, 360, 360])
    assert {r.res: r.sum_cnt for r in density.summary(grid).collect()} == {180: 1000, 360: 1000}
    fine = grid.where("res = 360").groupBy(F.floor(F.col("x") / 2).cast("int").alias("x"), F.floor(F.col("y") / 2).cast("int").alias("y")).agg(F.sum("cnt").alias("cnt"))
    assert sorted(map(tuple, fine.collect())) == sorted((r.x, r.y, r.cnt) for r in grid.where("res = 180").collect())


def test_coarse_grids_summed_from_fine_ones_equal_their_own_counts(spark):
    rng = np.random.default_rng(9)
    points = spark.createDataFrame([(float(a), float(b)) for a, b in zip(rng.integers(-18000, 18001, 3000) / 100, rng.integers(-9000, 9001, 3000) / 100, strict=True)], POINTS)
    resolutions = [90, 100, 125, 180, 250, 360, 500, 721, 720, 1000]
    together = {tuple(r) for r in density.histogram(points, resolutions).collect()}
    alone = {tuple(r) for n in resolutions for r in density.histogram(points, [n]).collect()}
    assert together == alone


def test_nothing_in_an_empty_grid(spark):
    points = spark.createDataFrame([], POINTS)
    grid = density.histogram(points, [360])
    assert grid.count() == 0 and density.peaks(grid).count() == 0
    assert tuple(density.point_counts(points).first()) == (0, 0)


def test_peaks_are_apart_on_one_axis_at_least(spark):
    cells = [(720, 100, 100, 50), (720, 101, 101, 40), (720, 101, 110, 30), (720, 300, 100, 30), (720, 299, 100, 20)]
    found = density.peaks(spark.createDataFrame(cells, "res int, x int, y int, cnt long"), 10).collect()
    assert [(r.rank, r.cnt) for r in sorted(found)] == [(1, 50), (2, 30), (3, 30)]
    assert sorted(found)[1].lon > sorted(found)[2].lon


def test_local_histograms_equal_numpy(spark):
    rng = np.random.default_rng(3)
    lon, lat = 10 + rng.normal(size=3000) * 0.4, 50 + rng.normal(size=3000) * 0.3
    points = spark.createDataFrame([(float(a), float(b)) for a, b in zip(lon, lat, strict=True)], POINTS)
    boxes = density.local_boxes(spark.createDataFrame([(1, 50.0, 10.0)], "rank int, lat double, lon double"), 30.0)
    b = boxes.first()
    inside = (lon >= b.lon_min) & (lon <= b.lon_max) & (lat >= b.lat_min) & (lat <= b.lat_max)
    dense = np.histogram2d(lon[inside], lat[inside], bins=[np.linspace(b.lon_min, b.lon_max, 41).astype(np.float32), np.linspace(b.lat_min, b.lat_max, 41).astype(np.float32)])[0]
    got = {(r.x, r.y): r.cnt for r in density.local_histograms(points, boxes, 40).collect()}
    assert got == {(int(x), int(y)): int(dense[x, y]) for x, y in zip(*np.nonzero(dense), strict=True)}
    assert density.local_summaries(points, boxes).first().total_points == int(inside.sum()) >= sum(got.values())
