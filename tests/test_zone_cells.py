import math
import random

import pytest
from pyspark.sql import functions as F

from terragrain.operators import density, zone_cells, zones

RINGS = "zone string, ring int, points array<array<double>>"


def holds(rings, zone, lon, lat):
    odd = False
    for z, _, points in rings:
        for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1], strict=True):
            if z == zone and (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def wanted(rings, points):
    return sorted((lon, lat, z, points.count((lon, lat))) for lon, lat in set(points) for z in {r[0] for r in rings} if holds(rings, z, lon, lat))


def star(x, y, radius, corners, seed):
    pick = random.Random(seed)
    turn = sorted(pick.random() * 2 * math.pi for _ in range(corners))
    return [[x + math.cos(t) * radius * (r := pick.uniform(0.3, 1)), y + math.sin(t) * radius * r] for t in turn]


def shapes(seed):
    square = lambda a, b, c, d: [[a, b], [c, b], [c, d], [a, d]]
    out = [("box", 0, square(-3.0, -3.0, 5.0, 4.0)), ("box", 1, square(0.0, 0.0, 1.0, 1.0)), ("box", 2, square(5.0, -3.0, 6.5, 4.0)), ("upright", 0, [[2.0, 0.25], [2.5, 0.25], [2.5, 3.0], [2.0, 3.0], [2.0, 0.25]])]
    out += [(f"s{k}", 0, star(k * 1.7 - 3, k - 2, 2 + k, 5 * 3**k, seed + k)) for k in range(4)]
    out.append(("s3", 1, star(2, 1, 0.01, 200, seed)))
    return out


def positions(rings, seed, n):
    pick = random.Random(seed)
    corners = [tuple(p) for _, _, points in rings for p in points]
    near = [(x + pick.choice([0, 1e-12, -1e-9, 1e-5]), y + pick.choice([0, 0, 1e-12, 1e-5])) for x, y in pick.sample(corners, 60)]
    grid = [(x / 4, y / 4) for x in range(-14, 28, 3) for y in range(-14, 20, 3)]
    return [(pick.uniform(-6, 8), pick.uniform(-6, 7)) for _ in range(n)] + near + near[:5] + grid


@pytest.mark.parametrize(("most", "seed"), [(64, 1), (3, 2), (10_000, 3)])
def test_positions_are_in_the_zones_that_the_rule_says(spark, monkeypatch, most, seed):
    monkeypatch.setattr(zone_cells, "CELL_EDGES", most)
    rings = shapes(seed)
    points = positions(rings, seed, 150)
    edges = zones.edges(spark.createDataFrame(rings, RINGS))
    found = zones.points_in_zones(spark.createDataFrame(points, "lon double, lat double"), edges)
    assert sorted(map(tuple, found.collect())) == wanted(rings, points)


def test_few_edges_a_cell_and_none_inside(spark):
    rings = [("s", 0, star(0.5, 0.5, 3, 3000, 5))]
    index = zone_cells.cell_index(zones.edges(spark.createDataFrame(rings, RINGS)))
    assert index.selectExpr("max(size(edges))").first()[0] <= zone_cells.CELL_EDGES
    inside = index.where("edges IS NULL")
    assert inside.count() > 0 and inside.where("NOT odd").count() == 0
    for r in inside.collect():  # no corner of the zone is in a cell that counts as a whole
        scale = 2 ** r["level"]
        assert not any(r["cx"] <= x * scale < r["cx"] + 1 and r["cy"] <= y * scale < r["cy"] + 1 for _, _, ps in rings for x, y in ps)


def test_unsure_positions_are_held_against_all_edges(spark):
    """A reference point's own longitude is where cells can't always tell."""
    x = zone_cells.AT_X
    rings = [("a", 0, [[x, 0.1], [x, 0.9], [0.9, 0.9], [0.9, 0.1]]), ("b", 0, [[0.1, 0.1], [x, zone_cells.AT_Y], [0.1, 0.9]])]
    points = [(x, 0.5), (x + 1e-13, 0.5), (0.5, 0.5), (0.2, zone_cells.AT_Y), (x, zone_cells.AT_Y), (0.38, 0.61), (0.05, 0.3)]
    edges = zones.edges(spark.createDataFrame(rings, RINGS))
    df = spark.createDataFrame(points, "lon double, lat double")
    assert zone_cells.locate(df, zone_cells.cell_index(edges)).where("NOT sure").count() > 0
    assert sorted(map(tuple, zones.points_in_zones(df, edges).collect())) == wanted(rings, points)


def test_many_boxes_without_a_nested_loop(spark):
    pick = random.Random(3)
    boxes = [(k, (a := pick.uniform(-80, 80)), a + pick.choice([0.0, 0.01, 1, 30]), (b := pick.uniform(-185, 170)), b + pick.choice([0.001, 0.5, 7, 120])) for k in range(10_000)]
    boxes.append((10_000, 5.0, 4.0, 0.0, 1.0))
    df = spark.createDataFrame(boxes, "rank int, lat_min double, lat_max double, lon_min double, lon_max double")
    points = [(pick.uniform(-90, 90), pick.uniform(-180, 180)) for _ in range(60)] + [(boxes[7][1], boxes[7][3]), (boxes[9][2], boxes[9][4])]
    found = density.points_in_boxes(spark.createDataFrame(points, "lat double, lon double"), df)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = sorted((r["lat"], r["lon"], r["rank"]) for r in found.select("lat", "lon", F.col("rank")).collect())
    assert got == sorted((lat, lon, k) for lat, lon in points for k, a, b, c, d in boxes if a <= lat <= b and c <= lon <= d and -180 <= lon <= 180 and -90 <= lat <= 90)
