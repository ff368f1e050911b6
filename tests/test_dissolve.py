import math
import random

from terragrain.operators import dissolve, zones

RINGS = "zone string, ring int, points array<array<double>>"


def clockwise(a, b, c, d):
    return [[a, b], [a, d], [c, d], [c, b]]


def hole(a, b, c, d):
    return clockwise(a, b, c, d)[::-1]


def dissolved(spark, rings):
    out = {}
    for r in dissolve.dissolve(spark.createDataFrame(rings, RINGS)).orderBy("zone", "ring").collect():
        out.setdefault(r["zone"], []).append([tuple(p) for p in r["points"]])
    return out


def test_two_counties_give_one_ring_and_holes_stay(spark):
    rings = [
        ("two", 0, [*clockwise(0.0, 0.0, 1.0, 1.0), [0.0, 0.0]]), ("two", 0, clockwise(1.0, 0.0, 2.0, 1.0)),
        ("hole", 0, clockwise(0.0, 0.0, 4.0, 4.0)), ("hole", 1, hole(1.0, 1.0, 2.0, 2.0)),
        ("filled", 0, clockwise(0.0, 0.0, 4.0, 4.0)), ("filled", 1, hole(1.0, 1.0, 2.0, 2.0)), ("filled", 0, clockwise(1.0, 1.0, 2.0, 2.0)),
        ("touching", 0, clockwise(0.0, 0.0, 1.0, 1.0)), ("touching", 0, clockwise(1.0, 1.0, 2.0, 2.0)),
        ("far", 0, clockwise(0.0, 0.0, 1.0, 1.0)), ("far", 0, clockwise(5.0, 5.0, 6.0, 6.0)),
    ]
    square = lambda *at: [tuple(p) for p in clockwise(*at)]
    assert dissolved(spark, rings) == {
        "two": [[(0, 0), (0, 1), (1, 1), (2, 1), (2, 0), (1, 0)]],
        "hole": [square(0, 0, 4, 4), [(1, 1), (2, 1), (2, 2), (1, 2)]],
        "filled": [square(0, 0, 4, 4)],
        "touching": [square(0, 0, 1, 1), square(1, 1, 2, 2)],
        "far": [square(0, 0, 1, 1), square(5, 5, 6, 6)],
    }
    assert dissolved(spark, []) == {}


def test_membership_is_that_of_the_parts(spark):
    """A field of squares, some missing: rings of the whole hold the positions that the parts hold."""
    pick = random.Random(2)
    cells = [(x, y) for x in range(9) for y in range(9) if pick.random() < 0.6]
    rings = [("z", 0, clockwise(float(x), float(y), x + 1.0, y + 1.0)) for x, y in cells]
    whole = dissolve.dissolve(spark.createDataFrame(rings, RINGS))
    points = spark.createDataFrame([(x + 0.5, y + 0.5) for x in range(-1, 10) for y in range(-1, 10)], "lon double, lat double")
    found = zones.points_in_zones(points, zones.edges(whole))
    assert sorted((r["lon"] - 0.5, r["lat"] - 0.5) for r in found.collect()) == sorted(cells)
    assert dissolve.areas(whole).first()["area"] == len(cells)
    for r in whole.collect():
        corners = [tuple(p) for p in r["points"]]
        assert len(set(corners)) == len(corners) and min(corners) == corners[0]


def test_a_long_ring_takes_few_rounds(spark, monkeypatch):
    n = 3000
    ring = [[math.cos(2 * math.pi * k / n), -math.sin(2 * math.pi * k / n)] for k in range(n)]
    rounds, write = [], dissolve.written
    monkeypatch.setattr(dissolve, "written", lambda rows, name: (rounds.append(name), write(rows, name))[1])
    got = dissolve.dissolve(spark.createDataFrame([("a", 0, ring)], RINGS)).collect()
    at = ring.index(min(ring))
    assert [r["points"] for r in got] == [ring[at:] + ring[:at]]
    assert rounds.count("rings") <= 15
