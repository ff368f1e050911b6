import math
from hashlib import sha256

import numpy as np
import pytest

from terragrain.llm import clusters


def brute_force(rows, k=8, rounds=10, dims=64):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(1024 * x) for x in v]))
    order = sorted(kept, key=lambda r: (r[0] is None, sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [w for _, w in order[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for r in range(rounds + 1):
        of = [min(range(len(centroids)), key=lambda c: (square(w, centroids[c]), c)) for _, w in kept]
        if r < rounds:
            for c in range(len(centroids)):
                mine = [w for (_, w), o in zip(kept, of, strict=True) if o == c]
                if mine:
                    centroids[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    distance = [square(w, centroids[o]) for (_, w), o in zip(kept, of, strict=True)]
    fits = lambda d: d if d < 1 << 63 else None
    out = []
    for (i, _), o, d in zip(kept, of, distance, strict=True):
        own = sum(e for e, p in zip(distance, of, strict=True) if p == o)
        over = [any(fits(e) is None for e, p in zip(distance, of, strict=True) if p in which) for which in ([o], range(k))]
        out.append((i, o, fits(d), None if over[0] else fits(own), None if over[1] else fits(sum(distance)), sha256(",".join(map(str, centroids[o])).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS weights", "1 AS cluster", "1 AS block", "1 AS seed")
    return sorted(map(tuple, clusters.cluster_embeddings(df).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


def vectors(n, seed, spread=1.0, levels=None):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(5, 64))
    v = middle[rng.integers(0, 5, n)] + rng.normal(size=(n, 64)) * spread
    v = v if levels is None else np.round(v * levels) / levels
    return [(i, [float(np.float32(x)) for x in r]) for i, r in enumerate(v)]


@pytest.mark.parametrize(("spread", "levels"), [(1.0, None), (0.1, None), (1.0, 1)])
def test_equals_brute_force(spark, monkeypatch, spread, levels):
    monkeypatch.setattr(clusters, "BLOCK_ROWS", 64)
    rows = vectors(500, 4, spread, levels)
    assert got(spark, rows) == brute_force(rows)


def test_awkward_rows(spark):
    nan, inf, one = float("nan"), float("inf"), [1.0] * 64
    rows = [(0, one), (0, one), (0, [0.5] * 64), (None, [2.0] * 64), (1, None), (2, []), (3, [1.0] * 63), (4, [nan] * 64), (5, [inf] * 64), (6, [None] * 64), (7, [-0.0001] * 64), (8, [1.0] * 65)]
    assert got(spark, rows) == brute_force(rows)
    rows += [(i, [float(i % 3)] * 64) for i in range(20, 60)]
    assert got(spark, rows) == brute_force(rows)


def test_large_numbers_stay_exact(spark):
    rows = vectors(60, 5)
    rows += [(100 + i, [x * 1e5 for x in v]) for i, v in vectors(20, 6)] + [(200, [3e38] * 64), (201, [-3e38] * 64), (202, [3e38] * 64)]
    assert got(spark, rows) == brute_force(rows)


def test_fewer_vectors_than_clusters_and_none(spark):
    rows = vectors(3, 7)
    assert got(spark, rows) == brute_force(rows)
    assert got(spark, []) == []


def test_bounds_save_scans():
    """After some rounds most vectors aren't held against all centroids, and none gets another cluster for it."""
    x = np.floor(1024 * np.array([v for _, v in vectors(2000, 8, 0.3)]))
    at = clusters.Centroids([[int(v) for v in r] for r in x[:8]])
    state, scanned = None, []
    for _ in range(10):
        counted, whole = [], clusters._scan
        clusters._scan = lambda rows, c: (counted.append(len(rows)), whole(rows, c))[1]  # noqa: B023
        try:
            state = clusters.assign(x, at, state)
        finally:
            clusters._scan = whole
        scanned.append(sum(counted))
        assert (state[0] == whole(x, at)[0]).all()
        after = [[int(s) // int(n) for s in x[state[0] == c].sum(axis=0)] if (n := (state[0] == c).sum()) else at.rows[c] for c in range(8)]
        at = clusters.Centroids(after, at.rows)
    assert scanned[0] == 2000 and scanned[-1] < 1000
