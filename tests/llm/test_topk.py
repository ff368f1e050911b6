import math

import numpy as np
import pytest

from terragrain.llm import topk


def brute_force(rows, k=10):
    usable = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            w = [math.floor(1024 * x) for x in v]
            usable[i] = min(usable[i], w) if i in usable else w
    out = []
    for q in usable:
        if q % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(usable[q], v, strict=False)), i) for i, v in usable.items() if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def got(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' AS weights", "1 AS shard", "1 AS rank")
    return sorted(map(tuple, topk.search_embeddings(df).select("query_id", "rank", "vec_id", "score").collect()))


def vectors(n, dims, seed, levels=None):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dims)) if levels is None else rng.integers(-levels, levels + 1, size=(n, dims)) / 4
    return [(i, [float(np.float32(x)) for x in row]) for i, row in enumerate(v)]


@pytest.mark.parametrize("levels", [None, 1])
def test_equals_brute_force(spark, monkeypatch, levels):
    rows = vectors(900, 12, 3, levels)
    assert got(spark, rows) == brute_force(rows)


def test_ranges_skip_and_probe_without_loss():
    rng = np.random.default_rng(5)
    topk_ranges, topk.RANGE_ROWS = topk.RANGE_ROWS, 64
    try:
        weights = (rng.normal(size=(2000, 32)) * np.geomspace(1, 200, 32)).astype(np.int64)
        shard = topk.Shard(np.arange(2000), weights)
        for q in range(0, 2000, 97):
            ids, scores = shard.search(q, weights[q], 10)
            full = weights @ weights[q]
            full[q] = -(2**62)
            order = np.lexsort((np.arange(2000), -full))[:10]
            assert ids.tolist() == order.tolist() and scores.tolist() == full[order].tolist()
    finally:
        topk.RANGE_ROWS = topk_ranges


def test_several_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_WEIGHTS", 600)
    monkeypatch.setattr(topk, "BLOCK_WEIGHTS", 12)
    rows = vectors(700, 6, 8, 2)
    assert got(spark, rows) == brute_force(rows)


def test_cells_are_bounded_and_tasks_busy():
    assert topk.deal(0, 0, 1, 8) == (1, 1)
    assert topk.deal(25_000, 250, 64, 8) == (6, 1)
    shards, blocks = topk.deal(10**9, 10**7, 64, 8000)
    assert 10**9 * 64 / shards <= topk.SHARD_WEIGHTS and 10**7 * 64 / blocks <= topk.BLOCK_WEIGHTS


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [0.5, 2.0]), (100, [1.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, []), (None, [1.0, 1.0]), (200, None), (8, [1e6, -1e6, 3.0]), (300, [1e6, 1e6])]
    assert got(spark, rows) == brute_force(rows)


def test_fewer_rows_than_asked_and_none(spark):
    assert got(spark, [(0, [1.0]), (5, [2.0])]) == [(0, 1, 5, 1024 * 2048)]
    assert got(spark, []) == []
