"""Exact top-k search by inner product, with MaxScore over sharded postings.

A dimension is a term, and its posting list in a shard is the column of the shard's weights. Queries
come in blocks, rows in shards, and every pair of a block and a shard is one task's bounded work. In
it, each query's terms are ordered by how much they can still add; the non-essential ones are those
that together can't lift a row into the top k. Essential postings are traversed for all rows of a
range, and the others are probed, a few terms at a time, for the rows that stay competitive. The
shards' best rows are merged per query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, materialise, scratch

#: Weights of a shard's rows and of a block's queries, on average: a task holds one of each. Every row
#: is sent once per block and every query once per shard, so what is sent falls with both sizes.
SHARD_WEIGHTS, BLOCK_WEIGHTS = 1 << 22, 1 << 21
#: Rows that a shard has at least where more shards would only keep more tasks busy.
LEAST_SHARD_ROWS = 4_096
#: Rows that are scored between two updates of a query's threshold.
RANGE_ROWS = 4_096
#: Terms that are probed at a time.
PROBE_TERMS = 8


def integer_weights(embedding: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component as long; null where the vector, or a component, is null or isn't finite."""
    x = F.transform(embedding, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(embedding.isNotNull() & ~F.coalesce(bad, F.lit(True)), F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("long")))


class Shard:
    """Posting lists of some rows: one line of weights per term, rows in ascending id."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        self.exact = weights[order].T.copy()
        self.ranges = [slice(a, min(a + RANGE_ROWS, len(ids))) for a in range(0, len(ids), RANGE_ROWS)]
        self.lists = self.exact.astype(np.float64)
        self.low = [self.lists[:, r].min(axis=1) for r in self.ranges]
        self.high = [self.lists[:, r].max(axis=1) for r in self.ranges]
        self.largest = max((int(abs(int(self.exact.min()))), int(abs(int(self.exact.max())))), default=0) if self.exact.size else 0

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best (ids, scores) without the query's own row; ties to the smaller id."""
        if not len(self.ids):
            return self.ids, np.zeros(0, dtype=np.int64)
        # Floating point is exact while no sum reaches 2 ** 53; else whole numbers are used throughout.
        floats = self.largest * int(np.abs(query).max(initial=0)) * max(len(query), 1) < 2**53
        q = query.astype(np.float64) if floats else query
        lists = self.lists if floats else self.exact
        best_ids, best = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=q.dtype)
        for r, low, high in zip(self.ranges, self.low, self.high, strict=True):
            ids = self.ids[r]
            least = best[-1] if len(best) == k else None
            if least is None or not floats:
                rows, scores = np.arange(len(ids)), q @ lists[:, r]
            else:
                bound = np.maximum(q * low, q * high)
                order = np.argsort(np.maximum(np.abs(q * low), np.abs(q * high)), kind="stable")[::-1]
                rest = np.r_[np.cumsum(bound[order][::-1])[::-1], 0.0]  # what the terms from here on add at most
                if rest[0] <= least:
                    continue
                # Terms are non-essential from where a row with middling essential parts can't make it any more.
                middle = np.r_[0.0, np.cumsum((q * (low + high) / 2)[order])]
                essential = max(1, int(np.argmax(middle + rest <= least)) if (middle + rest <= least).any() else len(order))
                terms = order[:essential]
                scores = q[terms] @ lists[terms, r]
                rows = np.flatnonzero(scores + rest[essential] > least)
                scores = scores[rows]
                for at in range(essential, len(order), PROBE_TERMS):
                    if not len(rows):
                        break
                    terms = order[at : at + PROBE_TERMS]
                    scores = scores + q[terms] @ lists[terms[:, None], (r.start + rows)[None, :]]
                    competitive = scores + rest[min(at + PROBE_TERMS, len(order))] > least
                    rows, scores = rows[competitive], scores[competitive]
            own = ids[rows] != query_id
            rows, scores = rows[own], scores[own]
            ids_, scores_ = np.concatenate([best_ids, ids[rows]]), np.concatenate([best, scores])
            if len(ids_) > 4 * k:  # only what can be among the k best is sorted
                floor = np.partition(scores_, len(scores_) - k)[len(scores_) - k]
                ids_, scores_ = ids_[scores_ >= floor], scores_[scores_ >= floor]
            top = np.lexsort((ids_, -scores_))[:k]
            best_ids, best = ids_[top], scores_[top]
        return best_ids, best.astype(np.int64)


def _matrix(vectors: list[np.ndarray], dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), dtype=np.int64)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def _cell(k: int):
    def search(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(rows) and len(queries):
            dims = max(max(map(len, rows["weights"])), max(map(len, queries["weights"])))
            shard = Shard(rows["vec_id"].to_numpy(), _matrix(list(rows["weights"]), dims))
            for query_id, query in zip(queries["vec_id"], _matrix(list(queries["weights"]), dims), strict=True):
                ids, scores = shard.search(query_id, query, k)
                found.append((np.full(len(ids), query_id), ids, scores))
        parts = [np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), parts, strict=True)))

    return search


def top_k(vectors: DataFrame, queries: Column, k: int = 10) -> DataFrame:
    """Per query: query_id, rank (from 1), vec_id, score of the ``k`` rows with the highest inner product.

    ``vectors`` has vec_id and weights (array of long; null: takes no part); ``queries`` tells the rows
    that are queries. A query's own id is no candidate. Repeated ids count once, with the smallest
    vector; a null id takes no part; a shorter vector has zeros beyond its end. Scores are exact where
    they fit in a long.
    """
    with scratch(vectors.sparkSession):
        return keep(_search(vectors, queries, k), "top-k")


def deal(rows: int, queries: int, dims: int, tasks: int) -> tuple[int, int]:
    """How many shards and blocks: as large as memory allows, but shards enough to keep ``tasks`` busy."""
    shards = max(-(-rows * dims // SHARD_WEIGHTS), min(tasks, rows // LEAST_SHARD_ROWS), 1)
    return shards, max(-(-queries * dims // BLOCK_WEIGHTS), 1)


def _search(vectors: DataFrame, queries: Column, k: int) -> DataFrame:
    usable = vectors.where(F.col("weights").isNotNull() & F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min("weights").alias("weights"))
    usable = materialise(usable, "vectors")
    asked = usable.where(queries)
    seen = usable.agg(F.count(F.lit(1)).alias("rows"), F.count_if(queries).alias("queries"), F.max(F.size("weights")).alias("dims")).first()
    shards, blocks = deal(seen["rows"], seen["queries"], seen["dims"] or 1, vectors.sparkSession.sparkContext.defaultParallelism)

    def dealt(rows: DataFrame, to: str, n: int, beside: str, m: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias(to)
        return rows.select("vec_id", "weights", mine, F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(beside))

    left = dealt(usable, "shard", shards, "block", blocks).groupBy("shard", "block")
    right = dealt(asked, "block", blocks, "shard", shards).groupBy("shard", "block")
    found = left.cogroup(right).applyInPandas(_cell(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_embeddings(embeddings: DataFrame) -> DataFrame:
    """The 10 best rows for every embedding whose vec_id is divisible by 100 (see ``top_k``)."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), integer_weights(F.col("embedding")).alias("weights"))
    return top_k(rows, F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(CAST(q.w AS DOUBLE[]), CAST(d.w AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 10
"""
