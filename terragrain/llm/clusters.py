"""Centroid clustering with Hamerly bounds, exact in whole numbers.

Vectors are packed into blocks once, in a table bucketed by block. Every round writes a second,
small table with the vectors' state: cluster, upper bound of the distance to its centroid and lower
bound of the distance to the second nearest. Both tables have the same buckets, so a round joins
them without moving a vector. Bounds are loosened by what the centroids drifted; only vectors whose
bounds meet are held against all centroids. Clusters' sums change by the vectors that moved.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, keep, scratch, settings, task

#: Vectors of a block, and blocks that a Python worker is sent together.
BLOCK_ROWS, BATCH_BLOCKS = 1_024, 16
#: Below this size of components (of 64 and more), all sums are exact in doubles; beyond it Python's integers are used.
SMALL = 1 << 22
#: Sums of large numbers travel in digits of so many bits.
DIGIT_BITS = 30

#: What a block holds, and what a round writes of it: the vectors' state, and how it changes the sums of clusters (digit by digit; the last dimension is the count).
BLOCKS = "block long, ids array<long>, wide boolean, weights binary"
STATE = "block long, cluster binary, upper binary, lower binary, change array<struct<cluster:int,dim:int,digit:int,value:long>>"
ASSIGNED = "vec_id long, cluster int, distance long"


def scaled(embedding: Column, dims: int, scale: int = 1024) -> Column:
    """floor(scale * x) of every component, as doubles that are whole; null where the vector doesn't have ``dims`` finite components."""
    x = F.transform(embedding, lambda v: _floor(v.cast("double") * F.lit(float(scale))))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when((F.size(embedding) == dims) & ~F.coalesce(bad, F.lit(True)), x)


def _floor(v: Column) -> Column:
    """The floor as a double; what is too large for a long has no fraction."""
    return F.when(F.abs(v) < F.lit(float(1 << 53)), F.floor(v).cast("double")).otherwise(v)


def _pack(dims: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("wide", pa.bool_()), ("weights", pa.binary())])

    def pack(batches):
        first, made = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                x = part.column("weights").flatten().to_numpy(zero_copy_only=False)
                wide = bool(np.abs(x).max(initial=0) >= SMALL)
                held = x if wide else x.astype(np.int32)
                yield pa.RecordBatch.from_pylist([{"block": first + made, "ids": part.column("vec_id").to_pylist(), "wide": wide, "weights": held.tobytes()}], schema=schema)
                made += 1

    return task("clusters", pack)


class Centroids:
    """Centroids of one round, and what they say about the last round's bounds."""

    def __init__(self, rows: list[list[int]], before: list[list[int]] | None = None):
        self.rows, self.k, self.dims = rows, len(rows), len(rows[0])
        self.small = max(abs(x) for r in rows for x in r) < SMALL
        self.drift = np.array([0.0 if before is None else _above(float(_square(a, b))) for a, b in zip(rows, before or rows, strict=True)])
        # Half of the distance to the nearest other centroid: nothing nearer to its own can have another one.
        nearest = [min((_square(a, b) for j, b in enumerate(rows) if j != i), default=None) for i, a in enumerate(rows)]
        self.half = np.array([np.inf if d is None else _below(float(d)) / 2 for d in nearest])
        #: By cluster, the largest drift of any other.
        self.others = np.array([max((self.drift[j] for j in range(self.k) if j != i), default=0.0) for i in range(self.k)])

    def distances(self, x: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
        """Exact squared distances of the lines of ``x`` to all centroids, or to the one that ``of`` names for each."""
        if self.small and x.dtype != object:
            c = np.array(self.rows, dtype=np.float64)
            if of is not None:
                return ((x - c[of]) ** 2).sum(axis=1)
            return (x**2).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c**2).sum(axis=1)[None, :]
        c, x = np.array(self.rows, dtype=object), _integers(x)
        if of is not None:
            return ((x - c[of]) ** 2).sum(axis=1)
        return np.stack([((x - r) ** 2).sum(axis=1) for r in c], axis=1)


def _square(a: list[int], b: list[int]) -> int:
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def _above(square):
    """No less than the root, whatever was rounded."""
    root = np.sqrt(np.asarray(square, dtype=np.float64))
    return np.nextafter(np.nextafter(root, np.inf), np.inf)


def _below(square):
    root = np.sqrt(np.asarray(square, dtype=np.float64))
    return np.nextafter(np.nextafter(root, -np.inf), -np.inf)


def _integers(x: np.ndarray) -> np.ndarray:
    return x if x.dtype == object else np.array([[int(v) for v in r] for r in x], dtype=object).reshape(x.shape)


def _scan(x: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cluster (ties: the smaller number), upper and lower bound of vectors held against all centroids."""
    d = centroids.distances(x)
    cluster = np.argmin(d, axis=1).astype(np.int32)
    lines = np.arange(len(x))
    upper = _above(d[lines, cluster])
    if centroids.k == 1:
        return cluster, upper, np.full(len(x), np.inf)
    rest = d.astype(np.float64)
    rest[lines, cluster] = np.inf
    return cluster, upper, _below(rest.min(axis=1))


def assign(x: np.ndarray, centroids: Centroids, state: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cluster, upper and lower bound of every line of ``x``, from those of the last round."""
    if state is None:
        return _scan(x, centroids)
    cluster, upper, lower = (v.copy() for v in state)
    upper = np.nextafter(upper + centroids.drift[cluster], np.inf)
    lower = np.nextafter(lower - centroids.others[cluster], -np.inf)
    open_ = np.flatnonzero(upper >= np.maximum(lower, centroids.half[cluster]))
    upper[open_] = _above(centroids.distances(x[open_], cluster[open_]))
    open_ = open_[upper[open_] >= np.maximum(lower[open_], centroids.half[cluster[open_]])]
    if len(open_):
        cluster[open_], upper[open_], lower[open_] = _scan(x[open_], centroids)
    return cluster, upper, lower


def changes(x: np.ndarray, before: np.ndarray | None, after: np.ndarray) -> list[dict]:
    """By how much each cluster's sums change, and, as one more dimension, its count."""
    moved = np.arange(len(x)) if before is None else np.flatnonzero(before != after)
    total: dict[int, list[int]] = {}
    for sign, cluster in ((1, after), *([] if before is None else [(-1, before)])):
        for c in np.unique(cluster[moved]):
            lines = moved[cluster[moved] == c]
            sums = [*(sign * int(v) for v in x[lines].sum(axis=0)), sign * len(lines)]
            total[int(c)] = [a + b for a, b in zip(total.get(int(c), [0] * len(sums)), sums, strict=True)]
    return [{"cluster": c, "dim": d, "digit": k, "value": v} for c, sums in total.items() for d, s in enumerate(sums) for k, v in _digits(s)]


def _digits(value: int) -> Iterator[tuple[int, int]]:
    """A number's digits that aren't 0, from the lowest; the last one may be as large as sums of it allow."""
    digit = 0
    while abs(value) >= 1 << 2 * DIGIT_BITS - 20:
        value, low = divmod(value, 1 << DIGIT_BITS)
        yield digit, low
        digit += 1
    if value:
        yield digit, value


def _matrix(row: dict, dims: int) -> np.ndarray:
    x = np.frombuffer(row["weights"], dtype=np.float64 if row["wide"] else np.int32).reshape(-1, dims)
    return _integers(x) if row["wide"] else x.astype(np.float64)


def _state(row: dict):
    return None if row.get("cluster") is None else (np.frombuffer(row["cluster"], np.int32), np.frombuffer(row["upper"], np.float64), np.frombuffer(row["lower"], np.float64))


def _round(centroids: Centroids) -> Callable:
    change = pa.list_(pa.struct([("cluster", pa.int32()), ("dim", pa.int32()), ("digit", pa.int32()), ("value", pa.int64())]))
    schema = pa.schema([("block", pa.int64()), ("cluster", pa.binary()), ("upper", pa.binary()), ("lower", pa.binary()), ("change", change)])

    def work(batches):
        for batch in batches:
            for row in batch.to_pylist():
                x, state = _matrix(row, centroids.dims), _state(row)
                cluster, upper, lower = assign(x, centroids, state)
                before = None if state is None else state[0]
                yield pa.RecordBatch.from_pylist([{"block": row["block"], "cluster": cluster.tobytes(), "upper": upper.tobytes(), "lower": lower.tobytes(), "change": changes(x, before, cluster)}], schema=schema)

    return task("clusters", work)


def _last(centroids: Centroids) -> Callable:
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def work(batches):
        for batch in batches:
            for row in batch.to_pylist():
                x = _matrix(row, centroids.dims)
                cluster = assign(x, centroids, _state(row))[0]
                distance = [int(d) if d < 1 << 63 else None for d in centroids.distances(x, cluster)]
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], schema=schema)

    return task("clusters", work)


class _Bucketed:
    """Tables bucketed by block, each with a name in the session's catalogue until ``drop``."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.names = spark, buckets, []

    def write(self, rows: DataFrame) -> DataFrame:
        name = f"clusters_{uuid.uuid4().hex}"
        self.names.append(name)
        rows.write.format("parquet").bucketBy(self.buckets, "block").option("path", fresh_path(self.spark, name)).saveAsTable(name)
        return self.spark.table(name)

    def drop(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def clusters(vectors: DataFrame, seeds: Column, k: int = 8, rounds: int = 10, dims: int = 64) -> DataFrame:
    """Per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    ``vectors`` has vec_id and weights (array of whole doubles; null: takes no part). The first
    centroids are the ``k`` vectors with the smallest ``seeds``, null last, equal ones by their weights;
    they and the clusters' sums, k times ``dims`` numbers, are all that the driver sees. Repeated ids and
    null ids are vectors of their own; fewer vectors than ``k`` make fewer centroids; no vectors, no
    rows. A distance or an inertia that doesn't fit in a long is null.
    """
    spark = vectors.sparkSession
    usable = vectors.where(F.col("weights").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "weights", seeds.alias("seed"))
    first = usable.orderBy(F.col("seed").asc_nulls_last(), "weights").limit(k).collect()
    if not first:
        return spark.createDataFrame([], f"{ASSIGNED}, cluster_inertia long, inertia long, centroid_sha256 string")
    rows = [[int(x) for x in r["weights"]] for r in first]
    small = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BLOCK_ROWS)}
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tables = _Bucketed(spark, buckets)
    with scratch(spark):
        try:
            with settings(spark, small):
                packed = usable.select("vec_id", "weights").mapInArrow(_pack(dims), BLOCKS)
                blocks = tables.write(packed.repartition(buckets, "block"))
            with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_BLOCKS)}):
                held, centroids = blocks, Centroids(rows)
                totals = [[0] * (dims + 1) for _ in rows]
                for _ in range(rounds):
                    state = tables.write(held.mapInArrow(_round(centroids), STATE))
                    each = state.select(F.explode("change").alias("c")).groupBy("c.cluster", "c.dim", "c.digit").agg(F.sum("c.value").alias("value"))
                    for r in each.collect():  # k * (dims + 1) sums of few digits
                        totals[r["cluster"]][r["dim"]] += r["value"] << DIGIT_BITS * r["digit"]
                    after = [[v // t[-1] for v in t[:-1]] if t[-1] else c for t, c in zip(totals, centroids.rows, strict=True)]
                    held = blocks.join(state.select("block", "cluster", "upper", "lower").hint("shuffle_hash"), "block")
                    centroids = Centroids(after, centroids.rows)
                    if not centroids.drift.any():  # nothing moves any more
                        break
                assigned = keep(held.mapInArrow(_last(centroids), ASSIGNED), "clusters")
        finally:
            tables.drop()
    return _with_sums(assigned, centroids)


def _with_sums(assigned: DataFrame, centroids: Centroids) -> DataFrame:
    fits = lambda v: v if v is not None and v < 1 << 63 else None
    sums = {r["cluster"]: r for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"), F.count_if(F.col("distance").isNull()).alias("over")).collect()}
    inertia = {c: None if r["over"] else int(r["total"]) for c, r in sums.items()}
    whole = None if None in inertia.values() else sum(inertia.values())
    digest = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.rows]
    known = [(c, fits(v), fits(whole), digest[c]) for c, v in inertia.items()]  # k rows
    named = assigned.sparkSession.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def cluster_embeddings(embeddings: DataFrame) -> DataFrame:
    """Eight clusters of the embeddings of 64 finite components, after ten rounds (see ``clusters``).

    The first centroids go by the SHA-256 of ``3:<vec_id>``. Vectors that are null, of another length
    or with null or non-finite components take no part; other columns neither.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding"), 64).alias("weights"))
    return clusters(rows, F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256))


def _sql(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
d{r} AS MATERIALIZED (
  SELECT v.row, c.cluster, CAST(list_sum(list_transform(range(1, {dims + 1}), lambda i: (v.w[i] - c.w[i]) * (v.w[i] - c.w[i]))) AS BIGINT) AS distance FROM v CROSS JOIN c{r} c),
a{r} AS MATERIALIZED (
  SELECT * FROM d{r} QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, cluster) = 1)""")
        if r < rounds:
            steps.append(f"""
m{r} AS (
  SELECT cluster, list(CAST(floor_sum AS BIGINT) ORDER BY i) AS w FROM (
    SELECT a.cluster, i, (CAST(sum(v.w[i]) AS HUGEINT) - ((CAST(sum(v.w[i]) AS HUGEINT) % count(*)) + count(*)) % count(*)) // count(*) AS floor_sum
    FROM a{r} a JOIN v USING (row) CROSS JOIN range(1, {dims + 1}) t(i) GROUP BY a.cluster, i) GROUP BY cluster),
c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.w, c.w) AS w FROM c{r} c LEFT JOIN m{r} m USING (cluster))""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h, w) - 1 AS INTEGER) AS cluster, w FROM (
    SELECT w, sha256('3:' || vec_id) AS h FROM v ORDER BY h, w LIMIT {k})),{",".join(steps)}
SELECT v.vec_id, a.cluster, a.distance,
  CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(a.distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.w, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (row) JOIN c{rounds} c ON c.cluster = a.cluster
"""


SQL = _sql()
