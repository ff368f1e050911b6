"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager, suppress
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; on a local master, where it is unset, a fresh one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="corpus-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet; it goes with the innermost ``scratch`` block."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _blocks:
        _blocks[-1].append(path)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path is there, on whichever store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


#: Paths of the ``scratch`` blocks that are open, from the outermost.
_blocks: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables that were written inside, except those that ``keep`` was told."""
    _blocks.append([])
    try:
        yield
    finally:
        for path in _blocks.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def keep(df: DataFrame, name: str) -> DataFrame:
    """``materialise`` for what outlives the innermost ``scratch`` block: it goes with the next one, if any."""
    df = materialise(df, name)
    if _blocks:
        path = _blocks[-1].pop()
        if len(_blocks) > 1:
            _blocks[-2].append(path)
    return df


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back.

    This cuts the lineage, survives lost executors, and lets Spark see the table's size when it
    picks a join.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of one key that a task takes, at least, before the key is split; and keys that are split at most.
HOT_ROWS, HOT_KEYS = 1_000, 10_000


def hot_keys(counts: DataFrame, keys: list[str]) -> DataFrame | None:
    """The keys that many rows have, and in how many parts to deal each: (keys, parts). None where there are none.

    ``counts`` has the keys and ``n``. A key is hot from HOT_ROWS rows on, or a HOT_KEYS-th of all such
    rows, so the table has fewer than HOT_KEYS rows whatever the input is, and can be broadcast.
    """
    total = counts.where(F.col("n") > HOT_ROWS).agg(F.sum("n")).first()[0]
    if not total:
        return None
    most = max(HOT_ROWS, total // HOT_KEYS)
    return materialise(counts.where(F.col("n") > most).select(*keys, F.ceil(F.col("n") / most).cast("int").alias("parts")), "hot-keys")


def hot_keys_of(rows: DataFrame, keys: list[str]) -> DataFrame | None:
    """``hot_keys`` of a table's own rows, which aren't counted by key where they are few."""
    return None if rows.count() <= HOT_ROWS else hot_keys(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys)


def split_join(many: DataFrame, one: DataFrame, keys: list[str], by: str | Column, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """Joins ``many`` with ``one``, which has one row per key, with the rows of hot keys dealt over several tasks.

    ``by`` is what tells the rows of a key apart; a hot key's row of ``one`` goes to all of its parts.
    Null keys meet nothing.
    """
    if hot is None:
        return many.join(one, keys, how)
    hot = F.broadcast(hot)
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(by), F.col("parts"))).cast("int")
    left = many.join(hot, keys, "left").withColumn("_part", part).drop("parts")
    right = one.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return left.join(right, [*keys, "_part"], how).drop("_part")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings that hold for a while, then go back to what they were."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Arrow batches of long texts are kept small, as both sides of a Python stage hold one or two of them.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def stay_small(spark: SparkSession) -> None:
    """SMALL_BATCHES from now on, unless the session's batches are smaller: for a result that is computed when the caller reads it."""
    for k, v in SMALL_BATCHES.items():
        now = int(spark.conf.get(k))
        if now <= 0 or now > int(v):
            spark.conf.set(k, v)


#: What operators remember in a Python worker from task to task, by operator, with the way to drop it.
_remembered: dict[str, Callable[[], None]] = {}


def remember(operator: str, drop: Callable[[], None]) -> None:
    _remembered[operator] = drop


def give_back() -> None:
    """Gives the memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def start_task(operator: str) -> None:
    """Drops what other operators' tasks remember in this Python worker, which serves them in turn."""
    for name in [n for n in _remembered if n != operator]:
        _remembered.pop(name)()
        gc.collect()
    give_back()


def task(operator: str, work: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """``work`` as a task of ``operator`` that leaves no freed memory with the worker."""

    def run(batches: Iterable) -> Iterator:
        start_task(operator)
        yield from work(batches)
        give_back()

    return run


def text_slices(batches: Iterable[pa.RecordBatch], rows: int = 256, size: int = 1 << 20, text: Callable = lambda batch: batch.column("text")) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, and of few bytes of text unless one row has more."""
    for batch in batches:
        so_far = np.cumsum(np.r_[0, pc.fill_null(pc.binary_length(text(batch)), 0).to_numpy(zero_copy_only=False)].astype(np.int64))
        at = 0
        while at < batch.num_rows:
            fits = int(np.searchsorted(so_far, so_far[at] + size, side="right")) - 1
            end = min(max(fits, at + 1), at + rows, batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


class Recent:
    """Values by key, worked out together while they are in use; what it holds stays within ``budget`` bytes, twice.

    Keys and values are texts or bytes; ``make`` gives the values of a list of keys. A full generation
    is kept as the older one, and what is asked for again moves to the newer.
    """

    #: Bytes of an entry besides the contents of key and value: two objects and their place in the table.
    ENTRY = 200

    def __init__(self, make: Callable[[list], Iterable], budget: int = 16 << 20):
        self.make, self.budget = make, budget
        self.newer: dict = {}
        self.older: dict = {}
        self.held = 0

    def holding(self, keys: set) -> dict:
        """A table that has all ``keys``, until the next call."""
        missing = keys.difference(self.newer)
        if missing and self.held > self.budget:
            self.older, self.newer, self.held = self.newer, {}, 0
            missing = keys
        again = missing.intersection(self.older)
        fresh = list(missing.difference(again))
        added = {k: self.older[k] for k in again} | dict(zip(fresh, self.make(fresh), strict=True))
        self.newer |= added
        self.held += self.ENTRY * len(added) + sum(map(len, added)) + sum(map(len, added.values()))
        return self.newer

    def clear(self) -> None:
        self.newer, self.older, self.held = {}, {}, 0


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once per application."""
    context = spark.sparkContext
    if not getattr(context, "_corpus_shipped", False):
        package = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp()  # the driver serves the file from here as long as it runs
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name))
        context._corpus_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words, null counting as no text: each word with the white space after it becomes one mark."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+", "")
    return F.length(F.regexp_replace(marks, r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "w")).cast("long")


def min_by_order(*keys: Column) -> Column:
    """The smallest struct of ``keys`` with nulls last."""
    parts = []
    for k, c in enumerate(keys):
        parts += [c.isNull().alias(f"null_{k}"), c.alias(f"key_{k}")]
    return F.min(F.struct(*parts))
