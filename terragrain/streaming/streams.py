"""The filters, histograms and samples over unbounded input."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from ..operators import density
from ..sources.folders import exists, fresh_path


@contextmanager
def state_on_disk(spark: SparkSession):
    """Streaming queries that are started meanwhile keep their state in RocksDB, beyond the executors' memory."""
    name, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a streaming query over what its source holds now, and reads back what it wrote: no rows where there were none."""
    spark = stream.sparkSession
    base = fresh_path(spark, "stream")
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", f"{base}/out").outputMode("append")
    else:
        writer = stream.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{base}/out")).outputMode(mode)
    with state_on_disk(spark):
        writer.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out") if exists(spark, f"{base}/out") else spark.createDataFrame([], stream.schema)


def follow(lines: DataFrame, path: str, state: str, every: str | None = "10 seconds", progress: Callable[[dict], None] | None = None) -> StreamingQuery:
    """Starts a query that writes the column ``value`` of a stream to text files as lines come, until it is stopped.

    ``state`` keeps how far it came, so a restart goes on there; without ``every`` it ends with what is
    there now. ``progress`` is told of every micro-batch: its number, its rows, rows a second, and the
    rows that were written.
    """
    if progress is not None:
        lines.sparkSession.streams.addListener(_Progress(progress))
    counted = lines.select("value").observe("written", F.count(F.lit(1)).alias("rows"))
    when = {"availableNow": True} if every is None else {"processingTime": every}
    with state_on_disk(lines.sparkSession):
        return counted.writeStream.format("text").option("path", path).option("checkpointLocation", state).trigger(**when).start()


class _Progress(StreamingQueryListener):
    def __init__(self, tell: Callable[[dict], None]):
        self.tell = tell

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.tell({"batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond, "written": p.observedMetrics["written"].rows if "written" in p.observedMetrics else None})

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...


def stream_histogram(points: DataFrame, resolutions: Iterable[int]) -> DataFrame:
    """The multi-resolution histogram of a stream, kept up to date: use output mode complete or update."""
    return density.histogram(points, resolutions)


class _EveryNth(StatefulProcessor):
    """Counts the rows of a key for good, and lets every nth pass; the rows of a micro-batch go by ``order``."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        batch = batch.sort_values([c for c in batch.columns if c.startswith("order")], kind="stable")
        before = self.count.get()[0] if self.count.exists() else 0
        self.count.update((before + len(batch),))
        yield batch.iloc[(self.n - 1 - before) % self.n :: self.n][["value"]]

    def close(self) -> None: ...


def sample_lines(rows: DataFrame, n: int, key: str, order: list[str]) -> DataFrame:
    """Every nth row of each key of a stream (key, order, value), as its ``value``: a text that stands for the row.

    The count of a key is kept in the state store without end, so a micro-batch reads nothing of
    earlier ones. The rows that one key has in one micro-batch are ordered in one task: the source's
    ``maxFilesPerTrigger`` or ``maxBytesPerTrigger`` bounds them.
    """
    if n < 1:
        raise ValueError("n must be 1 or more")
    plain = rows.select(F.col(key).alias("key"), *[F.col(c).alias(f"order{k}") for k, c in enumerate(order)], "value")  # in Python, names with a leading _ are lost
    return plain.groupBy("key").transformWithStateInPandas(_EveryNth(n), "value string", "Append", "None")


#: Times as text that keep their microseconds.
_EXACT_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def every_nth_per_key(rows: DataFrame, n: int, key: str, order: str) -> DataFrame:
    """Every nth row of each key over what the stream holds now; a micro-batch's rows go by the column ``order``."""
    whole = F.to_json(F.struct(*rows.columns), _EXACT_TIMES)
    picked = drain(sample_lines(rows.select(F.col(key), F.col(order), whole.alias("value")), n, key, [order]))
    return picked.select(F.from_json("value", rows.schema.simpleString(), _EXACT_TIMES).alias("r")).select("r.*")


def key_counts(spark: SparkSession, state: str) -> DataFrame:
    """(key, n) of a ``sample_lines``, as of the last micro-batch that is done, from the state that it keeps in the folder ``state``."""
    counts = spark.read.format("statestore").option("stateVarName", "count").load(state)
    return counts.select("key.key", "value.n")


def with_arrival(lines: DataFrame) -> DataFrame:
    """Adds _time, _file, _start and _row to lines of a stream of files: the order in which the files came, and the lines stand in them."""
    placed = lines.select("value", F.col("_metadata.file_modification_time").alias("_time"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    return placed.mapInArrow(_numbered, "value string, _time timestamp, _file string, _start long, _row long")


ARRIVAL = ["_time", "_file", "_start", "_row"]


def _numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    so_far = 0
    for batch in batches:
        row = pa.array(range(so_far, so_far + batch.num_rows), pa.int64())
        so_far += batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, row], names=[*batch.schema.names, "_row"])


def report_counts(spark: SparkSession, query: StreamingQuery, state: str, every: int, tell: Callable[[dict], None]) -> None:
    """While a sample runs, tells all keys' counts each time that ``every`` more rows have been written, and once when it ends.

    How many were written, the sink's metrics say; the counts come from the state store, key by key.
    """
    written, told, seen = 0, 0, -1
    while True:
        ended = query.awaitTermination(1)
        for p in query.recentProgress:
            if p["batchId"] > seen and p["numInputRows"]:
                seen = p["batchId"]
                written += p["observedMetrics"]["written"]["rows"]
        if ended or written // every > told:
            told = written // every
            tell({r["key"]: r["n"] for r in key_counts(spark, state).toLocalIterator()} if seen >= 0 else {})
        if ended:
            return
