"""A histogram that grows: a stored table of partial counts, to which increments are added once.

An increment is counted into a part of its own, named after its number, and nothing else is written.
When there are several parts of a size, they are merged into one of the next size, so a count is
rewritten as often as there are sizes, and a grid has few parts. A part counts from when it is whole:
an increment that is handed over again, or a merge that was broken off, changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import density
from ..sources.folders import exists

#: Parts of one size that are merged into one.
MERGED = 8
COUNTS = "res int, x int, y int, cnt long"


class Grid:
    """The counts of all resolutions, in the folder ``path``; only those are stored that no finer one contains."""

    def __init__(self, spark: SparkSession, path: str, resolutions: Iterable[int]):
        self.spark, self.path, self.within = spark, path.rstrip("/"), density.bases(resolutions)

    def parts(self) -> list[tuple[int, int, int]]:
        """(size, first, last) of the whole parts, in order; those that a larger one has taken in are left out."""
        if not exists(self.spark, self.path):
            return []
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        store = place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        names = [s.getPath().getName() for s in store.listStatus(place)]
        whole = [tuple(map(int, n.split("-"))) for n in names if n.count("-") == 2 and exists(self.spark, f"{self.path}/{n}/_SUCCESS")]
        kept: list[tuple[int, int, int]] = []
        for part in sorted(whole, key=lambda p: (p[1], -p[2])):
            if not kept or part[1] > kept[-1][2]:
                kept.append(part)
        return kept

    def add(self, points: DataFrame, number: int) -> bool:
        """Counts the points of an increment; numbers grow, and one that isn't above the last is known already: then nothing changes."""
        parts = self.parts()
        if parts and number <= parts[-1][2]:
            return False
        self._write(density.cell_counts(points, self.within), (0, number, number))
        parts.append((0, number, number))
        while len(parts) >= MERGED and len({size for size, _, _ in parts[-MERGED:]}) == 1:
            merged = parts[-MERGED:]
            one = (merged[0][0] + 1, merged[0][1], merged[-1][2])
            self._write(self._summed(merged), one)
            parts[-MERGED:] = [one]
            for part in merged:
                self._delete(part)
        return True

    def counts(self) -> DataFrame:
        """(res, x, y, cnt) of all that has been added, at every resolution."""
        parts = self.parts()
        return density.with_coarser(self._summed(parts) if parts else self.spark.createDataFrame([], COUNTS), self.within)

    def follow(self, points: DataFrame, state: str, every: str | None = "1 minute") -> StreamingQuery:
        """Starts a query that adds a stream's micro-batches; without ``every`` it ends with what is there now."""
        when = {"availableNow": True} if every is None else {"processingTime": every}
        return points.writeStream.foreachBatch(lambda batch, number: self.add(batch, number) and None).option("checkpointLocation", state).trigger(**when).start()

    def _at(self, part: tuple[int, int, int]) -> str:
        return f"{self.path}/{'-'.join(map(str, part))}"

    def _write(self, counts: DataFrame, part: tuple[int, int, int]) -> None:
        counts.select("res", "x", "y", "cnt").write.mode("overwrite").parquet(self._at(part))

    def _summed(self, parts: list[tuple[int, int, int]]) -> DataFrame:
        each = reduce(DataFrame.unionByName, [self.spark.read.schema(COUNTS).parquet(self._at(p)) for p in parts])
        return each.groupBy("res", "x", "y").agg(F.sum("cnt").alias("cnt"))

    def _delete(self, part: tuple[int, int, int]) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self._at(part))
        place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
