"""Mixing sources to target weights by weighted fair queueing.

Every document gets a place in its source's shuffled order. Its virtual finish time is the number of
source words up to and including it, divided by the source's target; a source whose target exceeds
its size goes round again, up to ``max_repeats`` times. All documents are then ordered by virtual
finish time over the whole corpus, and the order is cut where the total budget is spent.

Within a source what is taken is a prefix of its order, so the cut reduces to one boundary per
source, against which each document is held where it lies: texts are never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, materialise, scratch, word_count

#: Rows that one running sum covers, on average.
BLOCK_ROWS = 2_048
#: Blocks of a source, or ranges of finish time, that one task sums up.
FAN = 4_096
#: Rows of one document id and text that are placed together.
ALIKE = 1_024


def shuffle_key(doc_id: Column, text: Column) -> Column:
    """The place of a document in the shuffle: the same on every run, and in any SQL engine.

    Rows without an id, or with a repeated one, have places of their own wherever their texts differ.
    """
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))


def source_targets(sizes: DataFrame, weights: Sequence[float], max_repeats: int) -> DataFrame:
    """Per source: source (null last by code point), source_size, target.

    Sources weigh ``weights``, repeating, and share the words of all; a target stops at
    ``max_repeats`` times its source's size and the rest is shared again by weight. That ends at one
    level: with the sources in order of cap by weight, the level is what the uncapped ones get per
    unit of weight. Only one row per source goes through these windows.
    """
    every = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("position", F.row_number().over(every) - 1)
    weighed = ranked.withColumn("weight", F.element_at(cycle, (F.col("position") % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * max_repeats)
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "position")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    levels = weighed.select(
        "*",
        F.sum("source_size").over(whole).alias("budget"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("capped"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("open_weight"),
    ).withColumn("level", (F.col("budget") - F.col("capped")).cast("double") / F.col("open_weight"))
    # The level is the one of the first source, in order of cap by weight, that its own cap holds.
    fits = levels.withColumn("holds", F.col("level") * F.col("weight") <= F.col("cap"))
    level = F.min_by("level", F.when(F.col("holds"), F.struct(F.col("cap") / F.col("weight"), F.col("position")))).over(whole)
    chosen = fits.withColumn("at", level)
    target = F.when(F.col("at").isNull() | (F.col("at") * F.col("weight") >= F.col("cap")), F.col("cap").cast("double")).otherwise(F.col("at") * F.col("weight"))
    return chosen.select("source", "position", "source_size", target.alias("target"), "budget")


def block_starts(sums: DataFrame) -> DataFrame:
    """(source, block, before): the words of a source before each block, from (source, block, words).

    Blocks are summed up by FAN, those sums by FAN again, and so on in a third step, so no task runs
    over more than FAN rows of a source below FAN ** 3 blocks.
    """
    levels = [sums]
    for _ in range(2):
        above = levels[-1].groupBy("source", F.floor(F.col("block") / FAN).cast("long").alias("block")).agg(F.sum("words").alias("words"))
        levels.append(above)
    before = None
    for level in reversed(levels):
        up = F.floor(F.col("block") / FAN).cast("long")
        earlier = Window.partitionBy("source", up).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        own = level.select("source", "block", up.alias("up"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before"))
        if before is not None:
            own = own.join(before, F.col("source").eqNullSafe(F.col("s")) & (F.col("up") == F.col("b"))).select("source", "block", (F.col("before") + F.col("above")).alias("before"))
        before = own.select(F.col("source").alias("s"), F.col("block").alias("b"), F.col("before").alias("above"))
    return before.select(F.col("s").alias("source"), F.col("b").alias("block"), F.col("above").alias("before"))


def where_spent(timed: DataFrame, budget: int) -> tuple[float, float, int] | None:
    """The range [low, high) of finish times that the budget ends in, and the words before it; None if it never ends.

    Finish times are summed in FAN ranges, and the range that the budget ends in is cut again, until
    it has few rows or can't be cut: what comes to the driver is FAN sums at a time.
    """
    low, high = timed.agg(F.min("finish"), F.max("finish")).first()
    if low is None:
        return None
    high, spent = math.nextafter(high, math.inf), 0
    while True:
        step = (high - low) / FAN
        inside = timed.where((F.col("finish") >= low) & (F.col("finish") < high))
        # Rows lie where low + range * step says, so that the edges used later are the same.
        cut = F.least(F.floor((F.col("finish") - F.lit(low)) / F.lit(step)), F.lit(FAN - 1)).cast("int") if step > 0 else F.lit(0)
        sums = inside.groupBy(cut.alias("range")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"), F.min("finish").alias("first"), F.max("finish").alias("last")).orderBy("range").collect()
        for r in sums:
            if spent + r["words"] > budget:
                break
            spent += r["words"]
        else:
            return None
        if r["n"] <= FAN or r["first"] == r["last"]:
            return r["first"], math.nextafter(r["last"], math.inf), spent
        low, high = r["first"], math.nextafter(r["last"], math.inf)


def boundaries(sizes: DataFrame, targets: DataFrame, max_repeats: int) -> DataFrame:
    """Per source: where the mix stops in it, as (round, key, number, alike) of the last row taken.

    ``sizes`` has source, size, key. Rows alike in source and key are numbered from 1; of ``alike``
    such rows the last round takes ``number``. Documents without words have no part in this. A
    source's order is cut into blocks by key, and rows alike into parts of ALIKE, so neither a
    source nor a text meets in one task, however often it is there.
    """
    alike = sizes.where(F.col("size") > 0).groupBy("source", "key").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("alike"))
    parts = alike.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("alike") - 1) / ALIKE).cast("long"))))
    units = materialise(parts.withColumn("n", F.least(F.lit(ALIKE), F.col("alike") - F.col("part") * ALIKE).cast("int")), "mix-units")
    rows, most = units.agg(F.count(F.lit(1)), F.max("n")).first()
    blocks = max(1, rows // BLOCK_ROWS)
    # The key's first 12 digits, in hexadecimal, spread evenly over the blocks.
    units = units.withColumn("block", F.floor(F.conv(F.substring("key", 1, 12), 16, 10).cast("long") / F.lit(float(2**48)) * blocks).cast("long"))
    words = F.col("size") * F.col("n")
    starts = block_starts(units.groupBy("source", "block").agg(F.sum(words).alias("words"))).select(F.col("source").alias("s"), F.col("block").alias("b"), "before")
    inside = Window.partitionBy("source", "block").orderBy("key", "part")
    placed = (
        units.withColumn("starts", F.sum(words).over(inside) - words)
        .join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
        .withColumn("starts", F.col("before") + F.col("starts"))
        .drop("s", "b", "before")
    )
    if (most or 1) > 1:  # parts of rows alike are told apart again, each part in a task of its own choice
        placed = placed.repartition("source", "key", "part")
    placed = placed.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s").where("target > 0")
    each = placed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))).withColumn("number", F.col("part") * ALIKE + F.col("copy"))
    rounds = each.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
    finish = F.try_divide((F.col("round") * F.col("source_size") + F.col("starts") + F.col("copy") * F.col("size")).cast("double"), F.col("target"))
    timed = materialise(rounds.select("source", "position", "round", "key", "number", "alike", "size", finish.alias("finish")), "mix-times")
    # In the global order everything before one range of finish times is taken, and that range is sorted.
    budget = targets.agg(F.max("budget")).first()[0] or 0
    last = F.max(F.struct("round", "key", "number", "alike")).alias("last")
    ends = where_spent(timed, budget)
    if ends is None:
        return timed.groupBy("source").agg(last)
    low, high, spent = ends
    whole = timed.where(F.col("finish") < low).groupBy("source").agg(last)
    order = Window.orderBy("finish", "position", "round", "key", "number")
    partial = timed.where((F.col("finish") >= low) & (F.col("finish") < high)).withColumn("running", F.sum("size").over(order)).where(F.col("running") + spent <= budget).groupBy("source").agg(last)
    return whole.unionByName(partial).groupBy("source").agg(F.max("last").alias("last"))


def sizes_of(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, source, size, key, as a table of its own."""
    return materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), shuffle_key(F.col("doc_id"), F.col("text")).alias("key")), "mix-sizes")


def plan_of(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """Per source: source, source_size, target, last (struct: how far the mix takes it; null: nothing)."""
    targets = materialise(source_targets(sizes, weights, max_repeats), "mix-targets")
    ends = boundaries(sizes, targets, max_repeats).withColumnRenamed("source", "s")
    return targets.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "last")


def numbered(rows: DataFrame) -> DataFrame:
    """Adds ``number`` to the rows: 1, 2, ... within their mix_source, in any order.

    The rows are written once, and counted in the parts that they are written in; a part is what one
    task has read.
    """
    staged = materialise(rows.withColumn("locator", F.monotonically_increasing_id()), "mix-alike").withColumn("part", F.shiftright("locator", 33))
    earlier = Window.partitionBy("s").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    counts = staged.groupBy(F.col("mix_source").alias("s"), F.col("part").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("s", "p", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("mix_source", "part").orderBy("locator"))
    met = staged.withColumn("own", own).join(before, F.col("mix_source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    return met.withColumn("number", F.col("own") + F.col("before")).drop("locator", "part", "s", "p", "before", "own")


def with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds mix_plan (source_size, target, last) and copies (how often the mix takes the row) to ``rows`` (source, key, ...)."""
    by_source = plan.select(F.col("source").alias("mix_source"), F.struct("source_size", "target", "last").alias("mix_plan"))
    met = rows.join(by_source, F.col("source").eqNullSafe(F.col("mix_source")), "left")
    last = F.col("mix_plan.last")

    def copies(in_last_round: Column) -> Column:
        return F.when(last.isNull(), 0).otherwise(last["round"] + F.when(in_last_round, 1).otherwise(0))

    taken = met.withColumn("copies", copies(F.col("key") <= last["key"]))
    if not plan.where("last.number < last.alike").isEmpty():
        # The mix stops between rows that are alike, so these are numbered.
        between = F.coalesce((F.col("key") == last["key"]) & (last["number"] < last["alike"]), F.lit(False))
        stopped = numbered(met.where(between)).withColumn("copies", copies(F.col("number") <= last["number"])).drop("number")
        taken = taken.where(~between).unionByName(stopped)
    return taken.drop("mix_source")


def mix_sources(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """Per document: doc_id, size, source_size, target (of its source), taken (words the mix takes of it).

    Documents are taken whole. Null text has size 0; a null source is a source of its own; a source
    without words has target 0; rows without an id, and rows that repeat one, are documents of their
    own, and of rows alike in all that counts any may be the last one taken; an empty table gives an
    empty result.
    """
    with scratch(docs.sparkSession):
        sizes = sizes_of(docs)
        plan = materialise(plan_of(sizes, weights, max_repeats), "mix-plan")
        return keep(
            with_copies(sizes, plan).select(
                "doc_id", "size", F.col("mix_plan.source_size").alias("source_size"), F.col("mix_plan.target").alias("target"), (F.col("size") * F.col("copies")).cast("long").alias("taken")
            ),
            "mix",
        )


def draw_mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """The mix itself: the rows of ``docs`` that it takes, each as often as it takes it.

    A row with no words goes with its place in the shuffle: it is there as often as a document of its
    source at that place would be taken.
    """
    with scratch(docs.sparkSession):
        plan = keep(plan_of(sizes_of(docs), weights, max_repeats), "mix-plan")
    keys = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), "source", shuffle_key(F.col("doc_id"), F.col("text")).alias("key"))
    taken = with_copies(keys, plan).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS key
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS position FROM totals),
weighed AS (SELECT *, CAST(position % 3 + 1 AS DOUBLE) AS weight, 3 * source_size AS cap FROM ranked),
levels AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS budget,
    CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0) AS DOUBLE)
      / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM weighed WINDOW w AS (ORDER BY cap / weight, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (
  SELECT *, (SELECT arg_min(level, (cap / weight, position)) FROM levels WHERE level * weight <= cap) AS common_level
  FROM levels),
targets AS (
  SELECT source, position, source_size, budget,
    CASE WHEN common_level IS NULL OR common_level * weight >= cap THEN CAST(cap AS DOUBLE) ELSE common_level * weight END AS target
  FROM chosen),
units AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source, key) AS number FROM sized),
ended AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, number ROWS UNBOUNDED PRECEDING) AS ends
  FROM units WHERE size > 0),
timed AS (
  SELECT u.*, r.round, t.position, t.budget,
    CAST(r.round * t.source_size + u.ends AS DOUBLE) / t.target AS finish
  FROM ended u JOIN targets t ON u.source IS NOT DISTINCT FROM t.source, (VALUES (0), (1), (2)) r(round)
  WHERE t.target > 0),
running AS (
  SELECT *, sum(size) OVER (ORDER BY finish, position, round, key, number ROWS UNBOUNDED PRECEDING) AS spent
  FROM timed),
copies AS (SELECT source, key, number, count(*) AS n FROM running WHERE spent <= budget GROUP BY ALL)
SELECT s.doc_id, CAST(s.size AS BIGINT) AS size, t.source_size, t.target, CAST(s.size * coalesce(c.n, 0) AS BIGINT) AS taken
FROM units s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
LEFT JOIN copies c ON s.source IS NOT DISTINCT FROM c.source AND s.key = c.key AND s.number = c.number
"""
