"""Systematic samples, and running numbers that no single task works out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import written

#: Values of the order column that one running count covers.
SPAN = 65_536


def running_number(rows: DataFrame, by: list[str], order: str, span: int = SPAN) -> DataFrame:
    """Adds ``number``, from 1, of every row among those with the same ``by``, by the whole number ``order``.

    The order is cut into spans: rows are numbered within their span, and span counts, which are
    partial before their shuffle, say where each span begins. So neither a frequent key nor the whole
    table meets in one task. Rows with equal keys and order share no defined sequence.
    """
    cut = rows.withColumn("_span", F.floor(F.col(order) / span))
    counts = cut.groupBy(*by, "_span").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n").select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_span").alias("_s"), "_before")
    same = F.col("_span").eqNullSafe(F.col("_s"))
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    within = F.row_number().over(Window.partitionBy(*by, "_span").orderBy(order))
    return cut.withColumn("_within", within).join(starts, same).withColumn("number", F.col("_before") + F.col("_within")).drop("_span", "_within", "_s", "_before", *[f"_k{i}" for i in range(len(by))])


def every_nth(rows: DataFrame, n: int, order: str, by: list[str] | None = None, span: int = SPAN) -> DataFrame:
    """The nth, 2nth, ... row, of all or per key."""
    if n < 1:
        raise ValueError("n must be 1 or more")
    return running_number(rows, by or [], order, span).where(F.col("number") % n == 0).drop("number")


def fraction(rows: DataFrame, share: float, seed: int = 42, key: str | None = None) -> DataFrame:
    """A random share of the rows, without replacement.

    With a ``key``, a hash of it decides: the same rows on every run, however the rows are dealt.
    """
    if key is None:
        return rows.sample(False, share, seed)
    number = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")
    return rows.where(number < int(share * 2**32))


#: Bits of a hash that one count of ranges tells apart, and rows of a range that are put in order.
RANGE_BITS, RANGE_ROWS = 10, 4_096
#: Bits of the hash that rows are drawn by.
HASH_BITS = 60


def draw_number(key: Column, seed: int) -> Column:
    """A number of HASH_BITS bits that stands for the key: the first 15 hexadecimal digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, HASH_BITS // 4), 16, 10).cast("long")


def exact_fraction(rows: DataFrame, share: float, key: str, by: list[str] | None = None, seed: int = 42) -> DataFrame:
    """Exactly floor(share * n) of the n rows of every stratum ``by``, or of all: those whose keys' hashes are smallest.

    Where the last of them lies is found by counting ranges of hashes, ever smaller ones, per stratum;
    only the rows of the last range, which are few, are put in order. So no stratum, however large,
    meets in one task, and the same rows come on every run. Rows with equal keys are told apart by
    their other columns; of equal rows any are the same.
    """
    by = by or []
    strata = [f"_s{k}" for k in range(len(by))]
    marked = rows.withColumns({s: F.col(c) for s, c in zip(strata, by, strict=True)} | {"_h": F.coalesce(draw_number(F.col(key), seed), F.lit((1 << HASH_BITS) - 1))})
    # Per stratum: how many are wanted, of them how many in the range that is still open, and where that begins.
    open_ = written(marked.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n")).select(*strata, F.floor(F.col("_n") * F.lit(share)).cast("long").alias("_k"), F.lit(0).cast("long").alias("_low"), "_n"), "strata")
    width = HASH_BITS
    while width > 0 and (open_.agg(F.max(F.when(F.col("_k") > 0, F.col("_n")))).first()[0] or 0) > RANGE_ROWS:
        width = max(width - RANGE_BITS, 0)
        near = _beside(marked, open_.where("_k > 0"), strata).where(F.shiftright(F.col("_h"), width + RANGE_BITS) == F.shiftright(F.col("_low"), width + RANGE_BITS))
        counts = near.groupBy(*strata, (F.shiftright(F.col("_h"), width)).alias("_r")).agg(F.count(F.lit(1)).alias("_c"), F.first("_k").alias("_k"))
        before = Window.partitionBy(*strata).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
        last = counts.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))).where((F.col("_before") < F.col("_k")) & (F.col("_k") <= F.col("_before") + F.col("_c")))
        open_ = written(last.select(*strata, (F.col("_k") - F.col("_before")).alias("_k"), F.shiftleft(F.col("_r"), width).alias("_low"), F.col("_c").alias("_n")), "strata")
    placed = _beside(marked, open_.where("_k > 0"), strata)
    step = 1 << width
    sure = placed.where(F.col("_h") < F.col("_low")).select(*rows.columns)
    order = Window.partitionBy(*strata).orderBy("_h", key, F.xxhash64(*rows.columns))
    edge = placed.where((F.col("_h") >= F.col("_low")) & (F.col("_h") < F.col("_low") + step)).withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= F.col("_k"))
    return sure.unionByName(edge.select(*rows.columns))


def _beside(rows: DataFrame, strata: DataFrame, keys: list[str]) -> DataFrame:
    if not keys:
        one = strata.first()
        return rows.where(F.lit(False)).withColumns({"_k": F.lit(0), "_low": F.lit(0)}) if one is None else rows.withColumns({"_k": F.lit(one["_k"]), "_low": F.lit(one["_low"])})
    named = strata.select(*[F.col(k).alias(f"_of{k}") for k in keys], "_k", "_low")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of{k}"))
    return rows.join(named, same).drop(*[f"_of{k}" for k in keys])


def chunks(rows: DataFrame, order: str, size: int = 500_000, span: int = SPAN) -> DataFrame:
    """Adds ``chunk``, from 0: rows in runs of ``size`` by the whole number ``order``."""
    return running_number(rows, [], order, span).withColumn("chunk", F.floor((F.col("number") - 1) / size)).drop("number")


def by_modulus(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The rows whose key is divisible by ``n``: a sample that every engine repeats."""
    return rows.where(F.col(key) % n == 0)


def with_alias(rows: DataFrame, aliases: DataFrame, name: str = "name", unwanted: str | None = None) -> DataFrame:
    """Names replaced by their alias (alias table: name, alias) where there is one; ``unwanted`` characters go."""
    known = aliases.select(F.col("name").alias("_alias_of"), F.col("alias").alias("_alias"))
    named = rows.join(known, F.col(name) == F.col("_alias_of"), "left").withColumn(name, F.coalesce("_alias", name)).drop("_alias_of", "_alias")
    return named if unwanted is None else named.withColumn(name, F.regexp_replace(name, unwanted, ""))


def name_counts(rows: DataFrame, name: str = "name") -> DataFrame:
    return rows.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
