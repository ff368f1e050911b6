"""Histograms over grids, and what is read off them. Grids stay in long form: one row per non-empty cell."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binning import bin_index, cell_of, centre_of, contains_grid
from ..functions.predicates import in_world, lenient_double

KM_PER_DEGREE = 111.0


def valid_points(points: DataFrame) -> DataFrame:
    """Points whose lon and lat are numbers, or texts that are, within the world."""
    kinds = dict(points.dtypes)
    within = in_world(F.col("lon"), F.col("lat"))
    if all(kinds[c] == "double" for c in ("lon", "lat")):
        return points.where(within)
    # A filter that asks for the partition isn't moved before the numbers are made of texts, which happens once then.
    numbers = points.withColumns({c: lenient_double(F.col(c)) for c in ("lon", "lat")} | {"_partition": F.spark_partition_id()})
    return numbers.where(within & (F.col("_partition") >= 0)).drop("_partition")


#: Bits of a resolution and of a cell's numbers in the one number that stands for a cell while points are counted.
CELL_BITS = 20


def _packed(resolution: int, x: Column, y: Column) -> Column:
    return F.lit(resolution << 2 * CELL_BITS) + F.shiftleft(x.cast("long"), CELL_BITS) + y.cast("long")


def _unpacked(cells: DataFrame) -> DataFrame:
    part = lambda k: F.shiftright("cell", k * CELL_BITS).bitwiseAND(F.lit((1 << CELL_BITS) - 1)).cast("int")
    return cells.select(part(2).alias("res"), part(1).alias("x"), part(0).alias("y"), "cnt")


def _and_coarser(base: int, others: list[int]) -> Column:
    """A cell of ``base`` and the cells of the coarser grids around it."""
    around = [_packed(r, F.floor(F.col("x") / (base // r)), F.floor(F.col("y") / (base // r))) for r in others]
    return F.array(_packed(base, F.col("x"), F.col("y")), *around)


def bases(resolutions: Iterable[int]) -> dict[int, list[int]]:
    """The resolutions that no finer one contains, each with the coarser ones whose cells are made of its own."""
    within: dict[int, list[int]] = {}
    for r in sorted(set(resolutions), reverse=True):
        finer = next((b for b in within if contains_grid(b, r)), None)
        if finer is None:
            within[r] = []
        else:
            within[finer].append(r)
    return within


def cell_counts(points: DataFrame, resolutions: Iterable[int]) -> DataFrame:
    """(res, x, y, cnt) of every non-empty cell, with every point put into a cell of every resolution.

    Cells are counted by one long, for which Spark's generated code has a hash table of its own; more
    than 65,536 different cells a task fit in it with a larger
    ``spark.sql.codegen.aggregate.fastHashMap.capacityBit``.
    """
    wanted = list(resolutions)
    if any(not 1 < r < 1 << CELL_BITS for r in wanted):
        raise ValueError(f"resolutions must lie between 2 and {(1 << CELL_BITS) - 1}")
    cells = [_packed(r, *cell_of(F.col("lon"), F.col("lat"), r)) for r in wanted]
    each = valid_points(points).select((cells[0] if len(cells) == 1 else F.explode(F.array(*cells))).alias("cell"))
    return _unpacked(each.groupBy("cell").agg(F.count(F.lit(1)).alias("cnt")))


def with_coarser(counts: DataFrame, within: dict[int, list[int]]) -> DataFrame:
    """Counts of the ``bases`` with those of the coarser grids that they contain."""
    if not any(within.values()):
        return counts
    around = None
    for base, others in within.items():
        cells = _and_coarser(base, others)
        around = F.when(F.col("res") == base, cells) if around is None else around.when(F.col("res") == base, cells)
    spread = counts.select(F.explode(around).alias("cell"), "cnt")
    return _unpacked(spread.groupBy("cell").agg(F.sum("cnt").alias("cnt")))


def histogram(points: DataFrame, resolutions: Iterable[int]) -> DataFrame:
    """(res, x, y, cnt) of every non-empty cell at every resolution, in one scan; repeated resolutions count once.

    Points are put into cells only at resolutions that no finer one contains; where all edges of a
    coarser grid are edges of a finer one, its counts are summed from the finer cells. All counts are
    partial before their shuffle. Streams, where sums of counts can't be kept up to date, put every
    point into a cell of every resolution (but see ``streaming.grids``).
    """
    if points.isStreaming:
        return cell_counts(points, sorted(set(resolutions), reverse=True))
    within = bases(resolutions)
    return with_coarser(cell_counts(points, within), within)


def summary(grid: DataFrame) -> DataFrame:
    """Per resolution: cells, max_cnt, sum_cnt."""
    return grid.groupBy("res").agg(F.count(F.lit(1)).alias("cells"), F.coalesce(F.max("cnt"), F.lit(0)).alias("max_cnt"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("sum_cnt"))


def point_counts(points: DataFrame) -> DataFrame:
    """One row: all points, and the valid ones."""
    kinds = dict(points.dtypes)
    lon, lat = (F.col(c) if kinds[c] == "double" else lenient_double(F.col(c)) for c in ("lon", "lat"))
    return points.agg(F.count(F.lit(1)).alias("points"), F.count_if(F.coalesce(in_world(lon, lat), F.lit(False))).alias("valid"))


def top_cells(grid: DataFrame, n: int, finest: int | None = None) -> DataFrame:
    """The ``n`` fullest cells of the finest resolution, with their centres; ties to the larger x, then y.

    Where ``finest`` isn't given, it is looked up in the grid, which should be a table then.
    """
    finest = grid.agg(F.max("res")).first()[0] if finest is None else finest
    top = grid.where(F.col("res") == F.lit(finest)).orderBy(F.desc("cnt"), F.desc("x"), F.desc("y")).limit(n)
    lon, lat = centre_of(F.col("x"), F.col("y"), finest or 2)
    return top.select("x", "y", "cnt", lon.alias("lon"), lat.alias("lat"))


def peaks(grid: DataFrame, n: int = 10, apart: float = 1.0, finest: int | None = None) -> DataFrame:
    """(rank, lat, lon, cnt): the fullest cells, none within ``apart`` degrees, on both axes, of a fuller one.

    Only the 3 * n fullest cells are looked at, as one short array, so fewer than n may be found.
    """
    found = top_cells(grid, 3 * n, finest)
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("cnt")).alias("o1"), (-F.col("x")).alias("o2"), (-F.col("y")).alias("o3"), "lat", "lon", "cnt")))
    kind = "array<struct<lat:double,lon:double,cnt:bigint>>"

    def keep(kept: Column, p: Column) -> Column:
        near = F.exists(kept, lambda k: (F.abs(k["lat"] - p["lat"]) < apart) & (F.abs(k["lon"] - p["lon"]) < apart))
        return F.when((F.size(kept) >= n) | near, kept).otherwise(F.concat(kept, F.array(F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"), p["cnt"].alias("cnt")))))

    kept = found.agg(F.aggregate(ordered, F.array().cast(kind), keep).alias("kept"))
    return kept.select(F.posexplode("kept").alias("k", "p")).select((F.col("k") + 1).alias("rank"), "p.lat", "p.lon", F.col("p.cnt").alias("cnt"))


def local_boxes(centres: DataFrame, radius_km: float = 50.0) -> DataFrame:
    """The box of ``radius_km`` around each centre (rank, lat, lon)."""
    dlat, dlon = F.lit(radius_km / KM_PER_DEGREE), F.lit(radius_km) / (F.lit(KM_PER_DEGREE) * F.cos(F.radians("lat")))
    return centres.select(
        "rank", F.col("lat").alias("centre_lat"), F.col("lon").alias("centre_lon"), (F.col("lat") - dlat).alias("lat_min"), (F.col("lat") + dlat).alias("lat_max"), (F.col("lon") - dlon).alias("lon_min"), (F.col("lon") + dlon).alias("lon_max")
    )


#: Cells that cover a box, on each axis, at least; at most twice as many and one.
COVER = 2
#: Cell sizes that are used: from 128 degrees down to some 2 metres, by halves.
COARSEST, FINEST = -7, 16


def points_in_boxes(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Points with every box (rank, lat_min, lat_max, lon_min, lon_max, ...) that they lie in.

    A box is covered by a few cells of a size that fits it, and points meet the boxes of their own
    cells, then their exact bounds. So many boxes cost no more comparisons than those of one place.
    """
    side = F.greatest(F.col("lon_max") - F.col("lon_min"), F.col("lat_max") - F.col("lat_min"))
    fits = F.floor(F.log2(F.lit(float(COVER)) / F.greatest(side, F.lit(1e-9)))).cast("int")
    sized = boxes.withColumn("_level", F.least(F.greatest(fits, F.lit(COARSEST)), F.lit(FINEST)))
    cell = lambda c, level: F.floor(F.col(c) * F.pow(F.lit(2.0), level)).cast("long")
    span = lambda c: F.explode(F.sequence(cell(f"{c}_min", F.col("_level")), cell(f"{c}_max", F.col("_level"))))
    covers = sized.where("lon_min <= lon_max AND lat_min <= lat_max").withColumn("_cx", span("lon")).withColumn("_cy", span("lat"))
    levels = sorted(r["_level"] for r in sized.select("_level").distinct().collect() if r["_level"] is not None)  # FINEST - COARSEST + 1 at most
    each = valid_points(points).select("lat", "lon", F.explode(F.array(*[F.lit(k) for k in levels]).cast("array<int>")).alias("_level"))
    placed = each.withColumn("_cx", cell("lon", F.col("_level"))).withColumn("_cy", cell("lat", F.col("_level")))
    inside = F.col("lat").between(F.col("lat_min"), F.col("lat_max")) & F.col("lon").between(F.col("lon_min"), F.col("lon_max"))
    return placed.join(covers, ["_level", "_cx", "_cy"]).where(inside).drop("_level", "_cx", "_cy")


def local_histograms(points: DataFrame, boxes: DataFrame, resolution: int = 200) -> DataFrame:
    """(rank, x, y, cnt) of the grid of ``resolution`` cells a side in every box, in one scan of the points."""
    single = {c: F.col(c).cast("float").cast("double") for c in ("lon_min", "lon_max", "lat_min", "lat_max")}
    near = points_in_boxes(points, boxes).where(F.col("lon").between(single["lon_min"], single["lon_max"]) & F.col("lat").between(single["lat_min"], single["lat_max"]))
    x = bin_index(F.col("lon"), F.col("lon_min"), F.col("lon_max"), resolution)
    y = bin_index(F.col("lat"), F.col("lat_min"), F.col("lat_max"), resolution)
    return near.groupBy("rank", x.alias("x"), y.alias("y")).agg(F.count(F.lit(1)).alias("cnt"))


def local_summaries(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Per box: rank, total_points, also where that is 0."""
    counts = points_in_boxes(points, boxes).groupBy("rank").agg(F.count(F.lit(1)).alias("n"))
    return boxes.join(counts, "rank", "left").select("rank", "lat_min", "lat_max", "lon_min", "lon_max", F.coalesce("n", F.lit(0)).alias("total_points"))


def sparse_payload(grid: DataFrame) -> DataFrame:
    """Per resolution the grid as a report holds it: shape, indices and values (in x, then y order), max and sum.

    One row holds one resolution's non-empty cells; a report's grids are bounded by their resolution.
    """
    cells = F.sort_array(F.collect_list(F.struct("x", "y", "cnt")))
    packed = grid.where("cnt > 0").groupBy("res").agg(cells.alias("cells"), F.max("cnt").cast("double").alias("max"), F.sum("cnt").cast("double").alias("sum"))
    return packed.select(
        "res", F.array("res", F.floor(F.col("res") / 2).cast("int")).alias("shape"), F.transform("cells", lambda c: F.array(c["x"], c["y"])).alias("indices"), F.transform("cells", lambda c: c["cnt"].cast("float")).alias("values"), "max", "sum"
    )


#: Cells of a tile on each axis.
TILE = 256


def payload_tiles(grid: DataFrame, side: int | None = None) -> DataFrame:
    """(res, tx, ty, steps, values): the grids in tiles of ``side`` cells on each axis, one row a tile that isn't empty.

    A tile's cells are numbered column by column, (x - tx * side) * side + (y - ty * side); ``steps`` are
    the differences between the numbers of cells that aren't empty, the first one from 0, and
    ``values`` their counts. So a row is as large as a tile, whatever the resolution.
    """
    side = TILE if side is None else side
    tile = lambda c: F.floor(F.col(c) / side).cast("int")
    place = (F.col("x") - F.col("tx") * side) * side + F.col("y") - F.col("ty") * side
    placed = grid.where("cnt > 0").withColumns({"tx": tile("x"), "ty": tile("y")}).select("res", "tx", "ty", F.struct(place.cast("int").alias("place"), "cnt").alias("c"))
    cells = placed.groupBy("res", "tx", "ty").agg(F.sort_array(F.collect_list("c")).alias("cells"))
    steps = F.transform("cells", lambda c, k: c["place"] - F.when(k == 0, 0).otherwise(F.get("cells.place", k - 1)))
    return cells.select("res", "tx", "ty", steps.alias("steps"), F.col("cells.cnt").alias("values"))


def nearest_resolution(grid: DataFrame, wanted: int) -> DataFrame:
    """The resolution at hand that is nearest to the wanted one, the lower of two."""
    return grid.select("res").distinct().orderBy(F.abs(F.col("res") - wanted), "res").limit(1)
