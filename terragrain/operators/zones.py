"""Points in polygons by the even-odd rule, as an equality join on cells; boundary lines; zones of states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import SKIPPED_FIPS, computed, pad_fips
from ..sources.folders import written
from .zone_cells import cell_index, locate


def edges(rings: DataFrame) -> DataFrame:
    """(zone, x1, y1, x2, y2) of every edge, from (zone, ring, points: array of [lon, lat]).

    Rings are closed where they aren't. Holes are rings too. Edges that two areas of a zone share
    cancel, so a zone made of several areas needs no union first.
    """
    pairs = F.transform("points", lambda p, i: F.struct(p[0].alias("x1"), p[1].alias("y1"), F.get(F.get("points", (i + 1) % F.size("points")), F.lit(0)).alias("x2"), F.get(F.get("points", (i + 1) % F.size("points")), F.lit(1)).alias("y2")))
    return rings.select("zone", F.explode(pairs).alias("e")).select("zone", "e.*").where("x1 <> x2 OR y1 <> y2")


#: Bands to a degree of latitude: where cells don't tell, a position is held against the edges of its band.
BANDS = 8


def by_bands(places: DataFrame, zone_edges: DataFrame) -> DataFrame:
    """(lon, lat, zone, n): those of the distinct ``places`` (lon, lat, n) that are in a zone, by all edges of their latitude.

    A ray to the east meets an edge only in the edge's latitude bands, so position and edge are joined
    by band. The positions of a band are dealt in parts, so that many tasks share a busy band, and its
    edges, which are few, go to each of them.
    """
    parts = 1 + int(places.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 100
    banded = places.select("lon", "lat", "n", F.floor(F.col("lat") * BANDS).cast("int").alias("band"), F.pmod(F.xxhash64("lon", "lat"), F.lit(parts)).cast("int").alias("part"))
    bands = zone_edges.where("y1 <> y2").withColumn("band", F.explode(F.sequence(F.floor(F.least("y1", "y2") * BANDS).cast("int"), F.floor(F.greatest("y1", "y2") * BANDS).cast("int"))))
    bands = bands.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    crosses = ((F.col("y1") > F.col("lat")) != (F.col("y2") > F.col("lat"))) & (F.col("lon") < (F.col("x2") - F.col("x1")) * F.try_divide(F.col("lat") - F.col("y1"), F.col("y2") - F.col("y1")) + F.col("x1"))
    met = banded.join(bands, ["band", "part"]).where(crosses)
    return met.groupBy("lon", "lat", "zone").agg(F.count(F.lit(1)).alias("crossings"), F.first("n").alias("n")).where("crossings % 2 = 1").select("lon", "lat", "zone", "n")


def points_in_zones(points: DataFrame, zone_edges: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(lon, lat, zone, n): every distinct position in every zone that holds it, and how many points are there.

    Equal positions are counted first, then located by the zones' cells (``index``, which is made of
    the edges where it isn't given). The edges' bounding box is a plain filter, which reaches the scan.
    """
    index = cell_index(zone_edges) if index is None else index
    west, east, south, north = zone_edges.agg(F.min(F.least("x1", "x2")), F.max(F.greatest("x1", "x2")), F.min(F.least("y1", "y2")), F.max(F.greatest("y1", "y2"))).first()
    near = F.col("lon").between(west, east) & F.col("lat").between(south, north)
    located = written(locate(points.where(near).groupBy("lon", "lat").agg(F.count(F.lit(1)).alias("n")), index), "located")
    unsure = located.where("NOT sure").select("lon", "lat", "n", "zone")
    if unsure.isEmpty():
        return located.select("lon", "lat", "zone", "n")
    settled = by_bands(unsure.select("lon", "lat", "n").distinct(), zone_edges).join(unsure.select("lon", "lat", "zone"), ["lon", "lat", "zone"], "left_semi")
    return located.where("sure").select("lon", "lat", "zone", "n").unionByName(settled.select("lon", "lat", "zone", "n"))


def zone_counts(points: DataFrame, zone_edges: DataFrame) -> DataFrame:
    """(zone, points) of every zone that holds a point."""
    return points_in_zones(points, zone_edges).groupBy("zone").agg(F.sum("n").alias("points"))


def with_states(counts: DataFrame, states: DataFrame) -> DataFrame:
    """Counts by FIPS zone with the states' names and centres, fullest first; ties keep the states' order."""
    named = counts.join(F.broadcast(states), counts["zone"] == states["fip"]).where(~F.col("fip").isin(*SKIPPED_FIPS))
    return named.select("fip", "name", "abbrev", "points", "lat", "lon").orderBy(F.desc("points"), "fip")


def decimate(rings: DataFrame, factor: int) -> DataFrame:
    """Boundary lines: every len // factor-th point, single precision; short rings go.

    Points and line are worked out once a ring: a copy of what the points are made of, inside the
    function that looks at every point, would take time with the square of their number.
    """
    step = F.greatest(F.lit(1), F.floor(F.size("points") / factor).cast("int"))
    usable = computed(computed(rings, points=F.col("points")).where(F.size("points") >= 4), step=step)
    # Beyond two steps, a third point is kept.
    kept = usable.where(F.size("points") > 2 * F.col("step"))
    line = F.when(F.col("step") == 1, F.col("points")).otherwise(F.filter("points", lambda p, i: i % F.col("step") == 0))
    return computed(kept, line=line.cast("array<array<float>>")).drop("step", "points")


def boundary_lines(rings: DataFrame, factor: int, fips: str | None = None) -> DataFrame:
    """Shapefile rings (kind, points, attributes) as decimated lines.

    Only polygons count; where ``fips`` names the attribute with the state code, the codes outside the
    contiguous states are skipped.
    """
    polygons = rings.where(F.col("kind").isin(5, 15))
    if fips is not None:
        polygons = polygons.where(~F.coalesce(F.col("attributes")[fips], F.lit("")).isin(*SKIPPED_FIPS))
    return decimate(polygons, factor)


def zone_rings(rings: DataFrame, fips: str, states: DataFrame) -> DataFrame:
    """County rings as rings of their states (zone, ring, points): padded codes that the states' table has."""
    zone = pad_fips(F.col("attributes")[fips])
    coded = rings.where(F.col("kind").isin(5, 15)).select(zone.alias("zone"), "ring", "points").where(~F.col("zone").isin(*SKIPPED_FIPS))
    return coded.join(F.broadcast(states.select(F.col("fip").alias("zone"))), "zone", "left_semi")
