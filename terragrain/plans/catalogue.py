"""The geographic queries over the driver's tables, each with its SQL.

The tables carry no coordinates, so every query starts from one derived view ``points`` over events.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import display, pathquery, predicates
from ..functions.binning import bin_sql
from ..operators import density, dissolve, mesh, sampling, smooth, zones
from ..sources import features, report
from ..sources.folders import fresh_path
from ..sources.states import state_rows, states
from ..streaming import grids, streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _as_points(events: DataFrame) -> DataFrame:
    user, event = F.col("user_id"), F.col("event_id")
    return events.select(
        event.alias("seq"), F.concat(F.lit("user_"), user.cast("string")).alias("name"), F.col("event_type").alias("activity"), F.get_json_object("props", "$.k").cast("double").alias("accuracy"), F.col("value").alias("speed"), F.col("ts").alias("time"),
        (((user % 15) * 24).cast("double") - F.lit(170.0) + (event % 41).cast("double") * F.lit(0.0625)).alias("lon"),
        (((user % 10) * 14).cast("double") - F.lit(65.0) + ((event * 7) % 37).cast("double") * F.lit(0.0625)).alias("lat"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_points(_events(spark, sf_dir))


POINTS = """points AS (
  SELECT event_id AS seq, 'user_' || CAST(user_id AS VARCHAR) AS name, event_type AS activity,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) AS accuracy, value AS speed, ts AS time,
    CAST((user_id % 15) * 24 AS DOUBLE) - CAST(170 AS DOUBLE) + CAST(event_id % 41 AS DOUBLE) * CAST(0.0625 AS DOUBLE) AS lon,
    CAST((user_id % 10) * 14 AS DOUBLE) - CAST(65 AS DOUBLE) + CAST((event_id * 7) % 37 AS DOUBLE) * CAST(0.0625 AS DOUBLE) AS lat
  FROM events)"""

RESOLUTIONS = (180, 360, 720)
FINEST = 720


def _grid_sql(r: int) -> str:
    return f"SELECT {r} AS res, {bin_sql('lon', '-180', '180', r)} AS x, {bin_sql('lat', '-90', '90', r // 2)} AS y, count(*) AS cnt FROM points GROUP BY ALL"


GRID = POINTS + ",\ngrid AS (" + " UNION ALL ".join(_grid_sql(r) for r in RESOLUTIONS) + ")"
CENTRE = f"(x + CAST(0.5 AS DOUBLE)) / {FINEST} * 360 - 180 AS lon, (y + CAST(0.5 AS DOUBLE)) / {FINEST // 2} * 180 - 90 AS lat"


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.histogram(points(spark, sf_dir), RESOLUTIONS)


# Points and filters

WITH_TEXT = """texts AS (
  SELECT seq, CASE seq % 7 WHEN 0 THEN 'abc' WHEN 1 THEN '' WHEN 2 THEN 'inf' WHEN 3 THEN '1d' WHEN 4 THEN ' 12.5 ' WHEN 5 THEN '91' ELSE '1e1' END AS lat, CASE seq % 2 WHEN 0 THEN '-180' ELSE '180.5' END AS lon
  FROM points)"""


@query("valid_points", f"WITH {POINTS},\n{WITH_TEXT}\nSELECT seq, CAST(trim(lon) AS DOUBLE) AS lon, CAST(trim(lat) AS DOUBLE) AS lat FROM texts WHERE seq % 7 IN (4, 6) AND seq % 2 = 0")
def valid_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    seven = F.col("seq") % 7
    texts = F.when(seven == 0, "abc").when(seven == 1, "").when(seven == 2, "inf").when(seven == 3, "1d").when(seven == 4, " 12.5 ").when(seven == 5, "91").otherwise("1e1")
    rows = points(spark, sf_dir).select("seq", texts.alias("lat"), F.when(F.col("seq") % 2 == 0, "-180").otherwise("180.5").alias("lon"))
    return density.valid_points(rows).select("seq", "lon", "lat")


@query("world_range_filter", f"WITH {POINTS} SELECT seq, lon * 1.1 AS lon, lat * 1.5 AS lat FROM points WHERE lon * 1.1 BETWEEN -180 AND 180 AND lat * 1.5 BETWEEN -90 AND 90".replace("1.1", "CAST(1.1 AS DOUBLE)").replace("1.5", "CAST(1.5 AS DOUBLE)"))
def world_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).select("seq", (F.col("lon") * F.lit(1.1)).alias("lon"), (F.col("lat") * F.lit(1.5)).alias("lat"))
    return rows.where(predicates.in_world(F.col("lon"), F.col("lat")))


@query("us_box_filter", f"WITH {POINTS} SELECT seq, lon, lat FROM points WHERE lon BETWEEN -125 AND -66 AND lat BETWEEN 24 AND 50")
def us_box_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).where(predicates.in_box(F.col("lon"), F.col("lat"), predicates.US_BOX)).select("seq", "lon", "lat")


@query("point_counts", f"WITH {POINTS} SELECT count(*) AS points, count(*) FILTER (lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90) AS valid FROM points")
def point_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.point_counts(points(spark, sf_dir))


@query("accuracy_filter", f"WITH {POINTS} SELECT seq, accuracy FROM points WHERE accuracy > 0 AND accuracy < 50")
def accuracy_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).where(predicates.passes_accuracy(F.col("accuracy"), 50)).select("seq", "accuracy")


@query("activity_filter", "SELECT event_id AS seq, CASE WHEN event_type = 'click' THEN 'Unknown' WHEN event_type = 'view' THEN '' ELSE event_type END AS activity FROM events WHERE event_type NOT IN ('click', 'view')")
def activity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    renamed = F.when(F.col("activity") == "click", "Unknown").when(F.col("activity") == "view", "").otherwise(F.col("activity"))
    return points(spark, sf_dir).select("seq", renamed.alias("activity")).where(predicates.valid_activity(F.col("activity")))


@query("name_allow_list", f"WITH {POINTS} SELECT seq, name FROM points WHERE name IN ('user_1', 'user_2', 'user_30')")
def name_allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).where(predicates.passes_name(F.col("name"), ["user_1", "user_2", "user_30"])).select("seq", "name")


@query("name_counts", f"WITH {POINTS} SELECT name, count(*) AS n FROM points WHERE accuracy > 0 AND accuracy < 50 GROUP BY name")
def name_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.name_counts(points(spark, sf_dir).where(predicates.passes_accuracy(F.col("accuracy"), 50)))


@query("alias_lookup", f"WITH {POINTS} SELECT seq, CASE name WHEN 'user_1' THEN 'juniper' WHEN 'user_2' THEN 'mo' ELSE replace(name, '_', '') END AS name FROM points")
def alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = spark.createDataFrame([("user_1", "juniper"), ("user_2", "mo")], "name string, alias string")
    return sampling.with_alias(points(spark, sf_dir), aliases, unwanted="_").select("seq", "name")


# Path queries

_LINES = {
    "match_all": (["#(k<50)", "#(k>=10)"], [], [], "k < 50 AND k >= 10"),
    "match_any": ([], ["#(k==3)", '#[k="x"]', "#(k>90)"], [], "k = 3 OR k = 0 OR k > 90"),
    "match_none": ([], [], ["#(k<50)", "#(missing!=1)"], "NOT k < 50"),
    "match_patterns": (["#(?<70)", "#(*<60)"], ["#(k*>40)", "#(q?=1)"], ["#(k.#(>1))"], "k < 60 AND k > 40"),
    "match_combined": (["#(k)"], ["#(k<20)", "#(k>80)"], ["#(k=15)"], "(k < 20 OR k > 80) AND k <> 15"),
}


def _path_query(name: str, all_of: list[str], any_of: list[str], none_of: list[str], where: str) -> None:
    @query(name, f"SELECT event_id, props FROM (SELECT event_id, props, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) WHERE {where}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        line = F.col("props")
        passes = pathquery.match_all(line, all_of) & pathquery.match_any(line, any_of) & pathquery.match_none(line, none_of)
        return _events(spark, sf_dir).where(passes).select("event_id", "props")


for _name, _spec in _LINES.items():
    _path_query(_name, *_spec)


@query("rejection_reason", "SELECT CASE WHEN NOT k < 50 THEN 'match-all' WHEN NOT k > 10 THEN 'match-any' WHEN k = 15 THEN 'match-none' END AS reason, count(*) AS n FROM (SELECT CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) GROUP BY 1")
def rejection_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = pathquery.rejection(F.col("props"), ["#(k<50)"], ["#(k>10)"], ["#(k=15)"])
    return _events(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


# Histograms


def _single(r: int) -> None:
    @query(f"grid_histogram_r{r}", f"WITH {POINTS} {_grid_sql(r)}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return density.histogram(points(spark, sf_dir), [r])


for _r in (180, 250, 360, 720, 8640):
    _single(_r)


@query("multi_resolution_histogram", f"WITH {GRID} SELECT * FROM grid")
def multi_resolution_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir)


@query("histogram_summary", f"WITH {GRID} SELECT res, count(*) AS cells, max(cnt) AS max_cnt, CAST(sum(cnt) AS BIGINT) AS sum_cnt FROM grid GROUP BY res")
def histogram_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.summary(grid(spark, sf_dir))


@query("top_cells", f"WITH {GRID} SELECT x, y, cnt, {CENTRE} FROM grid WHERE res = {FINEST} ORDER BY cnt DESC, x DESC, y DESC LIMIT 30")
def top_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.top_cells(density.histogram(points(spark, sf_dir), [FINEST]), 30, FINEST)


PEAKS = f""",
cand AS (SELECT *, row_number() OVER (ORDER BY cnt DESC, x DESC, y DESC) AS rn FROM (
  SELECT x, y, cnt, {CENTRE} FROM grid WHERE res = {FINEST} ORDER BY cnt DESC, x DESC, y DESC LIMIT 30)),
walk AS (
  SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(lat DOUBLE, lon DOUBLE, cnt BIGINT)[]) AS kept
  UNION ALL
  SELECT c.rn, CASE WHEN len(w.kept) >= 10 OR len(list_filter(w.kept, lambda k: abs(k.lat - c.lat) < 1 AND abs(k.lon - c.lon) < 1)) > 0
    THEN w.kept ELSE list_append(w.kept, {{'lat': c.lat, 'lon': c.lon, 'cnt': c.cnt}}) END
  FROM walk w JOIN cand c ON c.rn = w.rn + 1),
done AS (SELECT kept FROM walk ORDER BY rn DESC LIMIT 1),
peaks AS (SELECT CAST(i AS INTEGER) AS rank, kept[i].lat AS lat, kept[i].lon AS lon, kept[i].cnt AS cnt FROM (SELECT kept, unnest(range(1, len(kept) + 1)) AS i FROM done))"""
BOXES = """,
boxes AS (SELECT rank, lat AS centre_lat, lon AS centre_lon,
  lat - CAST(50 AS DOUBLE) / 111 AS lat_min, lat + CAST(50 AS DOUBLE) / 111 AS lat_max,
  lon - CAST(50 AS DOUBLE) / (111 * cos(radians(lat))) AS lon_min, lon + CAST(50 AS DOUBLE) / (111 * cos(radians(lat))) AS lon_max FROM peaks)"""


@query("peak_locations", f"WITH RECURSIVE {GRID}{PEAKS} SELECT rank, lat, lon, cnt FROM peaks")
def peak_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.peaks(density.histogram(points(spark, sf_dir), [FINEST]), finest=FINEST)


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.local_boxes(peak_locations(spark, sf_dir))


_SINGLE = "CAST(CAST({} AS FLOAT) AS DOUBLE)"


@query(
    "local_histograms",
    f"WITH RECURSIVE {GRID}{PEAKS}{BOXES} SELECT rank, {bin_sql('p.lon', 'lon_min', 'lon_max', 50)} AS x, {bin_sql('p.lat', 'lat_min', 'lat_max', 50)} AS y, count(*) AS cnt FROM points p JOIN boxes ON p.lat BETWEEN lat_min AND lat_max AND p.lon BETWEEN lon_min AND lon_max "
    f"WHERE p.lon BETWEEN {_SINGLE.format('lon_min')} AND {_SINGLE.format('lon_max')} AND p.lat BETWEEN {_SINGLE.format('lat_min')} AND {_SINGLE.format('lat_max')} GROUP BY ALL",
)
def local_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.local_histograms(points(spark, sf_dir), _boxes(spark, sf_dir), 50)


@query("local_view_summary", f"WITH RECURSIVE {GRID}{PEAKS}{BOXES} SELECT rank, count(p.lat) AS total_points FROM boxes LEFT JOIN points p ON p.lat BETWEEN lat_min AND lat_max AND p.lon BETWEEN lon_min AND lon_max GROUP BY rank")
def local_view_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.local_summaries(points(spark, sf_dir), _boxes(spark, sf_dir)).select("rank", "total_points")


@query("sparse_payload", f"WITH {GRID} SELECT res, '[' || res || ',' || res // 2 || ']' AS shape, '[' || string_agg('[' || x || ',' || y || ']', ',' ORDER BY x, y) || ']' AS indices, string_agg(cnt, ',' ORDER BY x, y) AS counts, CAST(max(cnt) AS DOUBLE) AS max, CAST(sum(cnt) AS DOUBLE) AS sum FROM grid GROUP BY res")
def sparse_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = density.sparse_payload(grid(spark, sf_dir))
    return packed.select("res", F.to_json("shape").alias("shape"), F.to_json("indices").alias("indices"), F.array_join(F.transform("values", lambda v: v.cast("long").cast("string")), ",").alias("counts"), "max", "sum")


@query(
    "payload_tiles",
    f"WITH {GRID}, p AS (SELECT res, x // 16 AS tx, y // 16 AS ty, (x % 16) * 16 + y % 16 AS place, cnt FROM grid), s AS (SELECT *, place - coalesce(lag(place) OVER (PARTITION BY res, tx, ty ORDER BY place), 0) AS step FROM p) "
    "SELECT res, tx, ty, string_agg(step, ',' ORDER BY place) AS steps, string_agg(cnt, ',' ORDER BY place) AS counts FROM s GROUP BY res, tx, ty",
)
def payload_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.payload_tiles(grid(spark, sf_dir), 16).select("res", "tx", "ty", *[F.array_join(F.transform(c, lambda v: v.cast("string")), ",").alias(n) for c, n in (("steps", "steps"), ("values", "counts"))])


@query("nearest_resolution", f"WITH {GRID} SELECT res FROM (SELECT DISTINCT res FROM grid) ORDER BY abs(res - 540), res LIMIT 1")
def nearest_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.nearest_resolution(grid(spark, sf_dir), 540)


# Zones

_RINGS = [
    ("Z1", 0, [[-125.0, 24.0], [-66.0, 24.0], [-66.0, 50.0], [-125.0, 50.0]]),
    ("Z1", 1, [[-98.0, 33.5], [-97.0, 33.5], [-97.0, 35.0], [-98.0, 35.0]]),
    ("Z2", 0, [[-30.0, -70.0], [60.0, -70.0], [15.0, 40.0]]),
]
_EDGES = ", ".join(f"('{z}', {a[0]}, {a[1]}, {b[0]}, {b[1]})" for z, _, ps in _RINGS for a, b in zip(ps, ps[1:] + ps[:1], strict=True) if a[1] != b[1])
ZONES = f""",
edges AS (SELECT zone, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2 FROM (VALUES {_EDGES}) e(zone, x1, y1, x2, y2)),
held AS (SELECT seq, zone FROM points JOIN edges ON (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY seq, zone HAVING count(*) % 2 = 1),
counts AS (SELECT zone, count(*) AS points FROM held GROUP BY zone)"""


def _edges(spark: SparkSession) -> DataFrame:
    return zones.edges(spark.createDataFrame(_RINGS, "zone string, ring int, points array<array<double>>"))


@query("zone_counts", f"WITH {POINTS}{ZONES} SELECT zone, points FROM counts")
def zone_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.zone_counts(points(spark, sf_dir), _edges(spark))


_STATES = ", ".join("('{}', '{}', '{}', {}, {})".format(*r) for r in state_rows())


@query("zone_top", f"WITH {POINTS}{ZONES} SELECT fip, name, abbrev, points, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon FROM (SELECT CASE zone WHEN 'Z1' THEN '48' ELSE '06' END AS fip, points FROM counts) JOIN (VALUES {_STATES}) s(fip, name, abbrev, lat, lon) USING (fip)")
def zone_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = zone_counts(spark, sf_dir).withColumn("zone", F.when(F.col("zone") == "Z1", "48").otherwise("06"))
    return zones.with_states(counts, states(spark))


@query("zone_total", f"WITH {POINTS}{ZONES} SELECT CAST(sum(points) AS BIGINT) AS total FROM counts")
def zone_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zone_counts(spark, sf_dir).agg(F.sum("points").alias("total"))


@query("state_dimension", f"SELECT fip, name, abbrev, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon, n FROM (SELECT lpad(CAST(s_suppkey % 60 AS VARCHAR), 2, '0') AS fip, count(*) AS n FROM supplier GROUP BY 1) JOIN (VALUES {_STATES}) s(fip, name, abbrev, lat, lon) USING (fip)")
def state_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states of the suppliers, if their keys' remainders are state codes."""
    codes = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(predicates.pad_fips((F.col("s_suppkey") % 60).cast("string")).alias("fip"))
    return codes.groupBy("fip").agg(F.count(F.lit(1)).alias("n")).join(states(spark), "fip").select("fip", "name", "abbrev", "lat", "lon", "n")


# Samples


@query("every_nth_per_name", f"WITH {POINTS} SELECT seq, name FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY seq) AS rn FROM points WHERE accuracy > 0 AND accuracy < 90) WHERE rn % 5 = 0")
def every_nth_per_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    passing = points(spark, sf_dir).where(predicates.passes_accuracy(F.col("accuracy"), 90))
    return sampling.every_nth(passing, 5, "seq", ["name"], span=1024).select("seq", "name")


@query("every_nth_global", f"WITH {POINTS} SELECT seq, name FROM (SELECT *, row_number() OVER (ORDER BY seq) AS rn FROM points) WHERE rn % 10 = 0")
def every_nth_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.every_nth(points(spark, sf_dir), 10, "seq", span=1024).select("seq", "name")


@query("modulus_sample", f"WITH {POINTS} SELECT seq, lon, lat FROM points WHERE seq % 10 = 0")
def modulus_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.by_modulus(points(spark, sf_dir), "seq", 10).select("seq", "lon", "lat")


@query("fraction_sample", f"WITH {POINTS} SELECT seq, lon, lat FROM points WHERE CAST('0x' || substr(md5('42:' || seq), 1, 8) AS BIGINT) < {int(0.1 * 2**32)}")
def fraction_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.fraction(points(spark, sf_dir), 0.1, key="seq").select("seq", "lon", "lat")


@query("exact_sample", f"WITH {POINTS} SELECT seq, activity FROM (SELECT *, row_number() OVER (PARTITION BY activity ORDER BY substr(md5('42:' || seq), 1, 15)) AS rn, count(*) OVER (PARTITION BY activity) AS n FROM points) WHERE rn <= floor(n * CAST(0.13 AS DOUBLE))")
def exact_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.exact_fraction(points(spark, sf_dir), 0.13, "seq", ["activity"]).select("seq", "activity")


@query("exact_sample_of_chunks", f"WITH {POINTS}, c AS (SELECT *, (row_number() OVER (ORDER BY seq) - 1) // 300 AS chunk FROM points) SELECT seq, chunk FROM (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY substr(md5('42:' || seq), 1, 15)) AS rn, count(*) OVER (PARTITION BY chunk) AS n FROM c) WHERE rn <= floor(n * CAST(0.1 AS DOUBLE))")
def exact_sample_of_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.exact_fraction(sampling.chunks(points(spark, sf_dir), "seq", 300, span=1024), 0.1, "seq", ["chunk"]).select("seq", "chunk")


# Features


def _feature_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.array("lon", "lat").alias("coordinates")).alias("geometry"), F.struct(F.col("name").alias("Name"), F.col("activity").alias("Activity"), F.when(F.col("seq") % 3 == 0, F.col("accuracy").cast("int")).alias("Accuracy")).alias("properties")))
    bare = F.to_json(F.struct(F.struct(F.array("lon", "lat").alias("coordinates")).alias("geometry")))
    broken = F.when(F.col("seq") % 11 == 0, F.lit('{"type":"Feature","geometry":null,"properties":{}}')).when(F.col("seq") % 13 == 0, F.lit("[1]")).when(F.col("seq") % 17 == 0, bare).otherwise(feature)
    return p.select("seq", broken.alias("value"))


_KEPT = "seq % 11 <> 0 AND seq % 13 <> 0"
_FULL = _KEPT + " AND seq % 17 <> 0"


@query("property_keys", f"WITH {POINTS} SELECT 'Name' AS name, min(seq) AS seq, 0 AS pos FROM points WHERE {_FULL} UNION ALL SELECT 'Activity', min(seq), 1 FROM points WHERE {_FULL} UNION ALL SELECT 'Accuracy', min(seq), 2 FROM points WHERE {_FULL} AND seq % 3 = 0")
def property_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.property_keys(features.parse_features(_feature_lines(spark, sf_dir)), "seq")


@query("flatten_features", f"WITH {POINTS} SELECT lat, lon, CASE WHEN seq % 17 <> 0 THEN name END AS \"Name\", CASE WHEN seq % 17 <> 0 THEN activity END AS \"Activity\", CASE WHEN seq % 3 = 0 AND seq % 17 <> 0 THEN CAST(CAST(accuracy AS INTEGER) AS VARCHAR) END AS \"Accuracy\" FROM points WHERE {_KEPT}")
def flatten_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.flatten(features.parse_features(_feature_lines(spark, sf_dir)), "seq")


@query("feature_counts", f"WITH {POINTS} SELECT count(*) AS lines, count(*) FILTER ({_KEPT}) AS features FROM points")
def feature_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.line_counts(_feature_lines(spark, sf_dir))


@query("feature_values", f"WITH {POINTS} SELECT seq AS id, lon, lat, name, round(accuracy, 3) AS accuracy, CASE WHEN seq % 2 = 0 THEN 'a }}\"{{ b' || chr(10) || '[ c' ELSE 'x\\' END AS notes FROM points")
def feature_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features that are written with line ends inside, or after each other, and read back."""
    p = points(spark, sf_dir)
    notes = F.when(F.col("seq") % 2 == 0, 'a }"{ b\n[ c').otherwise("x\\")
    value = F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("seq").cast("int").alias("id"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"), F.struct(F.col("accuracy").alias("Accuracy"), F.col("name").alias("Name"), notes.alias("Notes")).alias("properties")))
    spread = F.when(F.col("seq") % 3 == 0, F.regexp_replace(value, r'([\[{,])"', '$1\n "')).otherwise(value)
    folder = fresh_path(spark, "values")
    p.select(spread).write.option("lineSep", " ").text(folder)
    found = features.read_features(spark, folder, anywhere=True)
    at = F.col("geometry.coordinates")
    return found.select(F.col("id").cast("long").alias("id"), at[0].alias("lon"), at[1].alias("lat"), F.col("properties.Name").alias("name"), F.round("properties.Accuracy", 3).alias("accuracy"), F.col("properties.Notes").alias("notes"))


# Blur and scaling

SIGMA, POWER, THRESHOLD = 0.3, 2.0, 0.02


def _blur_sql(width: int) -> str:
    weights = smooth.kernel(SIGMA, width)
    half = len(weights) // 2
    rows = ", ".join(f"({k - half}, CAST({w!r} AS DOUBLE))" for k, w in enumerate(weights))
    height = width // 2
    return f"""
  kernel AS (SELECT step, weight FROM (VALUES {rows}) k(step, weight)),
  base AS (SELECT x, y, CAST(cnt AS DOUBLE) AS v FROM ({_grid_sql(width)})),
  across AS (SELECT ((x - step) % {width} + {width}) % {width} AS x, y, sum(v * weight) AS v FROM base, kernel GROUP BY ALL),
  reach AS (SELECT sy.i AS sy, t.i AS y, sum(weight) AS weight FROM range({height}) t(i), kernel, range({height}) sy(i) WHERE least({height - 1}, greatest(0, t.i + step)) = sy.i GROUP BY ALL),
  blurred AS (SELECT x, r.y, sum(v * r.weight) AS v FROM across a JOIN reach r ON a.y = r.sy GROUP BY ALL),
  scaled AS (SELECT x, y, z / max(z) OVER () AS z FROM (SELECT x, y, pow(ln(1 + v), {POWER}) AS z FROM blurred WHERE v > 0))"""


BLUR = POINTS + "," + _blur_sql(180)


def _blurred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smooth.blur(density.histogram(points(spark, sf_dir), [180]), SIGMA, 180, 90)


def _rounded(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.round(column, 6).alias(column))


@query("blurred_grid", f"WITH {BLUR} SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, round(v, 6) AS v FROM blurred")
def blurred_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_blurred(spark, sf_dir), "v")


@query("normalized_grid", f"WITH {BLUR} SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, round(z, 6) AS z FROM scaled")
def normalized_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(smooth.normalise(_blurred(spark, sf_dir), POWER), "z")


@query("threshold_grid", f"WITH {BLUR} SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, round(z, 6) AS z FROM scaled WHERE z >= {THRESHOLD}")
def threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(smooth.above(smooth.normalise(_blurred(spark, sf_dir), POWER), THRESHOLD), "z")


# Display


def _ramp_sql(channel: int) -> str:
    stops = display.COLOUR_STOPS
    cases = " ".join(f"WHEN t <= {q[0]} THEN CAST(floor({float(p[channel])} + {float(q[channel] - p[channel])} * ((t - CAST({p[0]} AS DOUBLE)) / CAST({q[0] - p[0]!r} AS DOUBLE)) + 0.5) AS INTEGER)" for p, q in zip(stops, stops[1:], strict=False))
    return f"CASE {cases} END"


def _shades_sql() -> str:
    """The colours of a mesh's vertices: of the ramp at t, as shares of 255, darker below."""
    return ", ".join(f"round(({_ramp_sql(k)}) / CAST(255 AS DOUBLE) * shade, 6) + 0 AS {c}" for k, c in ((1, "red"), (2, "green"), (3, "blue")))


@query("colour_ramp", f"SELECT k, {_ramp_sql(1)} AS red, {_ramp_sql(2)} AS green, {_ramp_sql(3)} AS blue FROM (SELECT k, CAST(k AS DOUBLE) / 99 AS t FROM (SELECT DISTINCT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))")
def colour_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = points(spark, sf_dir).select(F.col("accuracy").cast("int").alias("k")).distinct()
    return k.withColumn("c", display.colour(F.col("k").cast("double") / F.lit(99.0))).select("k", "c.*")


@query("sphere_xyz", f"WITH {POINTS} SELECT seq, round(1.5 * cos(radians(lat)) * cos(radians(-lon)), 9) + 0 AS px, round(1.5 * sin(radians(lat)), 9) + 0 AS py, round(1.5 * cos(radians(lat)) * sin(radians(-lon)), 9) + 0 AS pz FROM points".replace("1.5", "CAST(1.5 AS DOUBLE)"))
def sphere_xyz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("seq", *[(F.round(c, 9) + F.lit(0.0)).alias(n) for n, c in display.sphere(F.col("lon"), F.col("lat"), 1.5).items()])


@query("human_counts", "SELECT user_id, CASE WHEN n >= 1000000 THEN printf('%.1fM', n / 1e6) WHEN n >= 1000 THEN printf('%.1fk', n / 1e3) ELSE CAST(n AS VARCHAR) END AS label FROM (SELECT user_id, count(*) * 37 AS n FROM events GROUP BY user_id)")
def human_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _events(spark, sf_dir).groupBy("user_id").agg((F.count(F.lit(1)) * 37).alias("n"))
    return n.select("user_id", display.human_count(F.col("n")).alias("label"))


@query("label_fallback", "SELECT n_nationkey, coalesce(nullif(CASE n_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'N' || n_nationkey END, ''), nullif(CASE n_nationkey % 2 WHEN 0 THEN '' END, ''), nullif(substr(n_name, 1, 3), ''), '?') AS label FROM nation")
def label_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    abbrev = F.when(key % 3 == 0, "").when(key % 3 == 1, F.concat(F.lit("N"), key.cast("string")))
    return nation.select("n_nationkey", display.first_label(abbrev, F.when(key % 2 == 0, ""), F.col("n_name")).alias("label"))


@query("cell_labels", "SELECT res, CAST(round(CAST(360 AS DOUBLE) / res, 4) AS VARCHAR) || ' degrees' AS label, n FROM (SELECT CAST(90 * pow(2, event_id % 6) AS INTEGER) AS res, count(*) AS n FROM events GROUP BY 1)")
def cell_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of the resolutions that events stand for, and how many do."""
    of_events = _events(spark, sf_dir).groupBy((F.lit(90) * F.pow(F.lit(2.0), F.col("event_id") % 6)).cast("int").alias("res")).agg(F.count(F.lit(1)).alias("n"))
    return of_events.select("res", display.cell_label(F.col("res")).alias("label"), "n")


@query("ranked_bars", f"WITH {POINTS}, c AS (SELECT name, count(*) AS n FROM points GROUP BY name ORDER BY n DESC, name LIMIT 24), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, name) - 1 AS i, count(*) OVER () AS items, max(n) OVER () AS most FROM c) SELECT name, n, round(greatest(0.1, n / most * 1.5), 6) AS length, round(i / items * 2 * pi(), 6) AS angle, round((i % 3 - 1) * CAST(0.15 AS DOUBLE), 6) AS shift FROM r")
def ranked_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.ranked_bars(sampling.name_counts(points(spark, sf_dir)))


@query("tile_index", "SELECT zoom, x, y FROM (SELECT 12 AS zoom, CAST(floor((lon + 180) / 360 * pow(2, 12)) AS BIGINT) AS x, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * pow(2, 12)) AS BIGINT) AS y FROM points) GROUP BY ALL".replace("SELECT zoom", f"WITH {POINTS} SELECT zoom", 1))
def tile_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    zoom = display.zoom_for(F.lit(0.2))
    return points(spark, sf_dir).select(zoom.alias("zoom"), display.tile_x(F.col("lon"), zoom).alias("x"), display.tile_y(F.col("lat"), zoom).alias("y")).distinct()


@query("density_mesh", f"WITH {BLUR}, k AS (SELECT x, y, z FROM scaled WHERE z >= 0.1), c AS (SELECT x, y, z, unnest(range(8)) AS corner FROM k), p AS (SELECT *, (x + CASE WHEN corner % 4 IN (1, 2) THEN 1 ELSE 0 END) / 180.0 * 360 - 180 AS lon, (y + CASE WHEN corner % 4 IN (2, 3) THEN 1 ELSE 0 END) / 90.0 * 180 - 90 AS lat, CASE WHEN corner < 4 THEN CAST(1.001 AS DOUBLE) ELSE 1 + z * CAST(0.3 AS DOUBLE) END AS r, least(1, greatest(0, z)) AS t, CASE WHEN corner < 4 THEN CAST(0.6 AS DOUBLE) ELSE 1 END AS shade FROM c) SELECT " + _shades_sql() + ", CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, corner, round(r * cos(radians(lat)) * cos(radians(-lon)), 6) + 0 AS px, round(r * sin(radians(lat)), 6) + 0 AS py, round(r * cos(radians(lat)) * sin(radians(-lon)), 6) + 0 AS pz FROM p".replace("180.0", "CAST(180 AS DOUBLE)").replace("90.0", "CAST(90 AS DOUBLE)"))
def density_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = smooth.above(smooth.normalise(_blurred(spark, sf_dir), POWER), 0.1)
    v = mesh.globe_vertices(kept, 180, 90, height_scale=0.3)
    return v.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col("corner").cast("long").alias("corner"), *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("px", "py", "pz", "red", "green", "blue")])


@query("mesh_triangles", f"WITH {BLUR} SELECT triangle, count(*) AS n FROM (SELECT unnest(range(10)) AS triangle FROM scaled WHERE z >= 0.1) GROUP BY triangle")
def mesh_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = smooth.above(smooth.normalise(_blurred(spark, sf_dir), POWER), 0.1)
    return mesh.triangles(kept).groupBy(F.col("triangle").cast("long").alias("triangle")).agg(F.count(F.lit(1)).alias("n"))


@query("local_mesh", f"WITH {BLUR}, c AS (SELECT x, y, z, unnest(range(8)) AS corner FROM scaled WHERE z >= 0.1), d AS (SELECT *, least(1, greatest(0, z)) AS t, CASE WHEN corner < 4 THEN CAST(0.5 AS DOUBLE) ELSE 1 END AS shade FROM c) SELECT " + _shades_sql() + ", CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, corner, round(((x + CASE WHEN corner % 4 IN (1, 2) THEN 1 ELSE 0 END) / CAST(180 AS DOUBLE) - 0.5) * 8, 6) + 0 AS px, round(((y + CASE WHEN corner % 4 IN (2, 3) THEN 1 ELSE 0 END) / CAST(90 AS DOUBLE) - 0.5) * 4, 6) + 0 AS py, round(CASE WHEN corner < 4 THEN 0 ELSE z * CAST(2 AS DOUBLE) END, 6) + 0 AS pz FROM d")
def local_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = smooth.above(smooth.normalise(_blurred(spark, sf_dir), POWER), 0.1)
    v = mesh.plane_vertices(kept, 180, 90, height_scale=0.5, aspect=0.5)
    return v.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col("corner").cast("long").alias("corner"), *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("px", "py", "pz", "red", "green", "blue")])


@query("bar_labels", f"WITH {POINTS}{ZONES} SELECT fip, points, abbrev AS label FROM (SELECT CASE zone WHEN 'Z1' THEN '48' ELSE '06' END AS fip, points FROM counts) JOIN (VALUES {_STATES}) s(fip, name, abbrev, lat, lon) USING (fip)")
def bar_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.bar_labels(zone_top(spark, sf_dir)).select("fip", "points", "label")


@query("peak_panel", f"WITH RECURSIVE {GRID}{PEAKS} SELECT rank, printf('%.2f', lat) AS lat, printf('%.2f', lon) AS lon, printf('%,d', cnt) AS cnt, CASE WHEN cnt >= 1000000 THEN printf('%.1fM', cnt / 1e6) WHEN cnt >= 1000 THEN printf('%.1fk', cnt / 1e3) ELSE CAST(cnt AS VARCHAR) END AS label FROM peaks")
def peak_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.peak_rows(peak_locations(spark, sf_dir))


_TILE_Y = "CAST(floor((1 - ln(tan(radians({0})) + 1 / cos(radians({0}))) / pi()) / 2 * 4096) AS BIGINT)"
_TILE_X = "CAST(floor(({} + 180) / 360 * 4096) AS BIGINT)"
_TILE_LAT = "degrees(atan(sinh(pi() * (1 - 2 * CAST({} AS DOUBLE) / 4096))))"
TILES = f""",
wide AS (SELECT *, unnest(range({_TILE_X.format("lon_min")}, {_TILE_X.format("lon_max")} + 1)) AS tile_x FROM boxes),
tiled AS (SELECT *, unnest(range({_TILE_Y.format("lat_max")}, {_TILE_Y.format("lat_min")} + 1)) AS tile_y FROM wide),
edged AS (SELECT *, CAST(tile_x AS DOUBLE) / 4096 * 360 - 180 AS west, CAST(tile_x + 1 AS DOUBLE) / 4096 * 360 - 180 AS east, {_TILE_LAT.format("tile_y")} AS north, {_TILE_LAT.format("tile_y + 1")} AS south FROM tiled)"""


@query(
    "peak_tiles",
    f"WITH RECURSIVE {GRID}{PEAKS}{BOXES}{TILES} SELECT rank, 12 AS zoom, tile_x, tile_y, round((west - lon_min) / (lon_max - lon_min), 6) + 0 AS left, round((lat_max - north) / (lat_max - lat_min), 6) + 0 AS top, round((east - west) / (lon_max - lon_min), 6) AS width, round((north - south) / (lat_max - lat_min), 6) AS height FROM edged",
)
def peak_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = [(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("left", "top", "width", "height")]
    return mesh.tiles(_boxes(spark, sf_dir), F.lit(12)).select("rank", "zoom", F.col("tile_x").cast("long").alias("tile_x"), F.col("tile_y").cast("long").alias("tile_y"), *placed)


@query("boundary_decimate", "WITH r AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey % 50 ORDER BY l_orderkey, l_linenumber) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey % 50) AS n, l_orderkey % 50 AS ring FROM lineitem), k AS (SELECT ring, n, i FROM r WHERE i % greatest(1, n // 80) = 0 AND n >= 4) SELECT CAST(ring AS BIGINT) AS ring, count(*) AS kept, CAST(max(i) AS BIGINT) AS last FROM k GROUP BY ring HAVING count(*) >= 3")
def boundary_decimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("ring", F.size("line").cast("long").alias("kept"), F.element_at("line", -1)[0].cast("long").alias("last"))


def _lines(spark: SparkSession, sf_dir: str, factor: int = 80) -> DataFrame:
    """Lines whose points are numbered, one per 50th of the orders."""
    size = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy((F.col("l_orderkey") % 50).alias("ring")).agg(F.count(F.lit(1)).alias("n"))
    rings = size.select("ring", F.transform(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")), lambda i: F.array(i.cast("double"), F.lit(0.0))).alias("points"))
    return zones.decimate(rings, factor)


@query("boundary_union", "WITH s AS (SELECT l_orderkey % 50 AS ring, count(*) AS n FROM lineitem GROUP BY 1) SELECT 0 AS source, CAST(ring AS BIGINT) AS ring, CAST(ceil(n / greatest(1, n // 30)) AS BIGINT) AS kept FROM s UNION ALL SELECT 1, CAST(ring AS BIGINT), CAST(ceil(n / greatest(1, n // 80)) AS BIGINT) FROM s")
def boundary_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    world, own = _lines(spark, sf_dir, 30).withColumn("source", F.lit(0)), _lines(spark, sf_dir, 80).withColumn("source", F.lit(1))
    return world.unionByName(own).select("source", "ring", F.size("line").cast("long").alias("kept"))


# Shapes as a shapefile has them: rings with a kind and attributes


def _shape_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ring per supplier around a place of its own, as many corners as its key says, of several kinds and states."""
    key = F.col("s_suppkey").cast("int")
    step = F.lit(2 * math.pi) / (F.lit(3) + key % 200)
    around = F.transform(F.sequence(F.lit(0), F.lit(2) + key % 200), lambda k: F.array((key % 60 - F.lit(130)).cast("double") + F.cos(step * k), (F.lit(25) + key % 20).cast("double") + F.sin(step * k)))
    kind = F.when(key % 7 == 0, 3).when(key % 2 == 0, 5).otherwise(15)
    code = F.when(key % 13 == 0, "02").when(key % 11 == 0, "2").when(key % 3 == 0, "1").otherwise("48")
    # A small file is read by one task, and its rows become a hundred times as many corners: all cores share them.
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey").repartition(spark.sparkContext.defaultParallelism, "s_suppkey")
    return suppliers.select(key.alias("record"), F.lit(0).alias("ring"), kind.alias("kind"), around.alias("points"), F.create_map(F.lit("STATEFP"), code).alias("attributes"))


_SHAPES = """shapes AS (SELECT CAST(s_suppkey AS INTEGER) AS record, CASE WHEN s_suppkey % 7 = 0 THEN 3 WHEN s_suppkey % 2 = 0 THEN 5 ELSE 15 END AS kind,
  CASE WHEN s_suppkey % 13 = 0 THEN '02' WHEN s_suppkey % 11 = 0 THEN '2' WHEN s_suppkey % 3 = 0 THEN '1' ELSE '48' END AS raw, CAST(3 + s_suppkey % 200 AS INTEGER) AS n, s_suppkey AS k FROM supplier),
corners AS (SELECT *, k % 60 - 130 + cos(2 * pi() / n * i) AS x, 25 + k % 20 + sin(2 * pi() / n * i) AS y FROM (SELECT *, CAST(unnest(range(n)) AS INTEGER) AS i FROM shapes))"""


@query(
    "boundary_on_sphere",
    f"WITH {_SHAPES}, f AS (SELECT *, CAST(CAST(x AS FLOAT) AS DOUBLE) AS lon, CAST(CAST(y AS FLOAT) AS DOUBLE) AS lat FROM corners WHERE kind IN (5, 15) AND raw <> '02' AND n >= 4 AND i % greatest(1, n // 80) = 0) "
    "SELECT record, count(*) AS corners, round(sum(1.5 * cos(radians(lat)) * cos(radians(-lon))), 4) AS px, round(sum(1.5 * sin(radians(lat))), 4) AS py, round(sum(1.5 * cos(radians(lat)) * sin(radians(-lon))), 4) AS pz FROM f GROUP BY record".replace("1.5", "CAST(1.5 AS DOUBLE)"),
)
def boundary_on_sphere(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = mesh.ring_on_sphere(zones.boundary_lines(_shape_rings(spark, sf_dir), 80, "STATEFP"), 1.5)
    each = lines.select("record", F.explode("positions").alias("p")).select("record", "p.*")
    return each.groupBy("record").agg(F.count(F.lit(1)).alias("corners"), *[F.round(F.sum(c), 4).alias(c) for c in ("px", "py", "pz")])


@query("zone_rings", f"WITH {_SHAPES} SELECT CASE WHEN length(raw) < 2 THEN '0' || raw ELSE raw END AS zone, CAST(count(DISTINCT record) AS BIGINT) AS rings, count(*) AS corners FROM corners WHERE kind IN (5, 15) AND raw NOT IN ('2', '02') GROUP BY 1")
def zone_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rings = zones.zone_rings(_shape_rings(spark, sf_dir), "STATEFP", states(spark))
    return rings.groupBy("zone").agg(F.count(F.lit(1)).alias("rings"), F.sum(F.size("points")).alias("corners"))


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square of a degree per supplier, in a field of ten columns, with a hole in some; the zones are the suppliers' nations."""
    k = F.col("s_suppkey")
    x, y = (k % 10).cast("double"), F.floor(k / 10).cast("double")
    corner = lambda a, b: F.array(x + F.lit(a), y + F.lit(b))
    outer = F.array(corner(0.0, 0.0), corner(0.0, 1.0), corner(1.0, 1.0), corner(1.0, 0.0))
    hole = F.array(corner(0.25, 0.25), corner(0.75, 0.25), corner(0.75, 0.75), corner(0.25, 0.75))
    rings = F.when(k % 7 == 0, F.array(outer, hole)).otherwise(F.array(outer))
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("n"), (F.col("s_nationkey") % 4).cast("string")).alias("zone"), F.posexplode(rings).alias("ring", "points"))


@query(
    "dissolved_zones",
    "WITH t AS (SELECT 'n' || s_nationkey % 4 AS zone, s_suppkey % 10 AS x, s_suppkey // 10 AS y, s_suppkey % 7 = 0 AS hole FROM supplier), "
    "n AS (SELECT a.zone, count(*) AS n FROM t a JOIN t b ON a.zone = b.zone AND ((b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1)) GROUP BY a.zone) "
    "SELECT zone, round(count(*) - CAST(0.25 AS DOUBLE) * count(*) FILTER (hole), 6) AS area, round(CAST(4 * count(*) + 2 * count(*) FILTER (hole) - 2 * coalesce(any_value(n.n), 0) AS DOUBLE), 6) AS outline FROM t LEFT JOIN n USING (zone) GROUP BY zone",
)
def dissolved_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = dissolve.areas(dissolve.dissolve(_tiles(spark, sf_dir)))
    return whole.select("zone", F.round("area", 6).alias("area"), F.round("outline", 6).alias("outline"))


# Streams and the report


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # As a pattern, the path may be one file or a folder of files.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")


@query("stream_filter", SQL["match_all"])
def stream_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    passing = _event_stream(spark, sf_dir).where(pathquery.match_all(F.col("props"), ["#(k<50)", "#(k>=10)"]))
    return streams.drain(passing.select("event_id", "props"))


@query("stream_histogram", SQL["multi_resolution_histogram"])
def stream_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = grids.Grid(spark, fresh_path(spark, "grid"), RESOLUTIONS)
    grid.follow(_as_points(_event_stream(spark, sf_dir)), fresh_path(spark, "grid-state"), None).awaitTermination()
    return grid.counts()


@query("stream_histogram_complete", SQL["multi_resolution_histogram"])
def stream_histogram_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.drain(streams.stream_histogram(_as_points(_event_stream(spark, sf_dir)), RESOLUTIONS), "complete")


@query("grid_of_days", SQL["multi_resolution_histogram"])
def grid_of_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same grids, from increments of 17 parts of the events, each of which is handed over twice."""
    grid = grids.Grid(spark, fresh_path(spark, "grid"), RESOLUTIONS)
    for k in range(17):
        for _ in range(2):
            grid.add(points(spark, sf_dir).where(F.col("seq") % 17 == k), k)
    return grid.counts()


@query("stream_every_nth", SQL["every_nth_per_name"])
def stream_every_nth(spark: SparkSession, sf_dir: str) -> DataFrame:
    passing = _as_points(_event_stream(spark, sf_dir)).where(predicates.passes_accuracy(F.col("accuracy"), 90)).select("seq", "name")
    return streams.every_nth_per_key(passing, 5, "name", "seq")


@query(
    "report_document",
    f"WITH RECURSIVE {GRID}{PEAKS}{BOXES}{ZONES}, views AS (SELECT rank, count(p.lat) AS n FROM boxes LEFT JOIN points p ON p.lat BETWEEN lat_min AND lat_max AND p.lon BETWEEN lon_min AND lon_max GROUP BY rank) "
    "SELECT (SELECT count(*) FILTER (lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90) FROM points) AS total_points, (SELECT string_agg(cnt, ',' ORDER BY rank) FROM peaks) AS peaks, (SELECT string_agg(n, ',' ORDER BY rank) FROM views) AS views, "
    "coalesce((SELECT string_agg(points, ',' ORDER BY points DESC) FROM counts), '') AS states, (SELECT string_agg(n, ',' ORDER BY res) FROM (SELECT res, count(*) AS n FROM grid GROUP BY res)) AS cells, (SELECT string_agg(s, ',' ORDER BY res) FROM (SELECT res, CAST(sum(cnt) AS BIGINT) AS s FROM grid GROUP BY res)) AS sums",
)
def report_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the report's document and tiles say, read back from their JSON texts."""
    text = report.document(points(spark, sf_dir), list(RESOLUTIONS), zones=zone_top(spark, sf_dir))
    kind = "total_points long, peaks array<struct<rank:int,cnt:long>>, local_views array<struct<rank:int,total_points:long>>, state_counts array<struct<points:long>>, res int, values array<long>"
    doc = text.select("part", F.from_json("document", kind).alias("d")).select("part", "d.*")
    joined = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
    head = {"peaks": "peaks.cnt", "views": "local_views.total_points", "states": "state_counts.points"}
    of_grids = lambda f: F.array_join(F.array(*[F.sum(F.when(F.col("res") == r, f)).cast("string") for r in RESOLUTIONS]), ",")
    return doc.agg(
        F.max("total_points").alias("total_points"), *[F.max(F.when(F.col("part") == 0, joined(F.col(c)))).alias(n) for n, c in head.items()],
        of_grids(F.size("values")).alias("cells"), of_grids(F.aggregate("values", F.lit(0).cast("long"), lambda a, v: a + v)).alias("sums"),
    )
