"""GeoJSON features: typed and raw readers, flattening with a discovered schema, TSV and JSON writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.predicates import computed, lenient_double
from .values import read_values

FEATURE = (
    "type string, id int, geometry struct<type:string, coordinates:array<double>>, "
    "properties struct<Accuracy:double, Activity:string, Elevation:double, Heading:double, Name:string, Notes:string, "
    "Pressure:double, Speed:double, Time:timestamp, UUID:string, UnixTime:bigint, Version:string>"
)


def read_features(spark: SparkSession, path: str, strict: bool = True, anywhere: bool = False) -> DataFrame:
    """Typed features; a bad value fails the job, or is null where not strict.

    There is one JSON value a line, or, ``anywhere``, values stand as they like: this takes a second
    pass over the files, and gives their order in ``_at``.
    """
    if anywhere:
        return typed(read_values(spark, path), strict)
    return spark.read.schema(FEATURE).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def typed(lines: DataFrame, strict: bool = True) -> DataFrame:
    """Lines, or values, with their fields typed in columns beside the others; a bad one fails the job, or is null where not strict."""
    read = F.from_json("value", FEATURE, {"mode": "FAILFAST" if strict else "PERMISSIVE"})
    kept = [c for c in lines.columns if c != "value"]
    return computed(lines, _read=read).select("_read.*", *kept)


def stream_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(FEATURE).json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines, plain or compressed, in ``value``."""
    return spark.read.text(path)


def write_features(features: DataFrame, path: str) -> None:
    """JSON lines with every field, absent ones included."""
    features.write.option("ignoreNullFields", "false").json(path)


def write_lines(lines: DataFrame, path: str, compression: str = "none") -> None:
    lines.select("value").write.option("compression", compression).text(path)


#: What flattening reads of a line: texts as they stand there, properties in their order.
_LINE = "geometry struct<coordinates: array<string>>, properties map<string, string>, _bad string"


def parse_features(lines: DataFrame, line: str = "value") -> DataFrame:
    """Adds lat, lon and props (a map of property texts, in the line's order); lines without a usable position are dropped.

    ``lines`` keeps its other columns, and a line is parsed once. A feature without ``properties``
    has none, and is kept. Blank lines, bad JSON, null geometry and null properties are skipped.
    """
    read = F.from_json(line, _LINE, {"columnNameOfCorruptRecord": "_bad"})
    parsed = computed(lines.where(F.ltrim(line).startswith("{")), _line=read).where(F.col("_line._bad").isNull())
    at = lambda i: lenient_double(F.get("_line.geometry.coordinates", F.lit(i)))
    # Properties that are null, or no object, are there by name.
    none = F.array_contains(F.json_object_keys(line), "properties")
    props = F.coalesce("_line.properties", F.when(~F.coalesce(none, F.lit(True)), F.create_map().cast("map<string,string>")))
    out = computed(parsed, lon=at(0), lat=at(1), props=props).drop("_line")
    return out.where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("props").isNotNull())


def line_counts(lines: DataFrame, line: str = "value") -> DataFrame:
    """One row: lines, and those that parse to a feature."""
    found = parse_features(lines.select(line), line).agg(F.count(F.lit(1)).alias("features"))
    return lines.agg(F.count(F.lit(1)).alias("lines")).crossJoin(F.broadcast(found))  # of one row each


def property_keys(parsed: DataFrame, order: str) -> DataFrame:
    """(name, seq, pos) of every property key, where it is first seen by the column ``order``."""
    keys = parsed.select(F.col(order).alias("seq"), F.posexplode(F.map_keys("props")).alias("pos", "name"))
    return keys.groupBy("name").agg(F.min(F.struct("seq", "pos")).alias("at")).select("name", F.col("at.seq").alias("seq"), F.col("at.pos").alias("pos"))


def flatten(parsed: DataFrame, order: str) -> DataFrame:
    """lat, lon and one text column per property, in first-seen order; properties called lat or lon give way.

    Nested properties are JSON text. The keys are the schema, so their list, as short as a row is
    wide, comes to the driver.
    """
    names = [r["name"] for r in property_keys(parsed, order).orderBy("seq", "pos").collect() if r["name"] not in ("lat", "lon")]
    return parsed.select("lat", "lon", *[F.col("props")[n].alias(n) for n in names])


def with_arrival(lines: DataFrame) -> DataFrame:
    """Adds ``_at``, a whole number that grows with a line's place in its file, and with the files' paths.

    ``lines`` come straight from files. Blocks of files are numbered, one row a block; within its
    block a line has the place that its task counts.
    """
    at = lines.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_row"))
    blocks = at.select("_file", "_start").distinct().withColumn("_block", F.row_number().over(Window.orderBy("_file", "_start")).cast("long"))
    return at.join(blocks, ["_file", "_start"]).withColumn("_at", F.shiftleft(F.col("_block"), 33) + F.col("_row")).drop("_file", "_start", "_block", "_row")


def write_tsv(rows: DataFrame, path: str) -> None:
    rows.write.option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').option("compression", "gzip").csv(path)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """lat and lon of a flattened file, as text: short rows have nulls, long ones lose what is over."""
    rows = spark.read.option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    return rows.select("lat", "lon")
