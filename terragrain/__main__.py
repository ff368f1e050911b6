"""Commands: filter, sample, flatten and report, from files to files."""

from __future__ import annotations

import argparse
import json
import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import pathquery, predicates
from .operators import sampling, zones
from .sources import features, report, shapefile
from .sources.states import states
from .streaming import streams


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="terragrain")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, about: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=about)
        p.add_argument("-i", "--input", required=True)
        p.add_argument("-o", "--output", required=True)
        return p

    def following(p: argparse.ArgumentParser) -> None:
        p.add_argument("--follow", default="", metavar="STATE", help="go on with lines of files that come later, and keep the state in this folder")
        p.add_argument("--every", default="10 seconds", help="how often to look for them; once: end with what is there now")
        p.add_argument("--at-once", type=int, default=1 << 30, help="bytes of files that are taken on together")

    p = command("filter", "keep the lines that path queries match")
    following(p)
    for clause in ("all", "any", "none"):
        p.add_argument(f"--match-{clause}", default="", help="comma-separated path queries")
    p = command("sample", "keep every nth feature of each name")
    following(p)
    p.add_argument("--lines", action="store_true", help="there is one value a line (always so when following), which is read in one pass")
    p.add_argument("--report", type=int, default=100_000, help="features written between two reports of all names' counts, when following")
    p.add_argument("-n", type=int, default=100)
    p.add_argument("--names", default="", help="comma-separated; all where empty")
    p.add_argument("--aliases", default="", help="CSV of name,alias without a header: names that stand for others")
    p.add_argument("--min-accuracy", type=float, default=100.0, help="strict upper limit; negative: none")
    p.add_argument("--require-activity", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--remove-unknown-activity", action=argparse.BooleanOptionalAction, default=True)
    command("flatten", "write features as a table")
    p = command("report", "write the density page of a flattened table")
    p.add_argument("--resolutions", type=int, nargs="+", default=[180, 360, 720, 1440, 2880])
    p.add_argument("--shapefile", default="", help="county polygons, state code in the first attribute")
    p.add_argument("--fips-field", default="STATEFP")
    p.add_argument("--world", default="", help="country polygons, drawn as boundary lines too")
    p.add_argument("--boundary-factor", type=int, nargs=2, default=[80, 30], metavar=("COUNTY", "WORLD"), help="parts that a line is thinned to")
    p.add_argument("--sigma", type=float, default=0.0, help="blur of the drawn grid")
    p.add_argument("--power", type=float, default=2.0, help="exponent of the drawn grid's scale")
    p.add_argument("--n-peaks", type=int, default=10)
    p.add_argument("--local-radius", type=float, default=50.0)
    p.add_argument("--local-resolution", type=int, default=200)
    p.add_argument("--sample-rate", type=float, default=1.0)
    p.add_argument("--quick", action="store_true", help="sample a tenth")
    return top


def tell(what: dict) -> None:
    print(json.dumps(what), file=sys.stderr, flush=True)


def passing(spark: SparkSession, rows: DataFrame, args: argparse.Namespace) -> DataFrame:
    """The features that a sample is drawn from, with their names made plain, and ``_name``."""
    p = rows.withColumn("_name", F.coalesce("properties.Name", F.lit("")))
    if args.aliases:
        p = sampling.with_alias(p, spark.read.schema("name string, alias string").csv(args.aliases), "_name")
    p = p.withColumn("properties", F.col("properties").withField("Name", F.col("_name")))
    accuracy, activity = F.coalesce("properties.Accuracy", F.lit(0.0)), F.coalesce("properties.Activity", F.lit(""))
    return p.where(predicates.passes_accuracy(accuracy, args.min_accuracy) & predicates.valid_activity(activity, args.require_activity, args.remove_unknown_activity) & predicates.passes_name(F.col("_name"), pathquery.split_queries(args.names)))


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    often = None if getattr(args, "every", None) == "once" else getattr(args, "every", None)
    if args.command == "filter":
        clauses = [pathquery.split_queries(getattr(args, f"match_{c}")) for c in ("all", "any", "none")]
        kept = pathquery.rejection(F.col("value"), *clauses).isNull()
        if args.follow:
            lines = spark.readStream.option("maxBytesPerTrigger", args.at_once).text(args.input)
            streams.follow(lines.where(kept), args.output, args.follow, often, tell).awaitTermination()
        else:
            features.write_lines(features.read_lines(spark, args.input).where(kept), args.output)
    elif args.command == "sample" and args.follow:
        lines = streams.with_arrival(spark.readStream.option("maxBytesPerTrigger", args.at_once).text(args.input))
        kept = passing(spark, features.typed(lines), args)
        whole = F.to_json(F.struct("type", "id", "geometry", "properties"), {"ignoreNullFields": "false"})
        sample = streams.sample_lines(kept.select("_name", *streams.ARRIVAL, whole.alias("value")), args.n, "_name", streams.ARRIVAL)
        streams.report_counts(spark, streams.follow(sample, args.output, args.follow, often), args.follow, args.report, tell)
    elif args.command == "sample":
        # Every nth by arrival: the files in order of their paths, and their values.
        rows = features.with_arrival(features.read_features(spark, args.input)) if args.lines else features.read_features(spark, args.input, anywhere=True)
        kept = passing(spark, rows, args)
        features.write_features(sampling.every_nth(kept, args.n, "_at", ["_name"]).drop("_name", "_at"), args.output)
        tell({r["_name"]: r["n"] for r in sampling.name_counts(kept, "_name").toLocalIterator()})
    elif args.command == "flatten":
        lines = features.with_arrival(features.read_lines(spark, args.input))
        features.write_tsv(features.flatten(features.parse_features(lines), "_at"), args.output)
    else:
        points = features.read_tsv(spark, args.input)
        share = 0.1 if args.quick else args.sample_rate
        points = points if share >= 1 else sampling.fraction(points, share)
        counts, lines = None, []
        if args.world:
            lines.append(zones.boundary_lines(shapefile.read_first(spark, [args.world]), args.boundary_factor[1]).select("line"))
        if args.shapefile:
            counties = shapefile.read_rings(spark, args.shapefile)
            lines.append(zones.boundary_lines(counties, args.boundary_factor[0], args.fips_field).select("line"))
            rings = zones.zone_rings(counties, args.fips_field, states(spark))
            numbered = points.select(predicates.lenient_double(F.col("lon")).alias("lon"), predicates.lenient_double(F.col("lat")).alias("lat"))
            counts = zones.with_states(zones.zone_counts(numbered, zones.edges(rings)), states(spark))
        found = report.document(points, args.resolutions, args.n_peaks, args.local_radius, args.local_resolution, zones=counts, boundaries=reduce(DataFrame.union, lines) if lines else None, sigma=args.sigma, power=args.power)
        with open(args.output, "w") as f:
            report.write_page(found, f)


if __name__ == "__main__":
    # Room for a million cells in the hash tables that tasks count points in.
    run(SparkSession.builder.appName("terragrain").config("spark.sql.codegen.aggregate.fastHashMap.capacityBit", "20").getOrCreate(), parser().parse_args())
