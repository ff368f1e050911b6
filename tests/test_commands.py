import gzip
import json

from pyspark.sql import functions as F

from terragrain.__main__ import parser, run
from terragrain.operators import metrics
from terragrain.sources import report, shapefile

FEATURE = '{{"type":"Feature","id":{k},"geometry":{{"type":"Point","coordinates":[{lon},{lat}]}},"properties":{{"Name":"{name}","Activity":"{activity}","Accuracy":{accuracy},"UnixTime":{k}}}}}'


def lines(n):
    return [FEATURE.format(k=k, lon=10 + k % 3, lat=50, name="ab"[k % 2], activity="Unknown" if k % 10 == 9 else "Walking", accuracy=5 + k) for k in range(n)]


def text(path):
    return [x for f in sorted(path.glob("part-*")) for x in (gzip.open(f, "rt").read() if f.suffix == ".gz" else f.read_text()).splitlines()]


def test_filter_sample_flatten_and_report(spark, tmp_path):
    (tmp_path / "in.json").write_text("\n".join(lines(60)))
    at = lambda name: str(tmp_path / name)
    run(spark, parser().parse_args(["filter", "-i", at("in.json"), "-o", at("kept"), "--match-all", "#(properties.Accuracy<35)", "--match-none", '#(properties.Name="b")']))
    assert [json.loads(x)["id"] for x in text(tmp_path / "kept")] == list(range(0, 30, 2))
    run(spark, parser().parse_args(["sample", "-i", at("in.json"), "-o", at("sampled"), "-n", "5", "--min-accuracy", "50"]))
    a, b = [k for k in range(45) if k % 2 == 0], [k for k in range(45) if k % 2 and k % 10 != 9]
    assert sorted(json.loads(x)["id"] for x in text(tmp_path / "sampled")) == sorted(a[4::5] + b[4::5])
    (tmp_path / "aliases.csv").write_text("b,a\n")
    run(spark, parser().parse_args(["sample", "-i", at("in.json"), "-o", at("aliased"), "-n", "5", "--min-accuracy", "50", "--aliases", at("aliases.csv")]))
    both = [json.loads(x) for x in text(tmp_path / "aliased")]
    assert sorted(x["id"] for x in both) == [k for k in range(45) if k % 10 != 9][4::5]
    assert {x["properties"]["Name"] for x in both} == {"a"}
    run(spark, parser().parse_args(["flatten", "-i", at("in.json"), "-o", at("table")]))
    assert text(tmp_path / "table")[0].split("\t")[:2] == ["lat", "lon"]
    run(spark, parser().parse_args(["report", "-i", at("table"), "-o", at("page.html"), "--resolutions", "180", "360", "--n-peaks", "2"]))
    doc = report.load_page((tmp_path / "page.html").read_text())
    assert doc["total_points"] == 60 and len(doc["peaks"]) == 2


def test_metrics_and_missing_shapefiles(spark, tmp_path):
    rows, seen = metrics.observed(spark.range(10), F.col("id") % 2 == 0)
    rows.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 10, "valid": 5}
    assert shapefile.read_first(spark, [str(tmp_path / "a.shp"), str(tmp_path / "b")]).count() == 0
