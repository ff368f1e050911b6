import json
import os
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from terragrain.__main__ import parser, run
from terragrain.plans import catalogue
from terragrain.sources import folders
from terragrain.streaming import streams


def test_every_nth_of_a_key_over_several_micro_batches(spark, tmp_path):
    """One name with 40,000 rows, and a few of another, equal the running number, however many micro-batches there are."""
    for k in range(4):
        rows = spark.range(k * 10_100, (k + 1) * 10_100).selectExpr("id AS seq", "if(id % 101 = 0, NULL, 'a') AS name", "id / 7 AS part", "timestamp_micros(id * 1234567) AS time")
        rows.orderBy("seq", ascending=False).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    for most in (1000, 1):
        stream = spark.readStream.schema("seq long, name string, part double, time timestamp").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", most).parquet(f"{tmp_path}/in")
        found = streams.every_nth_per_key(stream, 5, "name", "seq")
        everything = spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        wanted = everything.withColumn("number", F.row_number().over(Window.partitionBy("name").orderBy("seq"))).where("number % 5 = 0").drop("number")
        assert found.schema == wanted.schema
        assert sorted(found.collect()) == sorted(wanted.collect())
    with pytest.raises(ValueError):
        streams.sample_lines(stream, 0, "name", ["seq"])


def test_a_sample_goes_on_after_a_restart(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    (tmp_path / "in").mkdir()
    written = []

    def more(n):
        lines = [json.dumps({"type": "Feature", "id": k, "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"Name": "ab"[k % 3 == 0], "Activity": "Walking", "Accuracy": 5}}) for k in range(len(written), len(written) + n)]
        written.extend(lines)
        (tmp_path / f"part{len(written)}").write_text("\n".join(lines))
        time.sleep(1.1)  # files are taken in the order of their times
        os.replace(tmp_path / f"part{len(written)}", tmp_path / "in" / f"{100_000 - len(written)}.json")
        os.utime(tmp_path / "in" / f"{100_000 - len(written)}.json")

    args = parser().parse_args(["sample", "-i", at("in"), "-o", at("out"), "-n", "7", "--follow", at("state"), "--every", "once", "--report", "20"])
    for n in (100, 53, 200):
        more(n)
        more(11)
        run(spark, args)
    ids = [json.loads(r.value)["id"] for r in spark.read.text(at("out")).collect()]
    own = lambda name: [k for k in range(len(written)) if ("ab"[k % 3 == 0]) == name]
    assert sorted(ids) == sorted(own("a")[6::7] + own("b")[6::7])
    assert {r["key"]: r["n"] for r in streams.key_counts(spark, at("state")).collect()} == {n: len(own(n)) for n in "ab"}


def test_counts_are_told_while_a_sample_runs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(5):
        (tmp_path / "in" / f"{k}").write_text("\n".join(f"line {j}" for j in range(40)))
    lines = streams.with_arrival(spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in"))).withColumn("k", F.col("value").endswith("7"))
    query = streams.follow(streams.sample_lines(lines, 2, "k", streams.ARRIVAL), str(tmp_path / "out"), str(tmp_path / "state"), None)
    told = []
    streams.report_counts(spark, query, str(tmp_path / "state"), 30, told.append)
    assert told[-1] == {False: 180, True: 20} and all(sum(t.values()) % 40 == 0 for t in told)


def test_registered_query_equals_the_batch_one(spark):
    sf = "/root/testdata/sf0.001"
    got = catalogue.QUERIES["stream_every_nth"](spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, catalogue.QUERIES["every_nth_per_name"](spark, sf).collect()))


def test_an_empty_source_gives_no_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("seq long, name string").parquet(str(tmp_path / "in"))
    assert streams.drain(stream).count() == 0 and streams.drain(stream).columns == ["seq", "name"]
    assert streams.every_nth_per_key(stream, 5, "name", "seq").count() == 0


def test_following_a_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text("one\ntwo\nthree\n")
    told = []
    query = streams.follow(spark.readStream.text(str(tmp_path / "in")).where("value <> 'two'"), str(tmp_path / "out"), str(tmp_path / "state"), "1 second", told.append)
    query.processAllAvailable()
    (tmp_path / "in" / "b").write_text("four\n")
    query.processAllAvailable()
    query.stop()
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["four", "one", "three"]
    for _ in range(100):
        if sum(p["rows"] for p in told) == 4:
            break
        time.sleep(0.1)
    assert sum(p["rows"] for p in told) == 4


def test_a_cluster_without_a_shared_folder_is_refused():
    class Session:
        class sparkContext:
            master = "spark://somewhere:7077"
            getCheckpointDir = staticmethod(lambda: None)

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        folders.shared_dir(Session())
