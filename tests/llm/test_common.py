from pathlib import Path

import pytest
from pyspark.sql import functions as F

from terragrain.llm import common


def test_split_join_equals_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    many = spark.range(500).selectExpr("id", "if(id % 3 = 0, 0, id % 50) AS k", "if(id % 11 = 0, NULL, id % 2) AS l")
    one = many.select("k", "l").distinct().where("k < 40").withColumn("v", F.col("k") * 10)
    hot = common.hot_keys(many.groupBy("k", "l").agg(F.count(F.lit(1)).alias("n")), ["k", "l"])
    assert hot is not None and hot.count() < 20
    for how in ("inner", "left"):
        wanted = many.join(one, ["k", "l"], how)
        got = common.split_join(many, one, ["k", "l"], "id", hot, how)
        assert sorted(map(repr, got.select(wanted.columns).collect())) == sorted(map(repr, wanted.collect()))
    assert common.hot_keys(many.groupBy("id").agg(F.count(F.lit(1)).alias("n")), ["id"]) is None


def test_scratch_deletes_what_nobody_keeps(spark):
    with common.scratch(spark):
        with common.scratch(spark):
            inner = common.materialise(spark.range(3), "inner")
            kept = common.keep(inner.where("id > 0"), "kept")
            gone = Path(inner.inputFiles()[0].removeprefix("file://")).parent
        assert not gone.exists()
        assert kept.count() == 2
        held = Path(kept.inputFiles()[0].removeprefix("file://")).parent
    assert not held.exists()


def test_recent_stays_within_its_budget():
    made = []
    recent = common.Recent(lambda keys: made.extend(keys) or [k * 2 for k in keys], budget=3000)
    for k in range(200):
        keys = {str(k), str(k // 2), "always"}
        found = recent.holding(keys)
        assert {q: found[q] for q in keys} == {q: q * 2 for q in keys}
        assert len(recent.newer) + len(recent.older) < 50
    assert made.count("always") == 1


def test_a_cluster_without_a_shared_folder_is_refused(spark):
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
