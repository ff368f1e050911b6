import pytest

from terragrain.operators import density
from terragrain.streaming import grids

RESOLUTIONS = (180, 250, 360)


def places(spark, low, high):
    return spark.range(low, high).selectExpr("id % 41 * 4.5D - 90 AS lat", "id % 37 * 9.7D - 180 AS lon")


def counted(df):
    return sorted(map(tuple, df.select("res", "x", "y", "cnt").collect()))


def test_increments_count_once_and_leave_the_grid_alone(spark, tmp_path):
    grid = grids.Grid(spark, str(tmp_path / "grid"), RESOLUTIONS)
    assert grid.counts().count() == 0 and grid.parts() == []
    for k in range(19):
        before = set(grid.parts())
        assert grid.add(places(spark, k * 50, k * 50 + 50), k)
        if k % grids.MERGED != grids.MERGED - 1:
            assert before <= set(grid.parts())  # nothing that was there is written again
        assert not grid.add(places(spark, k * 50, k * 50 + 50), k)
        assert not grid.add(places(spark, 0, 500), k // 2)
    assert grid.parts() == [(1, 0, 7), (1, 8, 15), (0, 16, 16), (0, 17, 17), (0, 18, 18)]
    assert counted(grid.counts()) == counted(density.histogram(places(spark, 0, 950), RESOLUTIONS))


def test_what_was_broken_off_changes_nothing(spark, tmp_path):
    grid = grids.Grid(spark, str(tmp_path / "grid"), RESOLUTIONS)
    grid.add(places(spark, 0, 60), 3)
    half = tmp_path / "grid" / "0-4-4"  # an increment without its mark
    places(spark, 0, 10).selectExpr("180 AS res", "1 AS x", "1 AS y", "5L AS cnt").write.parquet(str(half))
    (half / "_SUCCESS").unlink()
    assert counted(grid.counts()) == counted(density.histogram(places(spark, 0, 60), RESOLUTIONS))
    assert grid.add(places(spark, 60, 100), 4)
    grid._write(grid._summed(grid.parts()), (1, 3, 4))  # a merge whose parts weren't deleted any more
    assert grid.parts() == [(1, 3, 4)]
    assert counted(grid.counts()) == counted(density.histogram(places(spark, 0, 100), RESOLUTIONS))


@pytest.mark.parametrize("most", [1, 3])
def test_a_stream_that_is_started_again(spark, tmp_path, most):
    grid = grids.Grid(spark, str(tmp_path / "grid"), RESOLUTIONS)
    for k in range(3):
        places(spark, k * 90, k * 90 + 90).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("lat double, lon double").option("maxFilesPerTrigger", most).parquet(str(tmp_path / "in"))
        grid.follow(stream, str(tmp_path / "state"), None).awaitTermination()
        assert counted(grid.counts()) == counted(density.histogram(places(spark, 0, k * 90 + 90), RESOLUTIONS))
