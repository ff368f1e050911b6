import math
import struct

import pytest
from pyspark.sql import functions as F

from terragrain.functions import display
from terragrain.operators import density, mesh, sampling, smooth, zones
from terragrain.sources import features, report, shapefile
from terragrain.sources.states import states


def test_every_nth_per_key_and_over_all(spark):
    df = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(14)], "seq long, name string")
    assert sorted(r.seq for r in sampling.every_nth(df, 3, "seq", ["name"], span=4).collect()) == [4, 5, 10, 11]
    assert sorted(r.seq for r in sampling.every_nth(df, 5, "seq", span=3).collect()) == [4, 9]
    with pytest.raises(ValueError):
        sampling.every_nth(df, 0, "seq")
    assert sampling.every_nth(df.limit(0), 2, "seq", ["name"]).count() == 0


def test_blur_wraps_in_x_repeats_in_y_and_keeps_mass(spark):
    width, height, sigma = 60, 30, 0.5
    weights = smooth.kernel(sigma, width)
    half = len(weights) // 2
    cells = {(0, 0): 5.0, (59, 29): 2.0, (30, 15): 7.0}
    got = {(r.x, r.y): r.v for r in smooth.blur(spark.createDataFrame([(x, y, int(v)) for (x, y), v in cells.items()], "x int, y int, cnt long"), sigma, width, height).collect()}
    for x in range(width):
        for y in range(height):
            wanted = sum(
                cells.get(((x + i - half) % width, min(height - 1, max(0, y + j - half))), 0.0) * weights[i] * weights[j] for i in range(len(weights)) for j in range(len(weights))
            )
            assert got.get((x, y), 0.0) == pytest.approx(wanted, abs=1e-12)
    assert math.isclose(sum(weights), 1.0)
    assert smooth.kernel(0.1, 100) is None
    one = spark.createDataFrame([(1, 1, 4)], "x int, y int, cnt long")
    assert [tuple(r) for r in smooth.blur(one, 0.1, 100, 50).collect()] == [(1, 1, 4.0)]


def test_zones_with_holes_shared_edges_and_outside(spark):
    square = lambda a, b, c, d: [[a, b], [c, b], [c, d], [a, d]]
    rings = spark.createDataFrame([("A", 0, square(0.0, 0.0, 4.0, 4.0)), ("A", 1, square(1.0, 1.0, 2.0, 2.0)), ("A", 2, square(4.0, 0.0, 8.0, 4.0)), ("B", 0, square(8.0, 0.0, 9.0, 4.0))], "zone string, ring int, points array<array<double>>")
    points = spark.createDataFrame([(0.5, 0.5), (1.5, 1.5), (4.0, 1.0), (8.0, 1.0), (8.5, 3.0), (20.0, 1.0), (0.5, 0.5), (1.0, 5.0)], "lon double, lat double")
    assert zones.zone_counts(points, zones.edges(rings.limit(0))).count() == 0
    assert {r.zone: r.points for r in zones.zone_counts(points, zones.edges(rings)).collect()} == {"A": 3, "B": 2}


def test_decimation(spark):
    line = lambda n: [[float(k), 0.0] for k in range(n)]
    rings = spark.createDataFrame([(3, line(3)), (4, line(4)), (200, line(200))], "ring int, points array<array<double>>")
    got = {r.ring: [p[0] for p in r.line] for r in zones.decimate(rings, 80).collect()}
    assert got == {4: [0, 1, 2, 3], 200: list(range(0, 200, 2))}


def test_what_points_are_made_of_is_worked_out_once_a_ring(spark):
    """Points that are computed, as the ring's number many; each is made once, not once for every point that is looked at."""
    made = spark.range(3, 303).select(F.col("id").alias("ring"), F.transform(F.sequence(F.lit(1), F.col("id")), lambda k: F.array(F.cbrt(k.cast("double")), F.lit(0.0))).alias("points"))
    lines = mesh.ring_on_sphere(zones.decimate(made, 80), 1.5)
    got = {r.ring: len(r.positions) for r in lines.collect()}
    assert got == {n: -(-n // max(1, n // 80)) for n in range(4, 303)}
    plan = lines.select("ring", F.explode("positions").alias("p"))._jdf.queryExecution().optimizedPlan().toString().upper()
    assert plan.count("CBRT(") == 1 and plan.count("SIN(") == 2  # height and depth


def test_colours_and_labels(spark):
    z = spark.createDataFrame([(-1.0,), (0.0,), (0.075,), (0.15,), (1.0,), (2.0,)], "z double").select(display.colour(F.col("z")).alias("c"))
    assert [tuple(r.c) for r in z.collect()] == [(40, 60, 100), (40, 60, 100), (50, 80, 130), (60, 100, 160), (255, 255, 200), (255, 255, 200)]
    n = spark.createDataFrame([(999,), (1000,), (1_260_000,)], "n long").select(display.human_count(F.col("n")).alias("a"))
    assert [r.a for r in n.collect()] == ["999", "1.0k", "1.3M"]
    zoom = spark.createDataFrame([(400.0,), (0.05,), (0.0001,)], "s double").select(display.zoom_for(F.col("s")).alias("z"))
    assert [r.z for r in zoom.collect()] == [12, 13, 18]


def test_mesh_of_one_cell(spark):
    cells = spark.createDataFrame([(0, 0, 1.0)], "x int, y int, z double")
    globe = mesh.globe_vertices(cells, 4, 2, 0.5).collect()
    assert len(globe) == 8 and {round(math.dist((0, 0, 0), (r.px, r.py, r.pz)), 6) for r in globe} == {1.001, 1.5}
    plane = mesh.plane_vertices(cells, 4, 2, 0.5, 0.5).collect()
    assert {r.pz for r in plane} == {0.0, 2.0} and {r.px for r in plane} == {-4.0, -2.0}
    assert mesh.triangles(cells).count() == 10


def test_tiles_cover_their_box(spark):
    boxes = density.local_boxes(spark.createDataFrame([(1, 45.0, 7.0)], "rank int, lat double, lon double"), 5.0)
    got = mesh.tiles(boxes, F.lit(12)).collect()
    assert min(r.left for r in got) <= 0 and max(r.left + r.width for r in got) >= 1
    assert min(r.top for r in got) <= 1e-9 and max(r.top + r.height for r in got) >= 1 - 1e-9


def test_features_flatten_and_survive_the_table(spark, tmp_path):
    lines = [
        '{"geometry":{"coordinates":[1.5,2]},"properties":{"b":"tab\\there","a":1}}',
        '{"geometry":{"coordinates":["3",4]},"properties":{"c":{"d":[1]},"lat":9,"q":"say \\"hi\\"\\nthere"}}',
        '{"geometry":null,"properties":{"z":1}}', '{"geometry":{"coordinates":[1,2]},"properties":null}', "[1]", "", "broken",
    ]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(lines)], "seq long, value string")
    parsed = features.parse_features(df)
    flat = features.flatten(parsed, "seq")
    assert flat.columns == ["lat", "lon", "b", "a", "c", "q"]
    assert tuple(features.line_counts(df).first()) == (7, 2)
    features.write_tsv(flat.coalesce(1), str(tmp_path / "t"))
    back = spark.read.option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(str(tmp_path / "t"))
    assert {(r.b, r.c, r.q) for r in back.collect()} == {("tab\there", None, None), (None, '{"d":[1]}', 'say "hi"\nthere')}
    assert sorted(r.lat for r in features.read_tsv(spark, str(tmp_path / "t")).collect()) == ["2.0", "4.0"]


def test_columns_come_as_first_seen_whatever_their_names(spark):
    at = '"geometry":{"coordinates":[1,2]}'
    lines = [
        f'{{{at},"properties":{{"zeta":1,"alpha":true,"mid":null}}}}', f'{{{at}}}', f'{{{at},"properties":{{}}}}', f'{{{at},"properties":{{"it\'s":1.50,"a.b":"x","$[0]":[1, 2]}}}}',
        f'{{{at},"properties":[1]}}', f'{{{at},"properties":{{"alpha":1}}', f'[{{{at},"properties":{{"late":1}}}}]', '{"geometry":{"coordinates":[1]},"properties":{"late":1}}', '{"geometry":{"coordinates":[1,"north"]},"properties":{"late":1}}',
    ]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(lines)], "seq long, value string")
    flat = features.flatten(features.parse_features(df), "seq")
    assert flat.columns == ["lat", "lon", "zeta", "alpha", "mid", "it's", "a.b", "$[0]"]
    assert sorted(tuple(r) for r in flat.fillna("-").collect()) == sorted([(2.0, 1.0, "1", "true", "-", "-", "-", "-"), (2.0, 1.0, *["-"] * 6), (2.0, 1.0, *["-"] * 6), (2.0, 1.0, "-", "-", "-", "1.5", "x", "[1,2]")])
    assert tuple(features.line_counts(df).first()) == (9, 4)


def test_arrival_follows_files_and_lines(spark, tmp_path):
    for name in ("b", "a"):
        (tmp_path / f"{name}.txt").write_text("\n".join(f"{name}{k:04d}" for k in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    got = [r.value for r in features.with_arrival(features.read_lines(spark, str(tmp_path))).orderBy("_at").collect()]
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted(got) and len(got) == 6000


def test_strict_and_lenient_reading(spark, tmp_path):
    good = '{"type":"Feature","id":1,"geometry":{"type":"Point","coordinates":[1.0,2.0]},"properties":{"Accuracy":3.5,"Time":"2019-03-02T07:30:00.250Z"}}'
    (tmp_path / "in.json").write_text(good + "\n" + '{"id": "x"}' + "\n")
    assert features.read_features(spark, str(tmp_path / "in.json"), strict=False).where("id = 1").first().properties.Accuracy == 3.5
    with pytest.raises(Exception):
        features.read_features(spark, str(tmp_path / "in.json")).collect()
    features.write_features(features.read_features(spark, str(tmp_path / "in.json"), strict=False), str(tmp_path / "out"))
    assert '"Notes":null' in features.read_lines(spark, str(tmp_path / "out")).first().value


def _shape(points, kind=5):
    x, y = [p[0] for p in points], [p[1] for p in points]
    body = struct.pack("<i4dii", kind, min(x), min(y), max(x), max(y), 1, len(points)) + struct.pack("<i", 0) + b"".join(struct.pack("<2d", *p) for p in points)
    return body


def test_shapefile(spark, tmp_path):
    rings = [[(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (0.0, 0.0)], [(5.0, 5.0), (5.0, 6.0), (6.0, 6.0), (5.0, 5.0)]]
    records = b"".join(struct.pack(">ii", k + 1, len(_shape(r)) // 2) + _shape(r) for k, r in enumerate(rings))
    (tmp_path / "a.shp").write_bytes(b"\0" * 100 + records)
    head = struct.pack("<BBBBIHH", 3, 0, 0, 0, 2, 65, 3).ljust(32, b"\0") + b"FIPS".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([2, 0]) + b"\0" * 14 + b"\r"
    (tmp_path / "a.dbf").write_bytes(head + b" 01" + b" 48")
    got = shapefile.read_rings(spark, str(tmp_path / "a.shp")).orderBy("record").collect()
    assert [(r.record, r.ring, r.kind, r.attributes["FIPS"], tuple(map(tuple, r.points))) for r in got] == [(0, 0, 5, "01", tuple(rings[0])), (1, 0, 5, "48", tuple(rings[1]))]


def write_shapes(folder, rings, codes):
    """A shapefile of one ring a record, with the attribute FIPS."""
    records = b"".join(struct.pack(">ii", k + 1, len(_shape(r, kind)) // 2) + _shape(r, kind) for k, (kind, r) in enumerate(rings))
    (folder / "b.shp").write_bytes(b"\0" * 100 + records)
    head = struct.pack("<BBBBIHH", 3, 0, 0, 0, len(codes), 65, 3).ljust(32, b"\0") + b"FIPS".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([2, 0]) + b"\0" * 14 + b"\r"
    (folder / "b.dbf").write_bytes(head + b"".join(b" " + c.encode().rjust(2) for c in codes))
    return str(folder / "b.shp")


def test_boundaries_and_zones_from_a_shapefile(spark, tmp_path):
    square = lambda a, b, c, d: [(a, b), (a, d), (c, d), (c, b), (a, b)]
    path = write_shapes(tmp_path, [(5, square(-90.0, 40.0, -88.0, 42.0)), (5, square(-88.0, 40.0, -87.0, 42.0)), (5, square(-150.0, 60.0, -140.0, 65.0)), (3, square(0.0, 0.0, 1.0, 1.0)), (5, square(-80.0, 30.0, -79.0, 31.0))], ["1", "1", "2", "1", "48"])
    rings = shapefile.read_rings(spark, path)
    lines = zones.boundary_lines(rings, 80, "FIPS").collect()
    assert sorted(r.record for r in lines) == [0, 1, 2, 4]  # a code that isn't padded is no skipped one
    assert sorted(r.record for r in zones.boundary_lines(shapefile.read_first(spark, ["/nowhere.shp", path]), 80).collect()) == [0, 1, 2, 4]
    own = zones.zone_rings(rings, "FIPS", states(spark))
    assert sorted(r.zone for r in own.collect()) == ["01", "01", "48"]
    points = spark.createDataFrame([(-89.0, 41.0), (-88.0, 41.0), (-87.5, 41.5), (-79.5, 30.5), (-145.0, 61.0)], "lon double, lat double")
    assert {r.zone: r.points for r in zones.zone_counts(points, zones.edges(own)).collect()} == {"01": 3, "48": 1}
    assert {r.zone: r.n for r in zones.by_bands(points.withColumn("n", F.lit(1)), zones.edges(own)).groupBy("zone").agg(F.sum("n").alias("n")).collect()} == {"01": 3, "48": 1}
    on_sphere = mesh.ring_on_sphere(zones.boundary_lines(rings, 80), 2.0).select(F.explode("positions").alias("p")).select("p.*").collect()
    assert len(on_sphere) == 20 and all(math.isclose(math.dist((0, 0, 0), (p.px, p.py, p.pz)), 2.0) for p in on_sphere)


def test_a_sample_by_key_is_the_same_however_rows_are_dealt(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "seq")
    kept = sampling.fraction(rows, 0.1, key="seq")
    assert abs(kept.count() - 2000) < 200
    assert sorted(kept.collect()) == sorted(sampling.fraction(rows.repartition(5), 0.1, key="seq").collect())


def test_report_round_trip(spark):
    points = spark.createDataFrame([(10.0, 50.0)] * 5 + [(11.5, 51.0)] * 3 + [(999.0, 0.0)], "lon double, lat double")
    doc = report.load_page(report.page(report.document(points, [180, 360], n_peaks=2, radius_km=100.0, local_resolution=10)))
    assert doc["total_points"] == 8 and [p["cnt"] for p in doc["peaks"]] == [5, 3]
    assert doc["histograms"]["180"]["sum"] == 8.0 and doc["histograms"]["360"]["shape"] == [360, 180]
    assert [v["total_points"] for v in doc["local_views"]] == [8, 3]  # the first box holds both places
    assert doc["shown_resolution"] == 180 and [c["z"] for c in doc["shown"]] == [1.0]
    line = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]],)], "line array<array<float>>")
    doc = report.load_page(report.page(report.document(points, [360], boundaries=line)))
    assert doc["boundaries"] == [[[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]]]
    assert [c["z"] for c in doc["shown"]] == [1.0, round((math.log(4) / math.log(6)) ** 2, 4)]
    doc = report.load_page(report.page(report.document(points, [360], sigma=0.1, power=1.0)))
    assert len(doc["shown"]) > 2 and max(c["z"] for c in doc["shown"]) == 1.0


def test_a_full_grid_comes_in_small_rows_and_back(spark, monkeypatch):
    """All cells of resolution 8640 are full: rows stay below 16 MB; and a smaller page reads the same back."""
    whole = spark.range(0, 1, 1, 1).select(F.explode(F.sequence(F.lit(0), F.lit(255))).alias("x")).select(F.lit(8640).alias("res"), (F.col("x") + 8192).alias("x"), F.explode(F.sequence(F.lit(4096), F.lit(4319))).alias("y"), F.lit(10**12).alias("cnt"))
    tile = density.payload_tiles(whole).select(F.length(F.to_json(F.struct("*"))).alias("n")).collect()
    assert len(tile) == 1 and tile[0]["n"] < 16 << 20
    assert 8640 // density.TILE * (4320 // density.TILE) < 600  # full tiles of the whole grid, each a row like that one
    monkeypatch.setattr(density, "TILE", 8)
    points = spark.range(720).selectExpr("id % 24 * 15.0D - 172.5D AS lon", "id % 12 * 15.0D - 82.5D AS lat")
    doc = report.load_page(report.page(report.document(points, [24, 48], n_peaks=1, local_resolution=4)))
    counted = {}
    for r in density.histogram(points, [24, 48]).collect():
        counted.setdefault(str(r["res"]), []).append(([r["x"], r["y"]], r["cnt"]))
    for res, cells in counted.items():
        got = doc["histograms"][res]
        assert list(zip(got["indices"], got["values"], strict=True)) == sorted(cells)


def test_states(spark):
    assert states(spark).count() == 49


def test_exact_samples(spark, monkeypatch):
    monkeypatch.setattr(sampling, "RANGE_ROWS", 20)
    monkeypatch.setattr(sampling, "RANGE_BITS", 4)
    rows = [(k if k % 50 else None, ["a", "b", None][k % 7 % 3], k // 2) for k in range(3000)] + [(k, f"few{k % 3}", 0) for k in range(20)]
    df = spark.createDataFrame(rows, "key long, kind string, other long")
    for share in (0.0, 0.1, 0.333, 1.0):
        sizes = {}
        for _, kind, _ in rows:
            sizes[kind] = sizes.get(kind, 0) + 1
        found = [sampling.exact_fraction(df.repartition(n), share, "key", ["kind"]).collect() for n in (1, 5)]
        assert sorted(found[0], key=repr) == sorted(found[1], key=repr)
        taken = {}
        for r in found[0]:
            taken[r["kind"]] = taken.get(r["kind"], 0) + 1
        assert taken == {k: math.floor(n * share) for k, n in sizes.items() if math.floor(n * share)}
        assert sampling.exact_fraction(df, share, "key").count() == math.floor(len(rows) * share)
    assert sampling.exact_fraction(df.limit(0), 0.5, "key").count() == 0 and sampling.exact_fraction(df.limit(0), 0.5, "key", ["kind"]).count() == 0
