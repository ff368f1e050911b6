"""Shapefiles in pieces: several tasks a file, records whole, with and without an index."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from terragrain.sources import shapefile


def shape(kind, rings):
    points = [p for r in rings for p in r]
    if kind not in shapefile.RING_TYPES:
        return struct.pack("<i2d", kind, 1.0, 2.0) if kind else struct.pack("<i", 0)
    starts = [sum(map(len, rings[:k])) for k in range(len(rings))]
    return struct.pack("<i4dii", kind, 0, 0, 0, 0, len(rings), len(points)) + struct.pack(f"<{len(rings)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)


def write(stem, shapes, index=True, table=True, order=None):
    """A shapefile of (kind, rings); ``order`` is how the records lie in the .shp."""
    bodies = [shape(*s) for s in shapes]
    places, at, data = {}, 100, b""
    for k in order or range(len(bodies)):
        places[k] = at
        data += struct.pack(">ii", k + 1, len(bodies[k]) // 2) + bodies[k]
        at += 8 + len(bodies[k])
    stem.with_suffix(".shp").write_bytes(b"\0" * 100 + data)
    if index:
        stem.with_suffix(".shx").write_bytes(b"\0" * 100 + b"".join(struct.pack(">ii", places[k] // 2, len(b) // 2) for k, b in enumerate(bodies)))
    if table:
        fields = b"FIPS".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([4]) + b"\0" * 15 + b"NAME".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([6]) + b"\0" * 15
        head = struct.pack("<BBBBIHH", 3, 0, 0, 0, len(bodies), 32 + len(fields) + 1, 11).ljust(32, b"\0") + fields + b"\r"
        stem.with_suffix(".dbf").write_bytes(head + b"".join(b" " + f"{k % 60:04d}".encode() + f"n{k}".encode().ljust(6) for k in range(len(bodies))))
    return f"{stem}.shp"


def some_shapes(n, seed=1):
    """Polygons with one to three rings of very different lengths, points and empty shapes between them."""
    dice = random.Random(seed)
    kinds = [5, 3, 15, 13, 0, 1]
    return [(kinds[k % 6], [[(dice.uniform(-180, 180), dice.uniform(-90, 90)) for _ in range(4 + 2000 * (k % 17 == 0) + k % 5)] for _ in range(1 + k % 3)]) for k in range(n)]


def wanted(shapes, table=True):
    return sorted(
        (k, g, kind, tuple(ring), (("FIPS", f"{k % 60:04d}"), ("NAME", f"n{k}")) if table else ())
        for k, (kind, rings) in enumerate(shapes)
        if kind in shapefile.RING_TYPES
        for g, ring in enumerate(rings)
    )


def got(rings):
    return sorted((r.record, r.ring, r.kind, tuple(map(tuple, r.points)), tuple(sorted(r.attributes.items()))) for r in rings.collect())


@pytest.mark.parametrize("piece", [1, 1000, 40_000, 1 << 30])
def test_any_pieces_give_the_same_rings(spark, tmp_path, piece):
    shapes = some_shapes(60)
    rings = shapefile.read_rings(spark, write(tmp_path / "a", shapes), piece)
    assert got(rings) == wanted(shapes)
    tasks = rings.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks == 1 if piece == 1 << 30 else tasks > 1


def test_small_reads_and_records_out_of_order(spark, tmp_path, monkeypatch):
    shapes = some_shapes(40, seed=2)
    order = random.Random(3).sample(range(40), 40)
    path = write(tmp_path / "a", shapes, order=order)
    assert got(shapefile.read_rings(spark, path, 5000)) == wanted(shapes)
    monkeypatch.setattr(shapefile, "READ_BYTES", 100)
    reader = shapefile.RingReader(path, 5000)
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert sorted((r["record"], r["ring"], r["kind"], tuple(map(tuple, r["points"])), tuple(r["attributes"])) for r in rows) == wanted(shapes)


def test_without_index_or_table(spark, tmp_path):
    shapes = some_shapes(30)
    path = write(tmp_path / "a", shapes, index=False, table=False)
    rings = shapefile.read_rings(spark, path.removesuffix(".shp"), 100)
    assert got(rings) == wanted(shapes, table=False) and rings.rdd.getNumPartitions() == 1
    assert got(shapefile.read_rings(spark, "file://" + write(tmp_path / "b", shapes, index=False))) == wanted(shapes)


def test_empty_missing_and_several_files(spark, tmp_path):
    assert got(shapefile.read_rings(spark, write(tmp_path / "none", []))) == []
    with pytest.raises(FileNotFoundError):
        shapefile.read_rings(spark, str(tmp_path / "missing.shp"))
    one, two = some_shapes(10, seed=4), some_shapes(20, seed=5)
    write(tmp_path / "x1", one)
    write(tmp_path / "x2", two)
    assert got(shapefile.read_rings(spark, f"{tmp_path}/x*.shp", 500)) == sorted(wanted(one) + wanted(two))
