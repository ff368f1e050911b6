"""Polygon and polyline shapefiles (.shp with .shx and .dbf) as rings.

A Python data source: the .shx index says where every record lies, so a file is read by several
tasks, a range of records each, and the same range of the .dbf table's rows, which have one width.
Files are opened where they lie, on any store that pyarrow knows by its URI.
"""

from __future__ import annotations

import fnmatch
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The shape types that hold rings, with and without z.
RING_TYPES = (3, 5, 13, 15)
RINGS = "record int, ring int, kind int, points array<array<double>>, attributes map<string,string>"
#: Bytes of a .shp file that one task reads, about, and bytes of records that it reads at once.
PIECE_BYTES, READ_BYTES = 4 << 20, 1 << 20

_SCHEMA = pa.schema([("record", pa.int32()), ("ring", pa.int32()), ("kind", pa.int32()), ("points", pa.list_(pa.list_(pa.float64()))), ("attributes", pa.map_(pa.string(), pa.string()))])


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _size(path: str) -> int | None:
    """The bytes of a file; None where there is none."""
    store, at = _store(path)
    found = store.get_file_info(at)
    return found.size if found.type == fs.FileType.File else None


def _stems(path: str) -> list[str]:
    """The paths, without their ending, of the .shp files that ``path`` names; it may be a pattern of file names."""
    stem = path.removesuffix(".shp")
    folder, _, name = stem.rpartition("/")
    if not any(c in name for c in "*?["):
        return [stem] if _size(f"{stem}.shp") is not None else []
    store, at = _store(folder or ".")
    found = [f.base_name for f in store.get_file_info(fs.FileSelector(at, allow_not_found=True))]
    return sorted(f"{folder or '.'}/{f.removesuffix('.shp')}" for f in found if fnmatch.fnmatchcase(f, f"{name}.shp"))


def _extents(index: bytes) -> list[tuple[int, int]]:
    """(start, length) in the .shp, in bytes and without its own head, of every record of a part of the .shx."""
    words = np.frombuffer(index, ">i4").astype(np.int64).reshape(-1, 2) * 2
    return [(int(start) + 8, int(length)) for start, length in words]


def _walked(shp: pa.NativeFile, size: int) -> Iterator[bytes]:
    """The records of a file without index, one after another."""
    at = 100
    while at + 12 <= size:
        shp.seek(at)
        length = struct.unpack(">ii", shp.read(8))[1] * 2
        yield shp.read(length)
        at += 8 + length


def _indexed(shp: pa.NativeFile, extents: list[tuple[int, int]]) -> Iterator[bytes]:
    """The records at ``extents``; those that follow one another are read together."""
    k = 0
    while k < len(extents):
        start, last = extents[k][0], k
        while last + 1 < len(extents) and extents[last + 1][0] == sum(extents[last]) + 8 and sum(extents[last + 1]) - start <= READ_BYTES:
            last += 1
        shp.seek(start)
        data = shp.read(sum(extents[last]) - start)
        for at, length in extents[k : last + 1]:
            yield data[at - start : at - start + length]
        k = last + 1


def _attributes(path: str, first: int, count: int | None) -> Iterator[list[tuple[str, str]]]:
    """Rows ``first``, ... of a dBASE table as texts by name; ``count`` of them, or all."""
    size = _size(path)
    if size is None or size < 33:
        return
    store, at = _store(path)
    with store.open_input_file(at) as dbf:
        rows, head, width = struct.unpack_from("<IHH", dbf.read(32), 4)
        described, fields, skip, k = dbf.read(head - 32), [], 1, 0
        while described[k] != 0x0D:
            fields.append((described[k : k + 11].split(b"\0")[0].decode("latin-1"), skip, described[k + 16]))
            skip += described[k + 16]
            k += 32
        end = rows if count is None else min(rows, first + count)
        at_once = max(1, READ_BYTES // max(1, width))
        for row in range(first, end, at_once):
            dbf.seek(head + row * width)
            data = dbf.read(min(at_once, end - row) * width)
            for own in range(0, len(data), width):
                yield [(name, data[own + s : own + s + w].decode("utf-8", "replace").strip()) for name, s, w in fields]


def _rings(record: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """(shape type, starts of the rings and their end, points as x, y, x, ...); no ring for other types."""
    kind = struct.unpack_from("<i", record)[0]
    if kind not in RING_TYPES:
        return kind, np.zeros(1, np.int64), np.zeros(0)
    parts, points = struct.unpack_from("<ii", record, 36)
    starts = np.append(np.frombuffer(record, "<i4", parts, 44), points)
    return kind, starts.astype(np.int64), np.frombuffer(record, "<f8", 2 * points, 44 + 4 * parts)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rings (record, ring, kind, points, attributes) as a batch."""
    flat = np.concatenate([r[3] for r in rows])
    ends = np.cumsum([0, *(len(r[3]) // 2 for r in rows)])
    pairs = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 2), pa.int32()), pa.array(flat, pa.float64()))
    points = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
    numbers = [pa.array([r[k] for r in rows], pa.int32()) for k in range(3)]
    return pa.RecordBatch.from_arrays([*numbers, points, pa.array([r[4] for r in rows], _SCHEMA.field("attributes").type)], schema=_SCHEMA)


@dataclass
class Piece(InputPartition):
    """Records ``first``, ... of a file; ``count`` is None where it has no index."""

    stem: str
    first: int
    count: int | None


class RingReader(DataSourceReader):
    def __init__(self, path: str, piece_bytes: int) -> None:
        self.path, self.piece_bytes = path, piece_bytes

    def partitions(self) -> list[Piece]:
        pieces = []
        for stem in _stems(self.path):
            size, index = _size(f"{stem}.shp") or 0, _size(f"{stem}.shx")
            if index is None:
                pieces.append(Piece(stem, 0, None))
                continue
            records = max(0, index - 100) // 8
            parts = max(1, min(records, -(-size // self.piece_bytes)))
            edges = [records * k // parts for k in range(parts + 1)]
            pieces += [Piece(stem, a, b - a) for a, b in zip(edges, edges[1:]) if b > a]
        return pieces or [Piece("", 0, 0)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        if piece.count == 0:
            return
        store, at = _store(f"{piece.stem}.shp")
        with store.open_input_file(at) as shp:
            if piece.count is None:
                records = _walked(shp, shp.size())
            else:
                with store.open_input_file(at.removesuffix(".shp") + ".shx") as index:
                    index.seek(100 + 8 * piece.first)
                    records = _indexed(shp, _extents(index.read(8 * piece.count)))
            known = _attributes(f"{piece.stem}.dbf", piece.first, piece.count)
            rows, held = [], 0
            for number, record in enumerate(records, piece.first):
                own = next(known, [])
                kind, starts, flat = _rings(record)
                for ring in range(len(starts) - 1):
                    rows.append((number, ring, kind, flat[2 * starts[ring] : 2 * starts[ring + 1]], own))
                    held += len(rows[-1][3])
                    if len(rows) >= 256 or held * 8 >= READ_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
            if rows:
                yield _batch(rows)


class RingSource(DataSource):
    """``spark.read.format("shapefile_rings").load(path)``; option ``pieceBytes``: bytes a task reads, about."""

    @classmethod
    def name(cls) -> str:
        return "shapefile_rings"

    def schema(self) -> str:
        return RINGS

    def reader(self, schema) -> RingReader:
        return RingReader(self.options["path"], int(self.options.get("pieceBytes", PIECE_BYTES)))


def read_rings(spark: SparkSession, path: str, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(record, ring, kind, points, attributes) of the shapefile at ``path`` (without or with .shp).

    Records count from 0 in each file. Without a .shx the file is read by one task, record by record;
    without a .dbf, or beyond its rows, there are no attributes. Shapes without rings give no row.
    """
    if not _stems(path):
        raise FileNotFoundError(path)
    spark.dataSource.register(RingSource)
    return spark.read.format(RingSource.name()).option("pieceBytes", str(piece_bytes)).load(path)


def read_first(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The rings of the first shapefile that exists; none where none does."""
    for path in paths:
        if _stems(path):
            return read_rings(spark, path)
    return spark.createDataFrame([], RINGS)
