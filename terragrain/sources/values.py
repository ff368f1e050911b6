"""JSON values wherever they stand in files: several on a line, or one over many lines.

Files are cut before every opening brace, by Spark's own reader and at any split size, so a file
without line ends is read in parts too. What a block of a file does to the reader's state is worked
out without knowing where it starts: whether a string is left open, and how much deeper it gets, if it
starts inside or outside a string. A prefix over the blocks, of which the driver holds a row each as it
does of the files, gives every block its start, and a second pass puts values together. Only values
that lie over the borders of blocks are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Blocks whose starts are sent to every task; with more, they are joined as a table of their own.
FEW_BLOCKS = 100_000

_PLACE = ["_file", "_start"]
_MARK = re.compile(r'\\.|["{}\[\]]', re.DOTALL)


def _texts(batches: Iterable[pa.RecordBatch], *more: str) -> Iterator[tuple[bool, str, list]]:
    """Per piece: whether a block starts here, its text with the brace that it was cut at, and its other columns."""
    block = None
    for batch in batches:
        for text, file, start, *rest in zip(*(batch.column(n).to_pylist() for n in ("value", *_PLACE, *more)), strict=True):
            new = (file, start) != block
            block = (file, start)
            # What stands before a file's first brace has none.
            yield new, text if new and start == 0 else "{" + text, [file, start, *rest]


def outside_strings(text: str, inside: bool) -> tuple[str, bool]:
    """What of a text stands outside strings, if it starts inside or outside one, and whether it ends inside."""
    if "\\" in text:
        text = re.sub(r"\\.", "", text, flags=re.DOTALL)
    parts = text.split('"')
    return "".join(parts[int(inside) :: 2]), inside ^ (len(parts) % 2 == 0)


def _summaries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block: whether it turns outside to inside, and how much deeper it gets if it starts outside, and inside."""
    schema = pa.schema([("_file", pa.string()), ("_start", pa.int64()), ("turns", pa.bool_()), ("deeper", pa.int64()), ("deeper_inside", pa.int64())])
    place: list = []
    state, deeper = [False, True], [0, 0]

    def summary() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, (*place, state[0], *deeper), strict=True))], schema=schema)

    for new, text, at in _texts(batches):
        if new:
            if place:
                yield summary()
            place, state, deeper = at, [False, True], [0, 0]
        for k in (0, 1):
            plain, state[k] = outside_strings(text, state[k])
            deeper[k] += plain.count("{") + plain.count("[") - plain.count("}") - plain.count("]")
    if place:
        yield summary()


def _assemble(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The values of a block in order; the first and the last may be parts, which say whether they begin and end here."""
    schema = pa.schema([("value", pa.string()), ("_file", pa.string()), ("_at", pa.int64()), ("begins", pa.bool_()), ("ends", pa.bool_())])
    out: list[tuple] = []
    held: list[str] = []
    file, number, begins, inside, depth = None, 0, True, False, 0

    def emit(ends: bool) -> None:
        nonlocal number, begins
        text = "".join(held)
        if not (begins and ends) or text.strip():
            out.append((text, file, number, begins, ends))
            number += 1
        held.clear()
        begins = True

    def rows() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        out.clear()
        return made

    for new, text, (file_, _, inside_, depth_, block) in _texts(batches, "inside", "depth", "block"):
        if new:
            if held:
                emit(False)
            file, number, inside, depth = file_, block << 33, inside_, max(depth_, 0)
            begins = not (inside or depth)
        at = 0
        for mark in _MARK.finditer(text):
            c = mark[0]
            if c == '"':
                inside = not inside
            elif inside or len(c) > 1:
                continue
            elif c in "{[":
                depth += 1
            else:
                depth = max(depth - 1, 0)
                if not depth:
                    held.append(text[at : mark.end()])
                    emit(True)
                    at = mark.end()
        held.append(text[at:])
        if not (inside or depth):  # what stands between lists and objects
            emit(True)
        if len(out) >= 1000:
            yield rows()
    if held:
        emit(False)
    if out:
        yield rows()


def _numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    so_far = 0
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(range(so_far, so_far + batch.num_rows), pa.int64())], names=[*batch.schema.names, "_row"])
        so_far += batch.num_rows


def _starts(spark: SparkSession, blocks: list) -> DataFrame:
    """Per block, in the order of files and places: its number, and whether and how deep it starts inside a string or value."""
    rows, file, inside, depth = [], None, False, 0
    for number, b in enumerate(sorted(blocks, key=lambda b: (b["_file"], b["_start"]))):
        if b["_file"] != file:
            file, inside, depth = b["_file"], False, 0
        rows.append((file, b["_start"], inside, depth, number))
        depth += b["deeper_inside"] if inside else b["deeper"]
        inside ^= b["turns"]
    return spark.createDataFrame(rows, "_file string, _start long, inside boolean, depth long, block long")


def read_values(spark: SparkSession, path: str) -> DataFrame:
    """(value, _at): the text of every JSON value in the files; ``_at`` grows with its place, and with the files' paths.

    What stands between objects and lists, but for white space, is a value of its own, and so is what
    a file's end cuts off: it may be none, and then doesn't parse. A compressed file is one block.
    """
    pieces = spark.read.option("lineSep", "{").text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    blocks = pieces.mapInArrow(_summaries, "_file string, _start long, turns boolean, deeper long, deeper_inside long").collect()
    starts = _starts(spark, blocks)
    if len(blocks) <= FEW_BLOCKS:  # beside a broadcast, pieces stay in their order
        placed = pieces.join(F.broadcast(starts), _PLACE)
    else:
        placed = pieces.mapInArrow(_numbered, "value string, _file string, _start long, _row long").join(starts, _PLACE).sortWithinPartitions(*_PLACE, "_row").drop("_row")
    parts = placed.mapInArrow(_assemble, "value string, _file string, _at long, begins boolean, ends boolean")
    # Parts of one value follow each other; those that begin one are counted.
    number = F.count_if("begins").over(Window.partitionBy("_file").orderBy("_at"))
    broken = parts.where("NOT (begins AND ends)").withColumn("number", number).groupBy("_file", "number").agg(F.sort_array(F.collect_list(F.struct("_at", "value"))).alias("parts"))
    joined = broken.select(F.array_join("parts.value", "").alias("value"), F.col("parts")[0]["_at"].alias("_at"))
    return parts.where("begins AND ends").select("value", "_at").unionByName(joined)
