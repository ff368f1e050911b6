"""Sum-of-squares packing of documents into fixed-length token sequences.

A document becomes its token ids and an end id; only what is longer than a sequence is cut, into
whole sequences and a remainder. Whole sequences need no packing. Remainders are dealt to shards of a
bounded size, and each shard places every remainder where the sum, over residual gaps, of the
squared number of open bins with that gap becomes smallest. Bins that a shard leaves unfilled are
taken apart and packed again across shards, until one shard remains or nothing is gained.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL_BATCHES, Recent, keep, materialise, remember, scratch, settings, task, text_slices

#: Remainders in one shard, on average: what one task holds.
SHARD_ROWS = 4_096
#: Sequence numbers leave room for so many bins of a shard, and rounds.
MOST_BINS, MOST_ROUNDS = 1 << 20, 1 << 8
#: Bins at least this full stay as they are after a round.
FULL_ENOUGH = 0.995

#: White space on which Python and the tokenizer may not agree.
UNUSUAL_SPACE = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200b\\u2028\\u2029\\u202f\\u205f\\u3000]")
#: White space on which they do.
SPACE = re.compile("[\\x09-\\x0d\\x20]+")
#: Texts whose lower case and composition need no context: printable ASCII, Latin-1 letters and usual white space.
PLAIN = re.compile("[\\x09-\\x0d\\x20-\\x7e\\xc0-\\xff]*")

PIECES = "row_id long, doc_id long, piece int, start long, length long, ids_crc32 long"


class WordEncoder:
    """Token ids of whole texts, by words that are encoded once while they are in use.

    The tokenizer drops white space and never joins across it. A text of plain characters is split by
    the tokenizer's own pattern, and its words go to the tokenizer's model. Of any other text, the
    white-space separated chunks that aren't plain go through the whole tokenizer, with what is white
    space to one of the two only inside them.
    """

    #: Characters of a long text that are looked at together.
    PART = 1 << 20

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs as many tasks as there are cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        rules = json.loads(self.tokenizer.to_str())["pre_tokenizer"]["pretokenizers"]
        # Over plain characters the pattern's classes are short lists.
        plain = [chr(c) for c in range(256) if PLAIN.fullmatch(chr(c))]
        letters, numbers = ("".join(c for c in plain if unicodedata.category(c)[0] == kind) for kind in "LN")
        self.pattern = re.compile(rules[0]["pattern"]["Regex"].replace(r"\p{L}", letters).replace(r"\p{N}", numbers))
        # Byte-level models name a byte by a printable character: its own if it has one, else the next from 256 on.
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.byte_names = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in own)}
        self.known = Recent(self._encode_all, 40 << 20)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _encode_all(self, words: list[str]) -> Iterator[bytes]:
        tokenize, names = self.model.tokenize, self.byte_names
        for w in words:
            if PLAIN.fullmatch(w) and "<|" not in w:
                yield b"".join([t.id.to_bytes(4, "little") for t in tokenize(w if w.isascii() else "".join([names[b] for b in w.encode()]))])
            else:
                yield self._whole(w)

    def _split(self, text: str) -> list[str]:
        """The words of a text, and its chunks that aren't plain."""
        if "<|" not in text and PLAIN.fullmatch(text):
            return self.pattern.findall(text.lower())
        out: list[str] = []
        for chunk in SPACE.split(text) if UNUSUAL_SPACE.search(text) else text.split():
            out += self.pattern.findall(chunk.lower()) if "<|" not in chunk and PLAIN.fullmatch(chunk) else [chunk]
        return out

    def _in_parts(self, text: str) -> Iterator[bytes]:
        """The ids of a long text's parts, which end at white space, so that few of its words are held at a time."""
        at = 0
        while at < len(text):
            gap = SPACE.search(text, at + self.PART)
            end = gap.start() if gap else len(text)
            words = self._split(text[at:end])
            yield b"".join(map(self.known.holding(set(words)).__getitem__, words))
            at = end

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [b"".join(self._in_parts(t)) if len(t) > self.PART else None for t in texts]
        split = [self._split(t) if found is None else () for t, found in zip(texts, out, strict=True)]
        known = self.known.holding(set().union(*split))
        return [b"".join(map(known.__getitem__, words)) if found is None else found for words, found in zip(split, out, strict=True)]


@lru_cache(maxsize=2)
def encoder_for(path: str) -> WordEncoder:
    """The encoder of a Python worker, until another operator's task starts."""
    remember("packing", encoder_for.cache_clear)
    return WordEncoder(path)


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, length: int = 2048, keep_ids: bool = False) -> DataFrame:
    """The pieces of all documents: row_id, doc_id, piece, start, length, ids_crc32 and, if kept, ids.

    Null text is empty, and leaves one piece that holds the end id. ``row_id`` tells repeated rows apart.
    """

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(tokenizer)
        end = np.array([end_id], dtype="<u4").tobytes()
        step = 4 * length
        for part in text_slices(batches):
            out: list[tuple] = []
            texts = [t or "" for t in part.column("text").to_pylist()]
            for row_id, doc_id, ids in zip(part.column("row_id").to_pylist(), part.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                ids += end
                for k, start in enumerate(range(0, len(ids), step)):
                    own = ids[start : start + step]
                    out.append((row_id, doc_id, k, start // 4, len(own) // 4, zlib.crc32(own), *([own] if keep_ids else [])))
            columns = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.binary()] if keep_ids else [])]
            names = ["row_id", "doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
        encoder.known.clear()

    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(task("packing", cut), PIECES + (", ids binary" if keep_ids else ""))


def sum_of_squares(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item, in the given order.

    Putting an item of length s into a bin with gap g takes one bin from gap g and adds one to gap
    g - s, which changes the sum of squares by 2 * (count[g - s] - count[g] + 1); a bin that becomes
    full leaves the sum. Ties go to the smallest gap. A new bin opens only where nothing open fits.
    """
    count = np.zeros(capacity + 1, dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins = np.empty(len(lengths), dtype=np.int64)
    never = np.iinfo(np.int64).max
    made = 0
    for k, s in enumerate(lengths.tolist()):
        if s >= capacity:
            bins[k] = made
            made += 1
            continue
        here = count[s:capacity]
        change = np.where(here > 0, 2 * (count[: capacity - s] - here + 1), never)
        if here[0] > 0:
            change[0] = 1 - 2 * here[0]
        best = int(change.argmin())
        if change[best] == never:
            gap, b = capacity, made
            made += 1
        else:
            gap = s + best
            b = open_bins[gap].pop()
            count[gap] -= 1
        bins[k] = b
        if gap > s:
            open_bins[gap - s].append(b)
            count[gap - s] += 1
    return bins


def _pack_shard(capacity: int):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "row_id"], ascending=[False, True], kind="stable", ignore_index=True)
        bins = sum_of_squares(rows["length"].to_numpy(), capacity)
        order = np.argsort(bins, kind="stable")
        rows, bins = rows.iloc[order].reset_index(drop=True), bins[order]
        size = rows["length"].to_numpy()
        before = np.cumsum(size) - size
        first = np.r_[True, bins[1:] != bins[:-1]] if len(bins) else np.zeros(0, bool)
        rows["offset"] = before - np.repeat(before[first], np.diff(np.r_[np.flatnonzero(first), len(bins)]))
        rows["bin"] = rows["shard"].astype("int64") * MOST_BINS + bins
        rows["fill"] = np.repeat(np.add.reduceat(size, np.flatnonzero(first)) if len(bins) else size, np.diff(np.r_[np.flatnonzero(first), len(bins)]))
        return rows[["row_id", "length", "bin", "offset", "fill"]]

    return pack


def place_remainders(todo: DataFrame, length: int, shard_rows: int) -> DataFrame | None:
    """(placed, sequence_id, offset) of the remainders (row_id, length); None where there are none."""
    rows, done, turn = todo.count(), None, 0
    while rows:
        shards = -(-rows // shard_rows)
        dealt = todo.withColumn("shard", F.pmod(F.xxhash64("row_id", F.lit(turn)), F.lit(shards)).cast("int"))
        packed = dealt.groupBy("shard").applyInPandas(_pack_shard(length), "row_id long, length long, bin long, offset long, fill long")
        packed = materialise(packed.withColumn("turn", F.lit(turn)), "packed")
        ready = packed if shards == 1 else packed.where(F.col("fill") >= int(FULL_ENOUGH * length))
        done = ready if done is None else done.unionByName(ready)
        if shards == 1:
            break
        todo = packed.where(F.col("fill") < int(FULL_ENOUGH * length)).select("row_id", "length")
        left = todo.count()
        if left > 0.9 * rows or turn + 1 == MOST_ROUNDS:  # more rounds would not fill these bins either
            done = done.unionByName(packed.where(F.col("fill") < int(FULL_ENOUGH * length)))
            break
        rows, turn = left, turn + 1
    if done is None:
        return None
    return done.select(F.col("row_id").alias("placed"), ((F.col("bin") * MOST_ROUNDS + F.col("turn")) * 2 + 1).alias("sequence_id"), "offset")


def pack_pieces(pieces: DataFrame, length: int = 2048, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Adds sequence_id and offset to materialised ``pieces``.

    Every document has one remainder at most, so a remainder is known by its ``row_id``.
    """
    whole = pieces.where(F.col("length") == length).withColumn("sequence_id", F.monotonically_increasing_id() * 2).withColumn("offset", F.lit(0).cast("long"))
    with scratch(pieces.sparkSession):
        places = place_remainders(pieces.where(F.col("length") < length).select("row_id", "length"), length, shard_rows)
        if places is None:
            return whole
        places = keep(places, "places")
    rest = pieces.where(F.col("length") < length).join(places, F.col("row_id") == F.col("placed")).drop("placed")
    return whole.unionByName(rest)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, length: int = 2048, keep_ids: bool = False) -> DataFrame:
    """Packs all documents into sequences of at most ``length`` tokens.

    Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if kept, ids (binary,
    little-endian unsigned 32-bit). Null text is empty (its end id is packed all the same), repeated
    rows are packed each, other columns take no part, an empty table gives no sequences.
    """
    with settings(docs.sparkSession, SMALL_BATCHES):
        pieces = materialise(cut_pieces(docs, tokenizer, end_id, length, keep_ids), "pieces")
    packed = pack_pieces(pieces, length)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if keep_ids else []))
