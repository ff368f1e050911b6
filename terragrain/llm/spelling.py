"""Spelling variants: words at distance one, by a self-join of the vocabulary's trie with active-node sets.

The trie is partitioned by prefix: words of one length class that share their first half form a
cell. Two words at distance one that don't share it share the rest, so every word is also in a cell
of those with its second half. Cells with many words are split in the same way, in the part that
isn't shared yet. In a cell, the trie is gone down level by level with its active nodes: pairs of
nodes within distance one whose parents were, so that terminal pairs come out at the last levels.

A pair belongs to the length class of its shorter word, and to the cell where it shares the longest
start, so it is found once.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SMALL_BATCHES, hot_keys_of, keep, materialise, scratch, settings, split_join, task, text_slices

#: Words of a cell before it is split, unless only one character of it is left open.
CELL_WORDS = 1_024
#: Entries of cells, and characters of theirs, that a task works on together.
BATCH_ENTRIES, BATCH_CHARS = 1 << 15, 1 << 20
#: Words that a task counts before it sends them, and their bytes.
COUNTED_WORDS, COUNTED_BYTES = 1 << 18, 1 << 24
#: Characters of a long text that are counted together.
PART_CHARS = 1 << 20
#: The contract's planted misspellings: of runs whose checksum this divides, one character is deleted.
DELETED = 97

#: Latin-1 letters stay, A-Z become small, all else ends a run. (U+00D7 and U+00F7 count as letters, as in the contract's range.)
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
#: Room for a code point beside a node's number.
_CHAR_BITS = 21


def _runs(text: str) -> Iterator[list[bytes]]:
    """The lower-cased runs of a text as Latin-1, a long text in parts that end between runs."""
    data = text.encode("latin-1", "replace").translate(_LETTERS)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PART_CHARS) if len(data) > at + PART_CHARS else -1
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def misspelt(run: bytes, seed: int | None) -> bytes:
    """The run, or without one of its characters where its checksum, begun with ``seed``, says so."""
    if seed is None:
        return run
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
    if h % DELETED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _count(least: int):
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def rows(counts: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(counts.values(), pa.int64())], schema=schema)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        held = 0
        for part in text_slices(batches):
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                seed = None if doc is None else zlib.crc32(b"%d:" % doc)
                for runs in _runs(text or ""):
                    for run, n in Counter(r for r in runs if len(r) >= least).items():
                        word = misspelt(run, seed)
                        if word not in counts:
                            held += len(word)
                            counts[word] = n
                        else:
                            counts[word] += n
                    if len(counts) >= COUNTED_WORDS or held >= COUNTED_BYTES:
                        yield rows(counts)
                        counts, held = {}, 0
        if counts:
            yield rows(counts)

    return task("spelling", count)


def vocabulary(docs: DataFrame, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n): the different runs of letters, with planted misspellings, of at least so many characters and occurrences."""
    with settings(docs.sparkSession, SMALL_BATCHES):
        partial = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_count(least_length), "word string, n long")
        counted = partial.groupBy("word").agg(F.sum("n").alias("n"))
        return materialise(counted.where((F.length("word") >= least_length) & (F.col("n") >= least_count)), "vocabulary")


# Cells


def _cell(length: Column, left: Column, right: Column) -> Column:
    """A cell of the words of ``length``, or one character more, by their first ``left`` and last ``right`` characters."""
    text = F.concat(F.substring("word", F.lit(1), left), F.substring("word", F.length("word") - right + 1, right))
    return F.struct(length.cast("int").alias("length"), left.cast("int").alias("left"), text.alias("cell"))


def _first_cells(words: DataFrame) -> DataFrame:
    """Every word in the cells of both halves, in its own length class and as the longer word of the class before."""
    classes = F.filter(F.array(F.length("word"), F.length("word") - 1), lambda n: n > 0)
    each = words.select("word", "n", F.explode(classes).alias("l"))
    half = F.floor(F.col("l") / 2).cast("int")
    return each.select("word", "n", F.explode(F.array(_cell(F.col("l"), half, F.lit(0)), _cell(F.col("l"), F.lit(0), F.col("l") - half))).alias("c")).select("word", "n", "c.*")


def _halved(entries: DataFrame) -> DataFrame:
    """The entries of cells in the two halves of what their cells leave open."""
    right = F.length("cell") - F.col("left")
    half = F.floor((F.col("length") - F.length("cell")) / 2).cast("int")
    rest = F.col("length") - F.length("cell") - half
    return entries.select("word", "n", F.explode(F.array(_cell(F.col("length"), F.col("left") + half, right), _cell(F.col("length"), F.col("left"), right + rest))).alias("c")).select("word", "n", "c.*")


CELL = ["length", "left", "cell"]


def cells(words: DataFrame) -> DataFrame:
    """(word, n, length, left, cell): the entries of cells with several words, split until they are small."""
    done: DataFrame | None = None
    entries = _first_cells(words)
    while True:
        sizes = materialise(entries.groupBy(*CELL).agg(F.count(F.lit(1)).alias("words")).where(F.col("words") > CELL_WORDS).where(F.col("length") - F.length("cell") >= 2).select(*CELL), "large-cells")
        if sizes.isEmpty():
            return entries if done is None else done.unionByName(entries)
        small = entries.join(sizes, CELL, "left_anti").select("word", "n", *CELL)
        done = small if done is None else done.unionByName(small)
        entries = materialise(_halved(entries.join(sizes, CELL, "left_semi")), "entries")


# The join in a cell


class _Trie:
    """Tries of the open parts of words, one root per cell, level by level: a node is its parent's number and a character."""

    def __init__(self, cell: np.ndarray, chars: np.ndarray, size: np.ndarray):
        at = cell.astype(np.int64)
        self.keys: list[np.ndarray] = [np.zeros(0, np.int64)]
        self.nodes: list[np.ndarray] = [at]  # by level, the node of every word that reaches it
        for d in range(chars.shape[1]):
            reach = np.flatnonzero(size > d)
            keys, found = np.unique((at[reach] << _CHAR_BITS) | chars[reach, d].astype(np.int64), return_inverse=True)
            at = np.full(len(size), -1, np.int64)
            at[reach] = found
            self.keys.append(keys)
            self.nodes.append(at)

    def parents(self, level: int) -> np.ndarray:
        return self.keys[level] >> _CHAR_BITS

    def has(self, level: int, words: np.ndarray) -> np.ndarray:
        """Which nodes of a level lead to one of the words."""
        out = np.zeros(len(self.keys[level]), bool)
        out[self.nodes[level][words]] = True
        return out


def _children(keys: np.ndarray, parents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per parent, where its children start and how many they are."""
    start = np.searchsorted(keys, parents << _CHAR_BITS)
    return start, np.searchsorted(keys, (parents + 1) << _CHAR_BITS) - start


def _spread(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which line, which number) of the ranges of numbers."""
    line = np.repeat(np.arange(len(count)), count)
    return line, np.arange(len(line)) - np.repeat(np.cumsum(count) - count, count) + start[line]


def _match(keys_a: np.ndarray, keys_b: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of children of ``a`` and ``b`` by the same character."""
    line, child = _spread(*_children(keys_a, a))
    wanted = (b[line] << _CHAR_BITS) | (keys_a[child] & ((1 << _CHAR_BITS) - 1))
    at = np.searchsorted(keys_b, wanted)
    found = np.flatnonzero(at < len(keys_b))
    found = found[keys_b[at[found]] == wanted[found]]
    return child[found], at[found]


def _siblings(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every two children of one node."""
    parents = keys >> _CHAR_BITS
    end = np.searchsorted(parents, parents, side="right")
    at = np.arange(len(keys))
    return _spread(at + 1, end - at - 1)


def near_pairs(cell: np.ndarray, chars: np.ndarray, size: np.ndarray, open_: int, tail: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of words of one cell at distance one, the shorter of which has ``open_`` open characters.

    ``chars`` has the open characters of words, ``size`` their number: ``open_`` or one more. With a
    ``tail`` (cells by the words' ends), pairs that share their start up to it belong to another cell.
    """
    trie = _Trie(cell, chars, size)
    short, long = np.flatnonzero(size == open_), np.flatnonzero(size == open_ + 1)
    none = np.zeros(0, np.int64)
    same, longer = (none, none), (none, none)  # active nodes at distance one: of the same depth, and (one deeper, node)
    for level in range(1, open_ + 2):
        keys, above = trie.keys[level], trie.keys[level - 1]
        roots = trie.nodes[0]
        to_long = trie.has(level, long)
        # One more character than the other: added here, or before and followed by equal ones.
        before = trie.has(level - 1, short) if level > 1 else np.isin(np.arange(int(roots.max(initial=-1)) + 1), roots[short])
        a, b = _match(keys, above, *longer) if level > 1 else (none, none)
        a, b = np.concatenate([a, np.arange(len(keys))]), np.concatenate([b, keys >> _CHAR_BITS])
        kept = to_long[a] & before[b]
        pairs = np.unique(a[kept] * (len(before) + 1) + b[kept])
        longer = pairs // (len(before) + 1), pairs % (len(before) + 1)
        if level <= open_:
            to_short = trie.has(level, short)
            (a, b), (c, d) = _match(keys, keys, *same), _siblings(keys)
            a, b = np.concatenate([a, c]), np.concatenate([b, d])
            kept = to_short[a] & to_short[b]
            same = a[kept], b[kept]
    # Terminal pairs.
    word_of = np.full(len(trie.keys[open_]) if open_ else int(trie.nodes[0].max(initial=-1)) + 1, -1, np.int64)
    word_of[trie.nodes[open_][short]] = short
    deep = np.full(len(trie.keys[open_ + 1]), -1, np.int64)
    deep[trie.nodes[open_ + 1][long]] = long
    u, v = longer
    if tail:
        apart = trie.parents(open_ + 1)[u] != v
        u, v = u[apart], v[apart]
    return np.concatenate([word_of[same[0]], word_of[v]]), np.concatenate([word_of[same[1]], deep[u]])


def _summed(words: list[str], counts: np.ndarray, length: int, left: int, cell: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, near words in this cell, best of them) as numbers of lines, for entries of cells with one length class and shape."""
    right = len(cell[0]) - left
    open_ = length - left - right
    size = np.array([len(w) for w in words]) - left - right
    text = np.array([w[left : len(w) - right] for w in words], dtype=f"<U{open_ + 1}")
    chars = text.view(np.uint32).reshape(len(words), open_ + 1)
    _, numbers = np.unique(np.array(cell, dtype=object), return_inverse=True)
    a, b = near_pairs(numbers, chars, size, open_, right > 0)
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[b], -counts[b], a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]][: len(a)])
    return a[first], np.diff(np.r_[first, len(a)]), b[first]


NEAR = "word string, n_near long, best_n long, best string"


def _join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per word and cell its near words' number and the best of them; entries come ordered by cell."""
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
    waiting: dict[tuple[int, int, int], list[tuple[str, int, str]]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (length, left, _), rows in waiting.items():
            words, counts = [r[0] for r in rows], np.array([r[1] for r in rows], np.int64)
            at, near, best = _summed(words, counts, length, left, [r[2] for r in rows])
            if len(at):
                columns = [[words[k] for k in at.tolist()], near, counts[best], [words[k] for k in best.tolist()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        waiting.clear()

    current, members, entries, chars = None, [], 0, 0
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in (*CELL, "word", "n")]
        for length, left, cell, word, n in zip(*columns, strict=True):
            if (length, left, cell) != current:
                if len(members) > 1:  # a word alone has no near one
                    shape = (current[0], current[1], len(current[2]))
                    waiting.setdefault(shape, []).extend(members)
                    entries, chars = entries + len(members), chars + len(members) * (shape[0] - shape[2] + 1)
                if entries >= BATCH_ENTRIES or chars >= BATCH_CHARS:
                    yield from flush()
                    entries, chars = 0, 0
                current, members = (length, left, cell), []
            members.append((word, n, cell))
    if len(members) > 1:
        waiting.setdefault((current[0], current[1], len(current[2])), []).extend(members)
    yield from flush()


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, n_near, best_n, best): per word of ``words`` (word, n; each once) how many are at distance one, and the one of largest n (ties: the smallest)."""
    entries = cells(words)
    found = entries.repartition(*CELL).sortWithinPartitions(*CELL).mapInArrow(task("spelling", _join), NEAR)
    best = F.struct((-F.col("best_n")).alias("o"), F.col("best").alias("w"))
    each = found.select("word", F.lit(None).cast("long").alias("n"), "n_near", best.alias("b"))
    own = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<o:bigint,w:string>").alias("b"))
    out = own.unionByName(each).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("b").alias("b"))
    return out.select("word", "n", "n_near", (-F.col("b.o")).alias("best_n"), F.col("b.w").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form, from (word, form): where following forms ends. Every round halves what is left of a chain."""
    up = materialise(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        above = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialise(split_join(up, above, ["root"], "word", hot_keys_of(up, ["root"]), "left"), "forms")
        up = moved.select("word", F.coalesce("next", "root").alias("root"))
        if moved.where("next IS NOT NULL").isEmpty():
            return up


def group_spellings(docs: DataFrame) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n.

    Words are runs of Latin letters of 5 characters and 3 occurrences at least, after the contract's
    planted deletions. A word's form is the word of largest n at distance one (ties: the smallest),
    if that is twice the word's own n at least; root is where forms lead. Null and empty texts have
    no words; rows without doc_id, which have no checksum, are read as they are; repeated rows count
    as often as they stand there; other columns take no part; without words there are no rows.
    """
    with scratch(docs.sparkSession):
        words = vocabulary(docs)
        near = materialise(near_words(words), "near")
        has_form = F.col("best_n") >= 2 * F.col("n")
        formed = near.select("word", F.when(has_form, F.col("best")).alias("form"), "n", "n_near", F.when(has_form, F.col("best_n")).alias("form_n"))
        ends = roots(formed.where("form IS NOT NULL"))
        named = formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
        return keep(named, "spellings")


SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY ALL),
hexed AS (SELECT *, hex(doc_id || ':' || run) AS x FROM runs),
hashed AS (
  SELECT run, n, xor(list_reduce([4294967295] || list_transform(range(len(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM hexed, crc),
v AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) + 2 AS INTEGER)) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
d AS MATERIALIZED (SELECT word, i, substr(word, 1, CAST(i - 1 AS INTEGER)) || substr(word, CAST(i + 1 AS INTEGER)) AS d FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (
  SELECT a.word, b.word AS other FROM d a JOIN d b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
  UNION SELECT d.word, v.word FROM d JOIN v ON d.d = v.word
  UNION SELECT v.word, d.word FROM d JOIN v ON d.d = v.word),
best AS (
  SELECT near.word, near.other, o.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near
  FROM near JOIN v o ON o.word = near.other
  QUALIFY row_number() OVER (PARTITION BY near.word ORDER BY o.n DESC, encode(near.other)) = 1),
f AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * v.n THEN other END AS form, CASE WHEN other_n >= 2 * v.n THEN other_n END AS form_n
  FROM v LEFT JOIN best USING (word)),
walk AS (
  SELECT word, word AS at FROM f
  UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, walk.at AS root, f.n, f.n_near, f.form_n
FROM f JOIN walk USING (word) JOIN f e ON e.word = walk.at AND e.form IS NULL
"""
