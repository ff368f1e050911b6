"""Benchmark decontamination with a positional inverted index of the training words.

Tasks put documents into shards of bounded size and lay out a shard's words in one line, with a gap
between documents; the postings of a term are its places in that line. Terms are dealt to buckets by
a checksum, and a row of the index holds one bucket of one shard.

A window of benchmark words is looked up in the shards that have its rarest term: the postings of
all its terms, moved back by their place in the window, are intersected from the rarest term on.
Nothing but postings of benchmark terms, and the windows that they lead, is shuffled.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL_BATCHES, keep, materialise, scratch, settings, task, text_slices

#: Consecutive words of an item that are looked for together.
WINDOW = 10
#: Words and documents of a shard, unless one document has more words.
SHARD_WORDS, SHARD_DOCS = 1 << 21, 1 << 15
#: Buckets that a shard's terms are dealt to.
BUCKETS = 64
#: Bytes of a long text that are split together.
PART_BYTES = 1 << 20

#: Digits, letters and all that isn't ASCII stay, A-Z become small, all else ends a word.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: Lists of words are one text, with a space between them, where they are stored or sent.
INDEX = "shard long, bucket int, terms binary, counts binary, postings binary, docs array<struct<doc_id:long,start:long,n_words:long>>"
LISTS = "shard long, term binary, n long, postings binary, led array<struct<words:binary,items:array<long>>>, docs array<struct<doc_id:long,start:long,n_words:long>>"
_DOCS = pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("n_words", pa.int64())]))
_LED = pa.list_(pa.struct([("words", pa.binary()), ("items", pa.list_(pa.int64()))]))
_INDEX = pa.schema([("shard", pa.int64()), ("bucket", pa.int32()), ("terms", pa.binary()), ("counts", pa.binary()), ("postings", pa.binary()), ("docs", _DOCS)])


def words(text: bytes | None) -> Iterator[list[bytes]]:
    """The lower-cased words of a text in UTF-8, a long one in parts that end between words."""
    data = (text or b"").translate(_WORDS)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PART_BYTES) if len(data) > at + PART_BYTES else -1
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


class _Shard:
    """Documents that are gathered for a shard."""

    def __init__(self):
        self.numbers: defaultdict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.docs: list[dict] = []
        self.terms: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.end = 0

    def add(self, doc: int | None, text: bytes | None) -> None:
        start, n = self.end, 0
        for part in words(text):
            self.terms.append(np.fromiter(map(self.numbers.__getitem__, part), np.int32, len(part)))
            self.places.append(np.arange(start + n, start + n + len(part)))
            n += len(part)
        self.docs.append({"doc_id": doc, "start": start, "n_words": n})
        self.end = start + n + 1  # a place that no word has

    def rows(self, number: int) -> Iterator[pa.RecordBatch]:
        """A row of the documents, without bucket, and one per bucket: its terms, and their postings as steps."""
        yield pa.RecordBatch.from_pylist([{"shard": number, "docs": self.docs}], schema=_INDEX)
        if not self.numbers:
            return
        names = list(self.numbers)
        bucket = np.array([zlib.crc32(t) % BUCKETS for t in names], np.int64)
        by_bucket = np.argsort(bucket, kind="stable")
        rank = np.empty(len(names), np.int64)
        rank[by_bucket] = np.arange(len(names))
        term, place = rank[np.concatenate(self.terms)], np.concatenate(self.places)
        wide = self.end >= 1 << 31
        if wide:
            place = place[np.argsort(term, kind="stable")]
        else:  # both in one number, which sorts faster
            place = np.sort((term << 32) | place) & 0xFFFFFFFF
        counts = np.bincount(term, minlength=len(names))
        steps = np.diff(place, prepend=0)
        first = np.cumsum(counts) - counts
        steps[first] = place[first]
        steps = steps.astype("<i8" if wide else "<i4")
        ends = np.searchsorted(bucket[by_bucket], np.arange(BUCKETS + 1))
        at = np.r_[first, len(place)]
        for b in np.flatnonzero(np.diff(ends)).tolist():
            a, z = int(ends[b]), int(ends[b + 1])
            row = {"shard": number, "bucket": b, "terms": b" ".join([names[k] for k in by_bucket[a:z].tolist()]), "counts": counts[a:z].astype("<i8").tobytes(), "postings": steps[at[a] : at[z]].tobytes()}
            yield pa.RecordBatch.from_pylist([row], schema=_INDEX)


def _gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    shard = _Shard()
    for part in text_slices(batches):
        for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
            shard.add(doc, text)
            if shard.end >= SHARD_WORDS or len(shard.docs) >= SHARD_DOCS:
                yield from shard.rows(number)
                number, shard = number + 1, _Shard()
    if shard.docs:
        yield from shard.rows(number)


def build_index(docs: DataFrame) -> DataFrame:
    """The positional index of all words of ``docs`` (doc_id, text), as a table: every document is in one shard."""
    with settings(docs.sparkSession, SMALL_BATCHES):
        return materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task("leaks", _gather), INDEX), "index")


# Windows of the benchmark


def _items(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches):
        found = [[w for ws in words(t) for w in ws] for t in part.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("item_id"), pa.array(found, pa.list_(pa.binary()))], names=["item_id", "words"])


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(window, words, items): the different runs of ``size`` words of items (or of all words of shorter ones), as a table."""
    own = items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(task("leaks", _items), "item_id long, words array<binary>")
    n = F.least(F.size("words"), F.lit(size))
    runs = F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.slice("words", i, n))
    each = own.where(F.size("words") > 0).select("item_id", F.explode(runs).alias("words"))
    numbered = each.groupBy("words").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    return materialise(numbered.select(F.monotonically_increasing_id().alias("window"), "words", "items"), "windows")


def _by_bucket(terms: DataFrame, *columns: str) -> DataFrame:
    """Benchmark terms by bucket, as a table, so that Spark sees whether it is small enough for a broadcast."""
    bucket = F.pmod(F.crc32("term"), F.lit(BUCKETS)).cast("int").alias("bucket")
    return materialise(terms.groupBy(bucket).agg(F.collect_list(F.struct("term", *columns)).alias("asked")), "asked")


def _frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each benchmark term is in a shard."""
    schema = pa.schema([("term", pa.binary()), ("n", pa.int64())])
    for batch in batches:
        for row in batch.to_pylist():
            asked, counts = {a["term"] for a in row["asked"]}, np.frombuffer(row["counts"], "<i8")
            found = [(t, int(counts[k])) for k, t in enumerate(row["terms"].split(b" ")) if t in asked]
            yield pa.RecordBatch.from_pylist([{"term": t, "n": n} for t, n in found], schema=schema)


def _pick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of benchmark terms in a shard, with the windows that they lead."""
    schema = pa.schema([("shard", pa.int64()), ("term", pa.binary()), ("n", pa.int64()), ("postings", pa.binary()), ("led", _LED), ("docs", _DOCS)])
    for batch in batches:
        for row in batch.to_pylist():
            asked, counts = {a["term"]: a["led"] for a in row["asked"]}, np.frombuffer(row["counts"], "<i8")
            ends = np.cumsum(counts)
            width = len(row["postings"]) // int(ends[-1])
            found = [(k, t) for k, t in enumerate(row["terms"].split(b" ")) if t in asked]
            out = [{"shard": row["shard"], "term": t, "n": int(counts[k]), "postings": row["postings"][int(ends[k] - counts[k]) * width : int(ends[k]) * width], "led": asked[t]} for k, t in found]
            yield pa.RecordBatch.from_pylist(out, schema=schema)


# Search in a shard


def phrase(lists: dict[bytes, np.ndarray], run: list[bytes]) -> np.ndarray:
    """Where the words stand one after another: postings are intersected from the rarest word on."""
    if any(w not in lists for w in run):
        return np.zeros(0, np.int64)
    order = sorted(range(len(run)), key=lambda k: len(lists[run[k]]))
    starts = lists[run[order[0]]] - order[0]
    for k in order[1:]:
        if not len(starts):
            break
        places = lists[run[k]]
        at = np.searchsorted(places, starts + k)
        starts = starts[places[np.minimum(at, len(places) - 1)] == starts + k]
    return starts


def near(lists: dict[bytes, np.ndarray], run: list[bytes], reach: int, doc_starts: np.ndarray) -> np.ndarray:
    """Places of the rarest word from which ``reach`` consecutive words of one document have all the words, in any order."""
    if any(w not in lists for w in run):
        return np.zeros(0, np.int64)
    rarest, *others = sorted(set(run), key=lambda w: len(lists[w]))
    at = lists[rarest]
    doc = np.searchsorted(doc_starts, at, side="right") - 1
    low = np.maximum(at - reach + 1, doc_starts[doc])
    high = np.minimum(at + reach - 1, np.r_[doc_starts[1:] - 1, np.iinfo(np.int64).max][doc])
    ok = np.ones(len(at), bool)
    for w in others:
        ok &= np.searchsorted(lists[w], low) < np.searchsorted(lists[w], high, side="right")
    # Each other word is on one side or the other; now they have to be in one span.
    together = [_in_one_span([lists[w][slice(*np.searchsorted(lists[w], (a, z + 1)))] for w in others] + [np.array([p])], reach) for p, a, z in zip(at[ok].tolist(), low[ok].tolist(), high[ok].tolist(), strict=True)]
    return at[ok][np.array(together, bool)]


def _in_one_span(places: list[np.ndarray], reach: int) -> bool:
    """Whether some ``reach`` consecutive places hold one of each list."""
    place = np.concatenate(places)
    which = np.repeat(np.arange(len(places)), [len(p) for p in places])[np.argsort(place, kind="stable")].tolist()
    last = [-1] * len(places)
    for p, w in zip(np.sort(place).tolist(), which, strict=True):
        last[w] = p
        if min(last) >= 0 and p - min(last) < reach:
            return True
    return False


FOUND = "doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<long>, near_items array<long>"


def _search(reach: int | None):
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", spans), ("items", pa.list_(pa.int64())), ("near_items", pa.list_(pa.int64()))])

    def search(rows: pa.Table) -> pa.Table:
        docs = next(d for d in rows.column("docs").to_pylist() if d is not None)
        starts = np.array([d["start"] for d in docs])
        end = docs[-1]["start"] + docs[-1]["n_words"] + 1
        lists: dict[bytes, np.ndarray] = {}
        for term, steps, n in zip(rows.column("term").to_pylist(), rows.column("postings").to_pylist(), rows.column("n").to_pylist(), strict=True):
            if term is not None:
                lists[term] = np.cumsum(np.frombuffer(steps, f"<i{len(steps) // n}").astype(np.int64))
        change = np.zeros(end + 1, np.int64)
        exact: dict[int, set[int]] = defaultdict(set)
        close: dict[int, set[int]] = defaultdict(set)
        for led in rows.column("led").to_pylist():
            for window in led or []:
                run, items = window["words"].split(b" "), window["items"]
                at = phrase(lists, run)
                if len(at):
                    change[at] += 1
                    change[at + len(run)] -= 1
                    for d in np.unique(np.searchsorted(starts, at, side="right") - 1).tolist():
                        exact[d].update(items)
                if reach is not None:
                    for d in np.unique(np.searchsorted(starts, near(lists, run, reach, starts), side="right") - 1).tolist():
                        close[d].update(items)
        hit = np.r_[0, (np.cumsum(change) > 0).astype(np.int8)]
        turns = np.diff(hit)
        begins, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
        owner = np.searchsorted(starts, begins, side="right") - 1
        cut = np.searchsorted(owner, np.arange(len(docs) + 1))
        out = []
        for d, doc in enumerate(docs):
            own = slice(cut[d], cut[d + 1])
            found = [{"start": a - doc["start"], "end": z - doc["start"]} for a, z in zip(begins[own].tolist(), ends[own].tolist(), strict=True)]
            out.append({"doc_id": doc["doc_id"], "n_words": doc["n_words"], "spans": found, "items": sorted(exact[d]) if d in exact else [], "near_items": None if reach is None else sorted(close[d]) if d in close else []})
        return pa.Table.from_pylist(out, schema=schema)

    return search


def find(index: DataFrame, runs: DataFrame, reach: int | None = None) -> DataFrame:
    """Per document of the index: doc_id, n_words, spans (hit words, as ranges), items (whose windows occur), near_items.

    ``runs`` are ``windows``. With ``reach``, near_items are the items with a window whose words
    all stand, in any order, within so many consecutive words; else it is null.
    """
    each = runs.select("window", F.posexplode("words").alias("k", "term"))
    lookup = index.where("bucket IS NOT NULL")
    one = {"spark.sql.execution.arrow.maxRecordsPerBatch": "16"}
    with settings(index.sparkSession, one):
        asked = _by_bucket(each.select("term").distinct())
        counted = lookup.select("bucket", "terms", "counts").join(asked, "bucket").mapInArrow(task("leaks", _frequencies), "term binary, n long")
        often = materialise(counted.groupBy("term").agg(F.sum("n").alias("n")), "frequencies")
        # A window is led by its rarest term; one with a term that no document has can't occur.
        leader = each.join(often, "term", "left").groupBy("window").agg(F.min(F.struct("n", "k", "term")).alias("lead"), F.count_if(F.col("n").isNull()).alias("absent"))
        led = leader.where("absent = 0").select("window", F.col("lead.term").alias("term")).join(runs, "window").groupBy("term").agg(F.collect_list(F.struct(F.expr("concat_ws(' ', transform(words, w -> cast(w AS string)))").cast("binary").alias("words"), "items")).alias("led"))
        asked = _by_bucket(often.join(led, "term", "left"), "led")
        picked = lookup.select("shard", "bucket", "terms", "counts", "postings").join(asked, "bucket").mapInArrow(task("leaks", _pick), LISTS)
        shards = index.where("bucket IS NULL").select("shard", F.lit(None).cast("binary").alias("term"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("binary").alias("postings"), F.lit(None).cast("array<struct<words:binary,items:array<long>>>").alias("led"), "docs")
        return materialise(picked.unionByName(shards).groupBy("shard").applyInArrow(_search(reach), FOUND), "found")


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words; an item without words hits nothing; rows with one item_id are
    one item; an item without item_id hits words, but isn't listed or counted. Repeated rows and rows
    without doc_id have a row each; other columns take no part; an empty table of documents gives no
    rows, an empty benchmark hits nothing.
    """
    with scratch(docs.sparkSession):
        found = find(build_index(docs), windows(benchmark))
        hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
        listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
        return keep(found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (hit > 0).alias("contaminated")), "leaks")


SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
q AS MATERIALIZED (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM p),
s AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM q) WHERE len(w) >= n),
h AS MATERIALIZED (SELECT rid, i, s.n, item_id FROM s JOIN q ON q.n = s.n AND q.g = array_to_string(w[i:i + s.n - 1], ' ')),
c AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + n)) AS k FROM h) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY encode(item)) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)
"""
