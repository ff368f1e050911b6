"""Grouped prefix join: documents whose sets of word n-grams have a Jaccard similarity of 0.8 or more.

1. Every text becomes its set of shingle hashes. A set whose shingles are, for more than a fifth,
   found in no other set can't be similar to any, so a first pass finds the shingles that occur once:
   tasks send 4 bytes per shingle, dealt by hash, and get back a count per document.
2. The documents left are collapsed by identical set, and their shingles are ordered from rare to
   frequent. Two similar sets share a shingle of their prefixes (the rarest fifth).
3. Sets of one size with one prefix form a group. Groups that share a prefix shingle, and whose sizes
   and positions allow the similarity, are candidates; they are expanded to members, verified on the
   whole sets, and every link that is found is checked once more on the words themselves.

Only connectedness is asked for, so no group is ever expanded to all its pairs at once: first every
member is verified against one pivot per shingle, links are joined into components, and only members
of different components are compared further. That loses no link between components. Rows of one
shingle, pivot or component are dealt over several tasks where there are many.

A word is known by 128 bits of a cryptographic digest, a shingle by 64 bits mixed from its words',
and a set by 128 bits that digest two such hashes of all its shingles.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, SMALL_BATCHES, Recent, hot_keys, hot_keys_of, keep, materialise, remember, scratch, settings, split_join, task, text_slices

WORDS = 5
#: The similarity as a fraction: 4 / 5.
NUMERATOR, DENOMINATOR = 4, 5
#: Bytes of text whose shingles one bucket of the first pass holds, on average.
BUCKET_BYTES = 6_000_000
#: Shingles that a task gathers before it sends them.
BATCH_SHINGLES = 500_000
#: Sets that a Bloom filter tells apart from the others, at most: 8 MB; with many more, it lets most rows pass.
BLOOM_ITEMS = 8_000_000
#: Rounds against pivots before what is left is compared in full.
PIVOT_ROUNDS = 2
#: Bytes of a long text, and words, that are looked up together.
PART_BYTES, WORDS_AT_ONCE = 1 << 20, 300_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _digests() -> Recent:
    remember("jaccard", _digests.cache_clear)
    return Recent(lambda words: [hashlib.blake2b(w, digest_size=16).digest() for w in words])


def _words(text: str | None) -> Iterator[list[bytes]]:
    """The lower-cased words of a text, a long one in parts: bytes split at the same white space as the contract's."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)
    at = 0
    while at < len(data):
        gap = _GAP.search(data, at + PART_BYTES)
        end = gap.start() if gap else len(data)
        yield data[at:end].split()
        at = end


def _word_digests(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The digests of all words of the texts, two numbers a word, and how many words each text has."""
    parts: list[np.ndarray] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    waiting: list[list[bytes]] = []

    def look_up():
        known = _digests().holding(set().union(*waiting))
        parts.append(np.frombuffer(b"".join(map(known.__getitem__, chain.from_iterable(waiting))), dtype="<u8").reshape(-1, 2))
        waiting.clear()

    held = 0
    for k, text in enumerate(texts):
        for words in _words(text):
            counts[k] += len(words)
            held += len(words)
            waiting.append(words)
            if held >= WORDS_AT_ONCE:
                look_up()
                held = 0
    look_up()
    return np.concatenate(parts), counts


def _fold(digests: np.ndarray, n: int) -> np.ndarray:
    """Two hashes of every run of ``n`` words."""
    h = np.full((len(digests) - n + 1, 2), n, dtype=np.uint64)
    for k in range(n):
        h = _mix(h * np.uint64(31) + digests[k : len(digests) - n + 1 + k])
    return h


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[tuple[np.ndarray, int, int]]:
    """Per text: the sorted distinct hashes of its word n-grams (of all words together, if they are fewer), and 128 bits that stand for the set."""
    digests, counts = _word_digests(texts)
    starts, owner = np.cumsum(counts) - counts, np.repeat(np.arange(len(texts)), counts)
    if len(digests) >= words:
        h, own = _fold(digests, words), owner[: len(digests) - words + 1]
        inside = own == owner[words - 1 :]
        h, own = h[inside], own[inside]
    else:
        h, own = np.zeros((0, 2), dtype=np.uint64), np.zeros(0, dtype=np.int64)
    short = np.flatnonzero((counts > 0) & (counts < words))
    h = np.concatenate([h, *[_fold(digests[starts[k] : starts[k] + counts[k]], int(counts[k])) for k in short]])
    own = np.concatenate([own, short])
    order = np.lexsort((h[:, 0], own))
    h, own = h[order], own[order]
    new = np.r_[True, (h[1:, 0] != h[:-1, 0]) | (own[1:] != own[:-1])][: len(h)]
    h, own = h[new], own[new]
    at = np.searchsorted(own, np.arange(len(texts) + 1)).tolist()
    out = []
    for k in range(len(texts)):
        part = h[at[k] : at[k + 1]]
        hi, lo = np.frombuffer(hashlib.blake2b(part.tobytes(), digest_size=16).digest(), dtype="<i8").tolist() if len(part) else (0, 0)
        out.append((part[:, 0].copy(), hi, lo))
    return out


def least_shared(size: Column) -> Column:
    """How many of its shingles a set must share with a similar one, at least."""
    return F.ceil(size * NUMERATOR / DENOMINATOR)


_ARROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("batch", pa.int64()), ("place", pa.int64()), ("locator", pa.int64()), ("doc", pa.int64()), ("n", pa.int64()), ("key_hi", pa.int64()), ("key_lo", pa.int64()), ("repeated", pa.int64()), ("values", pa.binary()), ("places", pa.binary())])
_PASS = "kind int, bucket int, batch long, place long, locator long, doc long, n long, key_hi long, key_lo long, repeated long, values binary, places binary"
_SET = "locator long, doc long, n long, key_hi long, key_lo long"


def _rows(**columns) -> pa.RecordBatch:
    size = max(len(v) for v in columns.values())
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in _ARROW], schema=_ARROW)


def _send(buckets: int):
    """First pass, map side. Per batch of documents: one row per document (kind 0), and one row per bucket (kind 1).

    A bucket's row holds 4 bytes of every shingle of one document of the batch, with the document's
    place; and, after those and without a place, of every shingle of several documents, once.
    """

    def rows_of(docs: list[tuple[int, int | None, np.ndarray, int, int]]) -> Iterator[pa.RecordBatch]:
        batch = docs[0][0]
        joined = np.concatenate([s for _, _, s, _, _ in docs])
        owner = np.repeat(np.arange(len(docs)), [len(s) for _, _, s, _, _ in docs])
        order = np.argsort(joined, kind="stable")
        values = joined[order]
        new = np.r_[True, values[1:] != values[:-1]][: len(values)]
        single = new & np.r_[new[1:], True][: len(values)]
        alone = np.zeros(len(joined), dtype=bool)
        alone[order] = single
        places = np.arange(len(docs))
        yield _rows(
            kind=np.zeros(len(docs), np.int32), bucket=((batch + places) % buckets).astype(np.int32), batch=np.full(len(docs), batch), place=places, locator=[d[0] for d in docs], doc=[d[1] for d in docs],
            n=[len(d[2]) for d in docs], key_hi=[d[3] for d in docs], key_lo=[d[4] for d in docs], repeated=np.bincount(owner[~alone], minlength=len(docs)),
        )
        sent = np.concatenate([joined[alone], values[new & ~single]])
        place = np.concatenate([owner[alone], np.full(len(sent) - int(alone.sum()), -1)])
        into = (sent % np.uint64(buckets)).astype(np.int64)
        by = np.lexsort((place < 0, into))
        into, low, place = into[by], (sent[by] >> np.uint64(32)).astype("<u4"), place[by].astype("<i4")
        at = np.searchsorted(into, np.arange(buckets + 1))
        used = np.flatnonzero(np.diff(at))
        for start in range(0, len(used), 1024):
            part = used[start : start + 1024].tolist()
            steps = [np.diff(place[at[b] : at[b + 1]], prepend=np.int32(0)).astype("<i4").tobytes() for b in part]
            yield _rows(kind=np.ones(len(part), np.int32), bucket=np.array(part, np.int32), batch=np.full(len(part), batch), values=[low[at[b] : at[b + 1]].tobytes() for b in part], places=steps)

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[tuple[int, int | None, np.ndarray, int, int]] = []
        held = 0
        for part in text_slices(batches):
            for locator, doc, own in zip(part.column("locator").to_pylist(), part.column("doc").to_pylist(), shingle_sets(part.column("text").to_pylist()), strict=True):
                docs.append((locator, doc, *own))
                held += len(own[0]) + 64
            if held >= BATCH_SHINGLES:
                yield from rows_of(docs)
                docs, held = [], 0
        if docs:
            yield from rows_of(docs)
        _digests().clear()

    return task("jaccard", send)


def _answer(rows: pa.Table) -> pa.Table:
    """First pass, reduce side. Per row of a bucket: the places of the documents, once per shingle that another row has too.

    Rows of documents pass through. Two shingles that share their 4 bytes only keep a document longer.
    """
    kinds = rows.column("kind").to_numpy()
    docs, sent = rows.filter(pa.array(kinds == 0)), rows.filter(pa.array(kinds == 1))
    if not sent.num_rows:
        return rows
    values = [np.frombuffer(b, dtype="<u4") for b in sent.column("values").to_pylist()]
    places = [np.cumsum(np.frombuffer(b, dtype="<i4")) for b in sent.column("places").to_pylist()]
    joined = np.concatenate(values)
    order = np.argsort(joined, kind="stable")
    ordered = joined[order]
    group = np.cumsum(np.r_[True, ordered[1:] != ordered[:-1]]) - 1
    shared = np.empty(len(joined), dtype=bool)
    shared[order] = (np.bincount(group) > 1)[group]
    ends = np.cumsum([len(v) for v in values])
    replies = [p[own & (p >= 0)].astype("<i4").tobytes() for p, own in zip(places, np.split(shared, ends[:-1]), strict=True)]
    sent = sent.set_column(sent.schema.get_field_index("values"), "values", pa.nulls(sent.num_rows, pa.binary()))
    sent = sent.set_column(sent.schema.get_field_index("places"), "places", pa.array(replies, pa.binary()))
    return pa.concat_tables([docs.cast(_ARROW), sent.cast(_ARROW)])


def _totals(rows: pa.Table) -> pa.Table:
    """Per document of a batch: how many of its shingles some other document seems to have."""
    kinds = rows.column("kind").to_numpy()
    docs, sent = rows.filter(pa.array(kinds == 0)), rows.filter(pa.array(kinds == 1))
    place = docs.column("place").to_numpy()
    found = np.bincount(np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(b, dtype="<i4") for b in sent.column("places").to_pylist()]]).astype(np.int64), minlength=int(place.max()) + 1 if len(place) else 0)
    return docs.select(["locator", "doc", "n", "key_hi", "key_lo"]).append_column("repeated", pa.array(docs.column("repeated").to_numpy() + found[place]))


def stage_rows(docs: DataFrame) -> DataFrame:
    """The rows as a table of their own: locator, which tells them apart, and row (their columns)."""
    return materialise(docs.select(F.monotonically_increasing_id().alias("locator"), F.struct(*[F.col(c) for c in docs.columns]).alias("row")), "jaccard-rows")


def describe_sets(staged: DataFrame) -> DataFrame:
    """Per staged row: locator, doc (its doc_id), n, key_hi, key_lo (of its set), repeated (an upper bound of its shingles that others have)."""
    size = staged.agg(F.sum(F.octet_length("row.text"))).first()[0] or 0
    buckets = max(1, size // BUCKET_BYTES)
    rows = staged.select("locator", F.col("row.doc_id").cast("long").alias("doc"), F.col("row.text").alias("text"))
    sent = rows.mapInArrow(_send(buckets), _PASS)
    answered = sent.groupBy("bucket").applyInArrow(_answer, _PASS)
    totals = answered.groupBy("batch").applyInArrow(_totals, _SET + ", repeated long")
    with settings(staged.sparkSession, SMALL_BATCHES):
        return materialise(totals, "sets")


def is_alike(sets: DataFrame) -> DataFrame:
    """The rows whose set may be similar to another's."""
    return sets.where((F.col("n") > 0) & (F.col("repeated") >= least_shared(F.col("n"))))


def _tokens(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of the texts, beside the texts."""
    for part in text_slices(batches):
        tokens = [own.view(np.int64) for own, _, _ in shingle_sets(part.column("text").to_pylist())]
        yield pa.RecordBatch.from_arrays([part.column("set_id"), pa.array(tokens, pa.list_(pa.int64())), part.column("text")], names=["set_id", "tokens", "text"])
    _digests().clear()


def rows_of_sets(rows: DataFrame, ids: DataFrame, name: str, make: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """What ``make`` makes of those rows (set_id, ...) whose set is in the materialised, distinct ``ids`` (set_id, not negative), as a table.

    Texts and shingles are long and mostly not wanted, so Spark drops the others by a Bloom filter of
    the ids before it shuffles any. It makes one only from a side with a filter, which here holds for
    every row.
    """
    items = min(max(ids.count(), 1_000), BLOOM_ITEMS)
    bloom = {"enabled": "true", "applicationSideScanSizeThreshold": "0", "creationSideThreshold": "1t", "expectedNumItems": items, "maxNumItems": BLOOM_ITEMS, "numBits": 8 * items, "maxNumBits": 8 * BLOOM_ITEMS}
    with settings(rows.sparkSession, SMALL_BATCHES | {f"spark.sql.optimizer.runtime.bloomFilter.{k}": str(v) for k, v in bloom.items()}):
        return materialise(make(rows.join(ids.where("set_id >= 0"), "set_id", "left_semi")), name)


def distinct_sets(staged: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The different sets that may be similar to another: (set_id, key_hi, key_lo, n, members, first) and (set_id, tokens, text).

    ``set_id`` is the smallest locator among the set's members, ``first`` its member with the smallest
    doc_id (null last), then locator.
    """
    first = F.min(F.struct(F.col("doc").isNull().alias("no_id"), "doc", "locator")).alias("first")
    reps = is_alike(sets).groupBy("key_hi", "key_lo").agg(F.min("locator").alias("set_id"), F.min("n").alias("n"), F.count(F.lit(1)).alias("members"), first)
    reps = materialise(reps, "reps")
    texts = staged.select(F.col("locator").alias("set_id"), F.col("row.text").alias("text"))
    return reps, rows_of_sets(texts, reps.select("set_id"), "tokens", lambda found: found.mapInArrow(task("jaccard", _tokens), "set_id long, tokens array<long>, text string"))


def prefixes(reps: DataFrame, tokens: DataFrame) -> DataFrame:
    """Per set with shared shingles in its prefix: set_id, n, alone (unshared ones, which come first), prefix (the shared ones in order, with their frequency)."""
    each = tokens.select("set_id", F.explode("tokens").alias("token"))
    often = materialise(each.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "frequencies")
    hot = hot_keys(often.select("token", F.col("df").alias("n")), ["token"])
    shared = split_join(each, often, ["token"], "set_id", hot).groupBy("set_id").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))
    size = F.col("n") - least_shared(F.col("n")) + 1
    out = shared.join(reps.select("set_id", "n"), "set_id").withColumn("alone", F.col("n") - F.size("shared")).withColumn("room", size - F.col("alone"))
    return materialise(out.where("room > 0").select("set_id", "n", "alone", F.slice("shared", 1, F.col("room").cast("int")).alias("prefix")), "prefixes")


def _may_be_similar(a: str, b: str) -> Column:
    """Size and position filter for two entries (n, place) of one shingle: enough shingles can still be shared."""
    both = F.col(f"{a}.n") + F.col(f"{b}.n")
    most = F.least(F.col(f"{a}.n") - F.col(f"{a}.place"), F.col(f"{b}.n") - F.col(f"{b}.place"))
    # From here on at most ``most`` are shared; before, none if this is the first shared one, and the first one decides.
    return most * (NUMERATOR + DENOMINATOR) >= both * NUMERATOR


def _with_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links whose texts are similar word by word."""

    def ngrams(text: str) -> set:
        words = list(chain.from_iterable(_words(text)))
        n = min(WORDS, len(words))
        return set(zip(*(words[k:] for k in range(n)), strict=False))

    for part in text_slices(batches, rows=64, text=lambda batch: batch.column("text_b")):
        known: dict[int, set] = {}
        same = []
        for b, text_a, text_b in zip(part.column("b").to_pylist(), part.column("text_a").to_pylist(), part.column("text_b").to_pylist(), strict=True):
            if b not in known:
                known[b] = ngrams(text_b)
            own = ngrams(text_a)
            common = len(own & known[b])
            same.append(common * DENOMINATOR >= (len(own) + len(known[b]) - common) * NUMERATOR)
        yield part.select(["a", "b"]).filter(pa.array(same, pa.bool_()))


def verify(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """Those of the distinct, materialised pairs (a, b) whose whole sets are similar: by their hashes, then by their words."""
    hot_a, hot_b = (hot_keys_of(pairs, [k]) for k in "ab")
    ids = materialise(pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct(), "paired")
    tokens = rows_of_sets(tokens, ids, "paired-tokens")

    def beside(rows: DataFrame, column: str) -> DataFrame:
        right = split_join(rows, tokens.select(F.col("set_id").alias("b"), F.col(column).alias(f"{column}_b")), ["b"], "a", hot_b)
        return split_join(right, tokens.select(F.col("set_id").alias("a"), F.col(column).alias(f"{column}_a")), ["a"], "b", hot_a)

    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    union = F.size("tokens_a") + F.size("tokens_b") - common
    similar = beside(pairs, "tokens").where(common * DENOMINATOR >= union * NUMERATOR).select("a", "b")
    with settings(pairs.sparkSession, SMALL_BATCHES):
        return materialise(beside(similar, "text").select("a", "b", "text_a", "text_b").mapInArrow(task("jaccard", _with_words), "a long, b long"), "verified")


def components(links: DataFrame) -> DataFrame:
    """(id, label) of every linked set: the smallest id that its links reach.

    Every round takes the smallest label among the neighbours, then the label of that label, so
    chains shorten by halves.
    """
    both = materialise(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    many = both.count() > HOT_ROWS
    hot = hot_keys_of(both, ["b"])
    labels = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near")).select("id", F.least("id", "near").alias("label"))
    labels = materialise(labels, "labels")
    while True:
        near = split_join(both, labels.select(F.col("id").alias("b"), "label"), ["b"], "a", hot).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, F.col("id") == F.col("a")).select("id", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("label").alias("jumped"))
        common = None
        if many:
            lower = materialise(lower, "labels")
            common = hot_keys_of(lower, ["low"])
        moved = materialise(split_join(lower, jump, ["low"], "id", common).select("id", "label", F.least("low", "jumped").alias("to")), "labels")
        changed = not moved.where("label <> to").isEmpty()
        labels = moved.select("id", F.col("to").alias("label"))
        if not changed:
            return labels


def _parts() -> Column:
    """In how many parts the rows of a shingle are dealt."""
    return F.ceil(F.col("df") / HOT_ROWS).cast("int")


def _dealt(entries: DataFrame) -> DataFrame:
    return entries.withColumn("part", F.pmod(F.xxhash64("set_id"), _parts()).cast("int"))


def _to_all_parts(by_token: DataFrame) -> DataFrame:
    return by_token.withColumn("part", F.explode(F.sequence(F.lit(0), _parts() - 1))).drop("df")


def _entries(prefixed: DataFrame, *more: str) -> DataFrame:
    """The index: one row per prefix shingle of a set, with its place in the set's order."""
    each = prefixed.select("set_id", "n", "alone", *more, F.posexplode("prefix").alias("k", "p"))
    return each.select("p.token", "p.df", "set_id", "n", "alone", (F.col("alone") + F.col("k")).alias("place"), *more)


def _couples(index: DataFrame) -> DataFrame:
    """(token, label_a, label_b) of the components that share a shingle and may have similar members.

    The components of a frequent shingle are dealt in parts, and every pair of parts meets in a task of its own.
    """
    by_label = index.groupBy("token", "label").agg(F.max("df").alias("df"), F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.max(F.col("n") - F.col("place")).alias("most"))
    own = by_label.withColumn("part", F.pmod(F.xxhash64("label"), _parts()).cast("int"))
    columns = ("label", "least_n", "most_n", "most")
    x = own.select("token", *[F.col(c).alias(f"{c}_a") for c in columns], F.col("part").alias("i"), F.explode(F.sequence(F.col("part"), _parts() - 1)).alias("j"))
    y = own.select("token", *[F.col(c).alias(f"{c}_b") for c in columns], F.explode(F.sequence(F.lit(0), F.col("part"))).alias("i"), F.col("part").alias("j"))
    # Components whose sizes or positions rule out every pair of members aren't expanded.
    fits = (F.col("most_n_a") * DENOMINATOR >= F.col("least_n_b") * NUMERATOR) & (F.col("most_n_b") * DENOMINATOR >= F.col("least_n_a") * NUMERATOR)
    fits = fits & (F.least("most_a", "most_b") * (NUMERATOR + DENOMINATOR) >= (F.col("least_n_a") + F.col("least_n_b")) * NUMERATOR)
    return x.join(y, ["token", "i", "j"]).where(((F.col("i") < F.col("j")) | (F.col("label_a") < F.col("label_b"))) & fits).select("token", "label_a", "label_b")


def link_sets(reps: DataFrame, tokens: DataFrame) -> DataFrame:
    """(id, label) of every set that is similar to another, by connected component."""
    spark = tokens.sparkSession
    own = prefixes(reps, tokens)
    # Sets with an unshared shingle in the prefix can't have it in common with another set.
    full = own.where("alone = 0").select("set_id", F.col("n").alias("size"), F.col("prefix.token").alias("prefix"))
    heads = full.groupBy("size", "prefix").agg(F.min("set_id").alias("head"), F.count(F.lit(1)).alias("members")).where("members > 1").drop("members")
    grouped = split_join(full, heads, ["size", "prefix"], "set_id", hot_keys_of(full, ["size", "prefix"])).where("set_id <> head").select("set_id", "head")
    grouped = materialise(grouped, "groups")
    index = _entries(own.join(grouped.select("set_id"), "set_id", "left_anti")).withColumn("label", F.col("set_id"))
    pairs = grouped.select(F.col("set_id").alias("a"), F.col("head").alias("b"))
    links, labels, tried = None, None, None
    for turn in range(PIVOT_ROUNDS + 1):
        if labels is not None:
            # From now on single members, and only shingles that sets of several components have.
            labelled = own.join(labels.withColumnRenamed("id", "set_id"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
            entries = _dealt(_entries(labelled, "label"))
            several = entries.groupBy("token").agg(F.min("label").alias("l"), F.max("label").alias("h"), F.max("df").alias("df")).where("l < h").select("token", "df")
            index = materialise(entries.join(_to_all_parts(several), ["token", "part"]).drop("part"), "index")
            if index.isEmpty():
                break
        entry = F.struct("set_id", "n", "place", "label")
        if turn == PIVOT_ROUNDS:
            met = _couples(index).join(index.select("token", F.col("label").alias("label_a"), entry.alias("p")), ["token", "label_a"])
            met = met.join(index.select("token", F.col("label").alias("label_b"), entry.alias("q")), ["token", "label_b"])
        else:
            # First the set with the fewest unshared shingles, as most similar sets are similar to it; then that of another component.
            order = F.struct("alone", F.xxhash64("set_id")) if turn == 0 else F.struct(F.xxhash64("label", F.lit(turn)), F.col("alone"), F.col("set_id"))
            pivot = _to_all_parts(index.groupBy("token").agg(F.min_by(entry, order).alias("q"), F.max("df").alias("df")))
            met = _dealt(index).select("token", "part", entry.alias("p")).join(pivot, ["token", "part"]).where("p.label <> q.label")
        met = met.where(_may_be_similar("p", "q")).select(F.greatest("p.set_id", "q.set_id").alias("a"), F.least("p.set_id", "q.set_id").alias("b"))
        pairs = (met if pairs is None else met.union(pairs)).distinct()
        pairs = materialise(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        found = verify(pairs, tokens) if not pairs.isEmpty() else pairs
        if not found.isEmpty():
            links = found if links is None else links.union(found)
            labels = components(links)
        elif labels is None:
            labels = spark.range(0).select("id", F.col("id").alias("label"))
        tried, pairs = pairs if tried is None else tried.union(pairs), None
    return labels


def linked_rows(staged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per staged row (locator, doc, n, ...) and, for those whose set may be similar to another's, also first: the component's first row."""
    sets = describe_sets(staged)
    reps, tokens = distinct_sets(staged, sets)
    labels = link_sets(reps, tokens)
    labelled = reps.drop("n").join(labels.withColumnRenamed("id", "set_id"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    labelled = materialise(labelled, "labelled")
    firsts = labelled.groupBy("label").agg(F.min("first").alias("first"))
    by_key = split_join(labelled.drop("first"), firsts, ["label"], "set_id", hot_keys_of(labelled, ["label"])).select("key_hi", "key_lo", "first")
    hot = hot_keys(reps.select("key_hi", "key_lo", F.col("members").alias("n")), ["key_hi", "key_lo"])
    return sets, split_join(is_alike(sets), by_key, ["key_hi", "key_lo"], "locator", hot)


def similarity_components(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach, itself included).

    Null, empty and white-space texts have an empty set and are linked with nothing. Repeated rows and
    equal sets are linked; a null doc_id stays null unless its component has one that isn't. Columns
    other than doc_id and text take no part. An empty table gives an empty result.
    """
    with scratch(docs.sparkSession):
        sets, alike = linked_rows(stage_rows(docs.select("doc_id", "text")))
        alone = sets.where(~((F.col("n") > 0) & (F.col("repeated") >= least_shared(F.col("n"))))).select("doc", "n", F.col("doc").alias("component"))
        every = alone.union(alike.select("doc", "n", F.coalesce("first.doc", "doc")))
        return keep(every.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id")), "components")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row per component: that with the smallest doc_id, null last; all its columns as they are.

    Of rows without a doc_id, or with the same one, any one stays, the same on every read of the
    result. Rows whose text is null, empty or white space all stay, as they are similar to nothing.
    """
    staged = stage_rows(docs)
    with scratch(docs.sparkSession):
        _, alike = linked_rows(staged)
        dropped = keep(alike.where(F.col("locator") != F.col("first.locator")).select("locator"), "near-copies")
    return staged.join(dropped, "locator", "left_anti").select("row.*")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT rid, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
c AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.rid <> b.rid GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n a ON a.rid = x JOIN n b ON b.rid = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
r AS (SELECT rid, rid AS other FROM w UNION SELECT r.rid, l.y FROM r JOIN l ON r.other = l.x),
m AS (SELECT r.rid, min(o.doc_id) AS component_id FROM r JOIN w o ON o.rid = r.other GROUP BY r.rid)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM w LEFT JOIN n USING (rid) JOIN m USING (rid)
"""
