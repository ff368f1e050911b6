"""Personal data, and the terms that reveal it.

Patterns find the protected entities. Over all texts of the corpus, counts of the texts that hold an
entity, a term and both tell how strongly the term points at the entity: its pointwise mutual
information with the entity, against all the information that names the entity. A term that discloses
most of it, in several different contexts, is a span too wherever it stands, and is generalised.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_keys_of, keep, materialise, scratch, split_join, task, text_slices

KINDS = ("email", "ip", "card", "phone", "term")
#: Share of an entity's information from which on a term discloses it, and different contexts that must agree.
DISCLOSED = 0.8
SUPPORT = 3
#: Words of the same line on either side of an entity that tell its contexts apart; None: the whole line.
NEAR = 8
#: Bits of a bitmap, and partial counts that a task holds at a time.
BITS_LOG2 = 24
COUNTS_AT_ONCE = 200_000

# The base patterns; quantifiers that can't give back keep long runs linear.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all protected entities, by kind and start."""
    found: list[tuple[int, int, int]] = []
    if "@" in text:
        free = 0  # an address starts behind the last one
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                found.append((0, start, m.end()))
                free = m.end()
    if _DIGIT.search(text):
        found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(own := p.lstrip("0")) <= 3 and int(own or "0") <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
        if "+" in text:
            found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return found


def _outside(spans: list[tuple[int, int, int]]) -> Callable[[re.Match], bool]:
    """Whether a match overlaps none of the spans."""
    starts, ends = [], []  # of the spans, merged
    for start, end in sorted((s, e) for _, s, e in spans):
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)

    def apart(m: re.Match) -> bool:
        k = bisect_right(ends, m.start())
        return k == len(ends) or m.end() <= starts[k]

    return apart


def terms_of(text: str, spans: list[tuple[int, int, int]]) -> set[str]:
    """The different terms of the whole text that overlap no entity."""
    if not spans:
        return {w.lower() for w in set(_TERM.findall(text))}
    apart = _outside(spans)
    return {m.group().lower() for m in _TERM.finditer(text) if apart(m)}


def contexts(text: str, spans: list[tuple[int, int, int]], near: int | None = NEAR) -> list[tuple[int, int]]:
    """Per entity: its hash, and the hash of the words near it on its line (terms only tell contexts apart here)."""
    out: list[tuple[int, int]] = []
    terms, starts, line_ends = None, [], -1
    for kind, start, end in sorted(spans, key=lambda s: s[1]):
        entity = xxhash.xxh64_intdigest(f"{kind}:{text[start:end].lower()}") >> 1
        if terms is None or start >= line_ends:  # every line is split once
            left = text.rfind("\n", 0, start) + 1
            line_ends = text.find("\n", end)
            line_ends = len(text) if line_ends < 0 else line_ends
            apart = _outside(spans)
            terms = [(m.start(), m.group().lower()) for m in _TERM.finditer(text, left, line_ends) if apart(m)]
            starts = [at for at, _ in terms]
        k = bisect_right(starts, start)
        first, last = (0, len(terms)) if near is None else (max(0, k - near), k + near)
        out.append((entity, xxhash.xxh64_intdigest(" ".join(t for _, t in terms[first:last])) >> 1))
    return out


def _scan(near: int | None, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text with an entity: copies, and its entities with their contexts."""
    pair = pa.list_(pa.struct([("entity", pa.int64()), ("context", pa.int64())]))
    for part in text_slices(batches):
        copies, entities = [], []
        for text, n in zip(part.column("text").to_pylist(), part.column("copies").to_pylist(), strict=True):
            if spans := base_spans(text or ""):
                copies.append(n)
                entities.append([{"entity": e, "context": c} for e, c in contexts(text, spans, near)])
        yield pa.RecordBatch.from_arrays([pa.array(copies, pa.int64()), pa.array(entities, pair)], names=["copies", "entities"])


def with_copies(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` with ``copies``, the number of rows of the same text, and the number of different texts."""
    digest = [F.xxhash64("text").alias("d0"), F.xxhash64(F.lit(1), "text").alias("d1")]
    texts = materialise(rows.where(F.col("text").isNotNull()).select(*digest).groupBy("d0", "d1").agg(F.count(F.lit(1)).alias("copies")), "pii-texts")
    copied = materialise(texts.where(F.col("copies") > 1), "pii-copied")
    return rows.select("*", *digest).join(copied, ["d0", "d1"], "left").drop("d0", "d1").withColumn("copies", F.coalesce("copies", F.lit(1)).cast("long")), texts.count()


def _bits(hashes: DataFrame) -> bytes:
    """A bitmap of fixed size of the column ``hash``: a value whose bit is clear isn't among them."""
    slot = F.pmod("hash", F.lit(1 << BITS_LOG2))
    masks = hashes.select(slot.alias("slot")).groupBy(F.expr("slot div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("mask"))
    found, words = masks.toArrow(), np.zeros(1 << (BITS_LOG2 - 6), dtype="<u8")
    words[found["word"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
    return words.tobytes()


def _among(bits: bytes, value: int) -> int:
    return bits[(value >> 3) & ((1 << (BITS_LOG2 - 3)) - 1)] >> (value & 7) & 1


def count_terms(rows: DataFrame, entities: DataFrame, near: int | None = NEAR) -> DataFrame:
    """Partial counts over whole texts (entity, context, term, n): of texts with the term, where entity is null, else of those with both.

    ``rows`` has text and copies, and copies of a text count once together. Only pairs with the
    ``entities`` (and a few more) are counted; of several contexts in a text, the first has the count.
    """
    sent = rows.sparkSession.sparkContext.broadcast(_bits(entities.select(F.col("entity").alias("hash"))))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, counts, alone = sent.value, {}, {}

        def flush() -> pa.RecordBatch:
            pairs = [*counts, *((None, None, term) for term in alone)]
            keys = [pa.array([k[at] for k in pairs], kind) for at, kind in enumerate((pa.int64(), pa.int64(), pa.string()))]
            out = pa.RecordBatch.from_arrays([*keys, pa.array([*counts.values(), *alone.values()], pa.float64())], names=["entity", "context", "term", "n"])
            counts.clear()
            alone.clear()
            return out

        for part in text_slices(batches):
            for text, copies in zip(part.column("text").to_pylist(), part.column("copies").to_pylist(), strict=True):
                spans = base_spans(text or "")
                terms = terms_of(text or "", spans)
                share, before = 1 / copies, alone.get
                for term in terms:
                    alone[term] = before(term, 0.0) + share
                met = set()
                for entity, context in dict.fromkeys(contexts(text, spans, near)) if spans else ():
                    if _among(bits, entity):
                        for term in terms:
                            counts[entity, context, term] = counts.get((entity, context, term), 0.0) + (0.0 if entity in met else share)
                        met.add(entity)
                        if len(counts) >= COUNTS_AT_ONCE:
                            yield flush()
                if len(counts) + len(alone) >= COUNTS_AT_ONCE:
                    yield flush()
        if counts or alone:
            yield flush()

    return rows.select("text", "copies").mapInArrow(task("pii", count), "entity long, context long, term string, n double")


def disclosing_terms(rows: DataFrame, total: int, disclosed: float = DISCLOSED, support: int = SUPPORT, near: int | None = NEAR) -> DataFrame:
    """(entity, term) where the term discloses the entity.

    All counts are of different whole texts of the corpus, ``total`` in all: those with the entity,
    with the term and with both. Copies of a text count once. Both must also be together where the
    ``near`` words around the entity differ, ``support`` times; all words of the text count as terms.
    """
    once = F.round(F.sum(F.lit(1.0) / F.col("copies")))
    met = materialise(rows.select("text", "copies").mapInArrow(task("pii", partial(_scan, near)), "copies long, entities array<struct<entity:bigint,context:bigint>>"), "pii-entities-met")
    by_entity = met.select("copies", F.explode(F.array_distinct(F.col("entities.entity"))).alias("entity")).groupBy("entity").agg(once.alias("of_entity"))
    around = met.select(F.explode("entities").alias("e")).select("e.*").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("contexts"))
    # An entity of fewer texts or contexts than ``support`` can't have a term with as many.
    entities = materialise(by_entity.where(F.col("of_entity") >= support).join(around.where(F.col("contexts") >= support).select("entity"), "entity"), "pii-entities")
    if entities.isEmpty():
        return rows.sparkSession.createDataFrame([], "entity long, term string")
    counts = materialise(count_terms(rows, entities, near), "pii-counts")
    by_term = counts.where(F.col("entity").isNull()).groupBy("term").agg(F.round(F.sum("n")).alias("of_term"))
    by_context = counts.where(F.col("entity").isNotNull()).groupBy("entity", "term", "context").agg(F.sum("n").alias("n"))
    both = by_context.groupBy("entity", "term").agg(F.round(F.sum("n")).alias("both"), F.count(F.lit(1)).alias("contexts")).where((F.col("both") >= support) & (F.col("contexts") >= support))
    # What a term tells of an entity is log(total * both / (of_entity * of_term)); the entity's own information is log(total / of_entity).
    joined = both.join(entities, "entity").join(by_term, "term")
    tells = F.log2(F.lit(float(max(total, 1))) * F.col("both") / (F.col("of_entity") * F.col("of_term")))
    names = F.log2(F.lit(float(max(total, 1))) / F.col("of_entity"))
    return materialise(joined.where((names > 0) & (tells >= disclosed * names)).select("entity", "term"), "pii-told")


_MARKED = "row_id long, doc_id long, spans array<struct<kind:int,start:int,end:int>>, words array<struct<term:string,start:int,end:int>>"


def mark(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Per row: row_id, doc_id, spans of the entities, and words: all places of the ``terms`` (and of a few more) in the whole text."""
    sent = rows.sparkSession.sparkContext.broadcast(_bits(terms.select(F.xxhash64("term").alias("hash"))))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
        word = pa.list_(pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        bits = sent.value
        some = any(bits)
        clear: set[str] = set()  # words that are no such terms
        for part in text_slices(batches):
            spans, words = [], []
            for text in part.column("text").to_pylist():
                own = base_spans(text or "")
                spans.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in own])
                # 42 is the seed of Spark's xxhash64.
                fresh = set(_TERM.findall(text or "")) - clear if some else ()
                told = {t for t in {w.lower() for w in fresh} if _among(bits, xxhash.xxh64_intdigest(t, 42))}
                if len(clear) >= COUNTS_AT_ONCE:
                    clear.clear()
                clear.update(w for w in fresh if w.lower() not in told)
                apart = _outside(own)
                words.append([{"term": t, "start": m.start(), "end": m.end()} for m in _TERM.finditer(text) if (t := m.group().lower()) in told and apart(m)] if told else [])
            yield pa.RecordBatch.from_arrays([part.column("row_id"), part.column("doc_id"), pa.array(spans, span), pa.array(words, word)], names=["row_id", "doc_id", "spans", "words"])

    return rows.select("row_id", "doc_id", "text").mapInArrow(task("pii", scan), _MARKED)


def number_rows(docs: DataFrame) -> DataFrame:
    """The rows as a table of their own: row_id, which tells them apart, and row (their columns)."""
    return materialise(docs.select(F.monotonically_increasing_id().alias("row_id"), F.struct(*[F.col(c) for c in docs.columns]).alias("row")), "pii-rows")


def find_personal_data(docs: DataFrame, disclosed: float = DISCLOSED, support: int = SUPPORT, near: int | None = NEAR) -> DataFrame:
    """Per row of ``docs``: doc_id, spans (kind, start, end; by kind, then start), terms of the method included.

    A disclosing term is a span wherever it stands, whether or not its text names the entity. Null
    text is empty; repeated rows are scanned each; other columns take no part; an empty table gives
    an empty result. Places are code points, ends exclusive. Terms are words of 3 letters or more;
    entities named in fewer than ``support`` texts or contexts disclose nothing.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    with scratch(docs.sparkSession):
        return keep(_find(rows, disclosed, support, near), "personal-data").drop("row_id")


def _find(rows: DataFrame, disclosed: float, support: int, near: int | None) -> DataFrame:
    """Per row of ``rows`` (row_id, doc_id, text): row_id, doc_id, spans."""
    told = materialise(disclosing_terms(*with_copies(rows), disclosed, support, near).select("term").distinct(), "pii-terms")
    found = materialise(mark(rows, told), "pii-found")
    words = found.where(F.size("words") > 0).select("row_id", F.explode("words").alias("w")).select("row_id", "w.*")
    terms = split_join(words, told, ["term"], "row_id", hot_keys_of(words, ["term"])).groupBy("row_id").agg(F.sort_array(F.collect_set(F.struct(F.lit(4).alias("kind"), "start", "end"))).alias("terms"))
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    return found.select("row_id", "doc_id", "spans").join(terms, "row_id", "left").select("row_id", "doc_id", F.concat("spans", F.coalesce("terms", none)).alias("spans"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_personal_data(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (see ``find_personal_data``)."""

    def count(k: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    return find_personal_data(docs).select("doc_id", *[count(k) for k in range(4)], F.sha2(_joined(F.filter("spans", lambda s: s["kind"] < 4)), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def sanitise(docs: DataFrame, disclosed: float = DISCLOSED, support: int = SUPPORT, near: int | None = NEAR) -> DataFrame:
    """``docs`` with every entity and disclosing term of the text replaced by its kind in brackets.

    The rows are numbered first, so repeated and missing ids are told apart; a null text stays null.
    """
    staged = number_rows(docs)
    with scratch(docs.sparkSession):
        rows = staged.select("row_id", F.lit(None).cast("long").alias("doc_id"), F.col("row.text").alias("text"))
        spans = keep(_find(rows, disclosed, support, near).select("row_id", "spans"), "personal-data")

    def replace(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, texts = batch.column("row"), []
            for text, found in zip(row.field("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                out, at = [], 0
                for s in sorted(found or [], key=lambda s: (s["start"], -s["end"])):
                    if s["start"] >= at:
                        out += [text[at : s["start"]], f"[{KINDS[s['kind']]}]"]
                        at = s["end"]
                texts.append(None if text is None else "".join([*out, text[at:]]))
            names = [f.name for f in row.type]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else row.field(n) for n in names], names=names)

    return staged.join(spans, "row_id").select("row", "spans").mapInArrow(replace, docs.schema)
