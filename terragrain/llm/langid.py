"""Language identification with language-bitmask n-gram filters.

Training keeps, per language, the character n-grams that are typical of it, and writes them into one
bit-sliced Bloom filter: every slot is a bitmask over the languages, and the masks in an n-gram's
slots, combined with AND, are the languages that (may) contain it. A text's n-grams are looked up all
at once; the hits per language are corrected for the filter's false positives, and the language
with the largest corrected share wins.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .common import SMALL_BATCHES, materialise, scratch, settings, stay_small, task, text_slices

ORDERS = (2, 3, 4)
#: Labelled documents per language that training reads, in expectation.
SAMPLE_DOCS = 2_000
#: An n-gram is typical of a language where its rate is at least this share of its highest rate.
TYPICAL = 0.5
#: N-grams below this rate in a language aren't typical of it.
LEAST_RATE = 2e-6
#: Slots of the filter per n-gram and hash that it holds, and slots at least (as a power of 2).
ROOM, LEAST_SLOTS_LOG2 = 8, 16
HASHES = 2
#: A text is rejected where its winner's share of n-grams lies, by this many standard errors, below
#: LEAST_SHARE of what the language's own texts have. Overlapping n-grams count as one of DEPENDENT.
LEAST_SHARE, ERRORS, DEPENDENT = 0.5, 4.0, 6
#: Characters that one vectorised pass looks at: some 300 bytes of a Python worker's memory each.
CHARS_AT_ONCE = 1 << 16


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Per code point the lower-case letter, 0 where it is no letter."""
    table = np.zeros(sys.maxunicode + 1, dtype=np.uint32)
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        if ch.isalpha() and unicodedata.category(ch)[0] == "L":
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def _grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice of the texts: hashes of all n-grams, the text each is of, and the letters of each text.

    Runs of letters are words with one border before and after; an n-gram holds at most one border
    at either end. Long texts come in several overlapping slices, so memory is bounded; an n-gram
    belongs to the slice that its last character is new in, so none is lost or counted twice.
    """
    table, most = letters(), max(ORDERS)
    parts: list[tuple[int, np.ndarray, int]] = []  # the text, its characters, and how many of them an earlier slice had
    held = 0

    def flush():
        joined = np.concatenate([p for _, p, _ in parts])
        sizes = [len(p) for _, p, _ in parts]
        owner = np.repeat(np.array([k for k, _, _ in parts], dtype=np.int64), sizes)
        part = np.repeat(np.arange(len(parts)), sizes)
        new = np.concatenate([np.arange(len(p)) >= had for _, p, had in parts])
        hashes, owners = [], []
        for n in ORDERS:
            if len(joined) < n:
                continue
            ends = len(joined) - n + 1
            h = np.full(ends, n, dtype=np.uint64)
            ok = (part[:ends] == part[n - 1 :]) & new[n - 1 :]
            for k in range(n):
                col = joined[k : k + ends]
                h = (h ^ col) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
                if 0 < k < n - 1:
                    ok &= col != 0
            ok &= (joined[:ends] != 0) | (joined[n - 1 :] != 0)
            hashes.append(h[ok])
            owners.append(owner[:ends][ok])
        return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.concatenate(owners) if owners else np.zeros(0, np.int64)

    for k, text in enumerate(texts):
        for at in range(0, len(text), CHARS_AT_ONCE):
            first, last = max(0, at - most + 1), min(at + CHARS_AT_ONCE, len(text))
            own = table[np.frombuffer(text[first:last].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
            border = np.zeros(1, dtype=np.uint32)
            before, after = [border] if first == 0 else [], [border] if last == len(text) else []
            parts.append((k, np.concatenate([*before, own, *after]).astype(np.uint64), at - first + len(before) if at else 0))
            held += len(own)
            if held >= CHARS_AT_ONCE:
                yield flush()
                parts, held = [], 0
    if parts:
        yield flush()


def slots_of(hashes: np.ndarray, slots_log2: int) -> list[np.ndarray]:
    """The filter slots of n-grams: the top bits of the hash and of its multiples."""
    shift = np.uint64(64 - slots_log2)
    mixed = hashes
    out = []
    for k in range(HASHES):
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93 + 2 * k)
        out.append((mixed >> shift).astype(np.int64))
    return out


@dataclass
class LanguageFilters:
    """languages: their names, by bit. slots: the bit-sliced filter, one row of 64-bit masks per slot.

    own_share: per language, the corrected share of n-grams that its own labelled texts have on average.
    """

    languages: list[str]
    slots: np.ndarray
    own_share: np.ndarray | None = None

    @property
    def slots_log2(self) -> int:
        return len(self.slots).bit_length() - 1

    @property
    def false_positive(self) -> np.ndarray:
        """Per language, how likely an n-gram that it lacks seems to be in it: its fill to the power of the hashes."""
        filled = [((self.slots[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(self.languages))]
        return np.array(filled) ** HASHES

    def shares(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text and language the corrected share of n-grams, and per text the number of n-grams."""
        hits = np.zeros((len(texts), len(self.languages)))
        total = np.zeros(len(texts))
        for hashes, owner in _grams(texts):
            masks = None
            for s in slots_of(hashes, self.slots_log2):
                masks = self.slots[s] if masks is None else masks & self.slots[s]
            total += np.bincount(owner, minlength=len(texts))
            for k in range(len(self.languages)):
                bit = (masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)
                hits[:, k] += np.bincount(owner, weights=bit, minlength=len(texts))
        f = self.false_positive
        share = hits / np.maximum(total, 1)[:, None]
        return np.clip((share - f) / np.maximum(1 - f, 1e-9), 0, 1), total


def count_grams(sample: DataFrame) -> DataFrame:
    """(gram, bit, n): how often the n-grams are in the texts of each language (text, bit)."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            bits = np.array(batch.column("bit").to_pylist(), dtype=np.int64)
            for hashes, owner in _grams(batch.column("text").to_pylist()):
                for b in np.unique(bits[owner]):
                    gram, n = np.unique(hashes[bits[owner] == b], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(np.full(len(gram), b, np.int32)), pa.array(n.astype(np.int64))], names=["gram", "bit", "n"])

    counted = sample.mapInArrow(task("langid", count), "gram long, bit int, n long").groupBy("gram", "bit").agg(F.sum("n").alias("n"))
    with settings(sample.sparkSession, SMALL_BATCHES):
        return materialise(counted, "lang-grams")


def typical_grams(counted: DataFrame) -> DataFrame:
    """(gram, bit) of the n-grams that are typical of a language: the contents of its filter."""
    totals = counted.groupBy("bit").agg(F.sum("n").alias("total"))
    rated = counted.join(F.broadcast(totals), "bit").withColumn("rate", F.col("n") / F.col("total"))
    highest = F.max("rate").over(Window.partitionBy("gram"))
    typical = rated.withColumn("highest", highest).where((F.col("rate") >= TYPICAL * F.col("highest")) & (F.col("rate") >= LEAST_RATE) & (F.col("n") >= 3))
    return materialise(typical.select("gram", "bit"), "lang-typical")


def fill_slots(typical: DataFrame, languages: int) -> np.ndarray:
    """The bit-sliced filter of the typical n-grams; a sample has boundedly many of them, and so many slots."""
    held = typical.select("gram").distinct().count()
    slots_log2 = max(LEAST_SLOTS_LOG2, (ROOM * HASHES * held).bit_length())

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column("gram").to_numpy().view(np.uint64)
            bits = batch.column("bit").to_numpy()
            for s in slots_of(grams, slots_log2):
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(bits // 64), pa.array(np.left_shift(np.int64(1), bits % 64))], names=["slot", "word", "mask"])

    masks = typical.mapInArrow(place, "slot long, word int, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask"))
    slots = np.zeros((1 << slots_log2, -(-languages // 64)), dtype=np.uint64)
    found = masks.toArrow()
    slots[found["slot"].to_numpy(), found["word"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
    return slots


def own_shares(sample: DataFrame, filters: LanguageFilters) -> np.ndarray:
    """Per language the mean share that the labelled texts (text, bit) have of its n-grams."""
    sent = sample.sparkSession.sparkContext.broadcast(filters)

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            bits = np.array(batch.column("bit").to_pylist(), dtype=np.int64)
            share, total = sent.value.shares(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(bits[total > 0].astype(np.int32)), pa.array(share[np.arange(len(bits)), bits][total > 0])], names=["bit", "share"])

    found = sample.mapInArrow(task("langid", measure), "bit int, share double").groupBy("bit").agg(F.avg("share").alias("share")).toArrow()
    out = np.zeros(len(filters.languages))
    out[found["bit"].to_numpy()] = found["share"].to_numpy()
    return out


def train(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> LanguageFilters:
    """Learns from (text, lang, key) rows; ``key`` decides which rows are in the bounded sample.

    About ``sample_docs`` documents per language are read, the same on every run. What comes to the
    driver is the list of languages and at most one mask per slot and language word.
    """
    spark = labelled.sparkSession
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return LanguageFilters([], np.zeros((1 << LEAST_SLOTS_LOG2, 1), dtype=np.uint64))
    # From Arrow columns; rows of Python objects would start Python workers that only read them, and stay for a while.
    chances = [pa.array(languages, pa.string()), pa.array([min(1.0, sample_docs / counts[x]) for x in languages]), pa.array(range(len(languages)), pa.int32())]
    chance = spark.createDataFrame(pa.table(chances, names=["lang", "chance", "bit"]))
    chosen = F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < F.col("chance") * (1 << 20)
    with scratch(spark):
        sample = materialise(labelled.join(F.broadcast(chance), "lang").where(chosen).select("text", "bit"), "lang-sample")
        filters = LanguageFilters(languages, fill_slots(typical_grams(count_grams(sample)), len(languages)))
        with settings(spark, SMALL_BATCHES):
            filters.own_share = own_shares(sample, filters)
    return filters


def predict(docs: DataFrame, filters: LanguageFilters) -> DataFrame:
    """Adds lang_pred, score and clear to ``docs``: ``und``, 0 and false where text is null or has no letter.

    The text is the column ``text``, which goes, or the field ``text`` of a struct ``row``, which
    stays. ``score`` is the winner's part of all languages' corrected shares. Ties go to the first
    language. ``clear`` tells whether the text has as many of the winner's n-grams as that language's
    texts have: false where there is none, or where the share lies significantly below LEAST_SHARE of
    what is usual for the text's number of n-grams, as in random letters and languages never learnt.
    """
    sent = docs.sparkSession.sparkContext.broadcast(filters)
    names = [c for c in docs.columns if c != "text"]
    apart = "text" in docs.columns
    text_of = (lambda batch: batch.column("text")) if apart else (lambda batch: batch.column("row").field("text"))

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in text_slices(batches, rows=max(1, min(256, (1 << 16) // max(len(own.languages), 1))), text=text_of):
            texts = [t or "" for t in text_of(batch).to_pylist()]
            share, total = own.shares(texts) if own.languages else (np.zeros((len(texts), 1)), np.zeros(len(texts)))
            best = share.argmax(axis=1)
            top = share[np.arange(len(texts)), best]
            score = np.where(total > 0, top / np.maximum(share.sum(axis=1), 1e-12), 0.0)
            usual = LEAST_SHARE * (own.own_share[best] if own.languages else np.ones(len(texts)))
            clear = (top > 0) & (top >= usual - ERRORS * np.sqrt(usual * (1 - usual) * DEPENDENT / np.maximum(total, 1)))
            named = [own.languages[b] if n and own.languages else "und" for b, n in zip(best.tolist(), total.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(named, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(clear)], names=[*names, "lang_pred", "score", "clear"])

    schema = StructType([f for f in docs.schema if f.name != "text"] + [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("clear", BooleanType())])
    return docs.mapInArrow(task("langid", judge), schema)


def held_out(docs: DataFrame):
    """The condition that keeps a document out of training: crc32 of its id, as text, leaves 2 by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame) -> LanguageFilters:
    """Filters learnt from the text and lang of the documents that aren't held out."""
    return train(docs.where(~held_out(docs)).select("text", "lang", F.col("doc_id").cast("string").alias("key")))


def identify_language(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score.

    The prediction reads the whole text and nothing else. Null or empty text and text without a letter
    give ``und`` with score 0, as does every text where nothing is labelled; repeated rows are judged
    alike; an empty table gives an empty result.
    """
    rows = docs.select("doc_id", held_out(docs).alias("held_out"), "text")
    return predict(rows, fit(docs)).drop("clear")


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents whose language can't be told: ``und``, or not ``clear`` (see ``predict``).

    That drops null and empty texts, texts without letters, texts with none of the winner's n-grams,
    and texts long enough to tell that they have too few of them. Short texts with little evidence stay.

    Whole rows go through Python while the caller reads the result, so the session's Arrow batches are
    small from then on (``stay_small``).
    """
    stay_small(docs.sparkSession)
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    return predict(packed, fit(docs)).where((F.col("lang_pred") != "und") & F.col("clear")).select("row.*")
