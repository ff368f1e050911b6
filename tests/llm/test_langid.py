import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from terragrain.llm import common, langid

from .cases import AWKWARD, documents

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_range(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify_language(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_awkward_rows(spark):
    got = langid.identify_language(documents(spark, clashing=True)).collect()
    assert len(got) == len(AWKWARD)
    by_id = {r.doc_id: r for r in got}
    for i in (3, 4, 5, 7):
        assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0.0)
    assert by_id[None].held_out is False


def test_labels_of_held_out_documents_do_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    spoiled = docs.withColumn("lang", F.when(langid.held_out(docs), F.lit("xx")).otherwise(F.col("lang")))
    assert sorted(langid.identify_language(docs).collect()) == sorted(langid.identify_language(spoiled).collect())


def test_nothing_labelled_and_nothing_there(spark):
    assert {r.lang_pred for r in langid.identify_language(documents(spark, [(1, "some words", None, "a", 1)])).collect()} == {"und"}
    assert langid.identify_language(documents(spark, [])).count() == 0


def test_more_than_64_languages(spark):
    letters = [chr(0x4E00 + 3 * k) for k in range(70)]
    rows = [(4 * k + j, f"{c}{c}{c} {c}{c} " * 20, f"l{k:02d}", "a", 1) for k, c in enumerate(letters) for j in range(4)]
    got = langid.identify_language(documents(spark, rows)).collect()
    known = {r[0]: r[2] for r in rows}
    learnt = {known[r.doc_id] for r in got if not r.held_out}
    assert all(r.lang_pred == known[r.doc_id] for r in got if known[r.doc_id] in learnt)


def test_long_texts_lose_no_ngram(monkeypatch):
    text = "abc def, ghi! " * 50
    whole = [sorted(map(int, h)) for h, _, in [(g[0], g[1]) for g in langid._grams([text])]]
    monkeypatch.setattr(langid, "CHARS_AT_ONCE", 64)
    parts = {int(h) for g in langid._grams([text]) for h in g[0]}
    assert parts == set(whole[0])
    for at_once in (1, 2, 3, 5, 64, 699, 700, 701):
        monkeypatch.setattr(langid, "CHARS_AT_ONCE", at_once)
        assert sorted(int(h) for g in langid._grams([text]) for h in g[0]) == whole[0]


def test_filters_equal_exact_sets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    labelled = docs.where(~langid.held_out(docs) & F.col("lang").isNotNull())
    names = sorted(r.lang for r in labelled.select("lang").distinct().collect())
    bits = spark.createDataFrame([(n, k) for k, n in enumerate(names)], "lang string, bit int")
    exact = [set() for _ in names]
    for r in langid.typical_grams(langid.count_grams(labelled.join(bits, "lang").select("text", "bit"))).collect():
        exact[r.bit].add(r.gram)
    filters = langid.fit(docs)
    assert filters.languages == names and (filters.false_positive < 0.01).all()
    checked = 0
    for r in docs.collect():
        grams = [int(g) for part in langid._grams([r.text or ""]) for g in part[0].view(np.int64)]
        share, total = filters.shares([r.text or ""])
        assert total[0] == len(grams)
        if grams:
            wanted = np.array([sum(g in own for g in grams) / len(grams) for own in exact])
            error = 0.01 + 5 * np.sqrt(filters.false_positive.max() / len(grams))
            assert np.abs(share[0] - wanted).max() <= error
            if np.sort(wanted)[-1] - np.sort(wanted)[-2] > 2 * error:
                assert share[0].argmax() == wanted.argmax()
                checked += 1
    assert checked > 700


def test_long_texts_of_no_learnt_language_go_and_short_clean_ones_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    r = random.Random(1)
    junk = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(800)]
    odd = [
        (-1, " ".join(junk), "en", "x", 1),
        (-2, " ".join("".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(4)) for _ in range(500)), "en", "x", 1),
        (-3, "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9000)), "en", "x", 1),
        (-4, " ".join("".join(chr(r.randrange(0x430, 0x450)) for _ in range(7)) for _ in range(300)), "en", "x", 1),
    ]
    clean = [(-10 - k, text, "en", "x", 1) for k, text in enumerate(docs.where("lang = 'en' AND length(text) > 300").limit(1).first().text[:n] for n in (12, 20, 40, 80, 200))]
    kept = {r.doc_id for r in langid.keep_identified(docs.unionByName(documents(spark, odd + clean))).select("doc_id").collect()}
    assert not kept & {-1, -2, -3, -4}
    assert {c[0] for c in clean} <= kept


def test_pipeline_stage_keeps_columns_and_clean_rows(spark):
    docs = documents(spark, clashing=True)
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert {1, 2, 8, 11} <= ids and not {3, 4, 5, 7} & ids


def test_whole_rows_go_through_python_in_small_batches(spark):
    """Also where the caller computes the result, and no larger than the session's own."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.union(docs).union(docs).coalesce(1)

    def sizes(batches):
        yield pa.RecordBatch.from_pydict({"rows": [b.num_rows for b in batches]})

    def largest():
        return langid.keep_identified(docs).mapInArrow(sizes, "rows long").agg(F.max("rows")).first()[0]

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    with common.settings(spark, {key: "10000"}):
        assert 0 < largest() <= 1000
    with common.settings(spark, {key: "70"}):
        assert 0 < largest() <= 70


def test_training_starts_no_workers_for_rows_of_python_objects(spark, monkeypatch):
    plans = {}
    write = langid.materialise

    def watch(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(langid, "materialise", watch)
    langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    assert "lang-sample" in plans and "LogicalRDD" not in plans["lang-sample"]


def test_a_pass_over_letters_takes_little_memory():
    texts = ["".join(chr(97 + (k * k + i) % 26) for k in range(1 << 14)) for i in range(64)]
    filters = langid.LanguageFilters(["a", "b"], np.arange(1 << 16, dtype=np.uint64).reshape(-1, 1) & np.uint64(3))
    langid.letters()
    tracemalloc.start()
    filters.shares(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 32 << 20
