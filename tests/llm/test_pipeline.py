import re
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from terragrain.llm import langid
from terragrain.llm.common import materialise, shared_dir

from . import test_jaccard, test_mixing, test_packing
from .cases import AWKWARD, documents


def test_stages_keep_the_columns_and_pack_everything(spark):
    docs = documents(spark, AWKWARD)
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "ngram_jaccard", "mix_sources", "best_fit_packing"]
    counts = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = materialise(stage(spark, docs, ""), name)
        counts.append(docs.count())
        assert k == len(names) - 1 or docs.columns == columns
    assert counts[0] >= counts[1] >= counts[2]
    packed = docs.collect()
    assert {p.doc_id for p in packed} <= {r[0] for r in AWKWARD}
    assert all(p.offset + p.length <= 2048 for p in packed)


def test_run_on_generated_documents(spark):
    packed = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert packed.count() > 0


def test_an_empty_table_gives_no_sequences(spark):
    docs = documents(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, ""), name)
    assert docs.count() == 0


def test_stages_equal_brute_force(spark):
    """Every stage on its own input, against the same rule in plain Python (the mix: in SQL)."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    # Near and exact copies beside the generated ones, ids that are missing or there twice, and rows that go at once.
    copies = table.where("doc_id < 40 AND length(text) > 400").select((F.col("doc_id") + 10_000).alias("doc_id"), F.concat("text", F.lit(" one more")).alias("text"), "lang", "source", "n_chars")
    awkward = documents(spark, AWKWARD).withColumn("doc_id", F.col("doc_id") + 100_000)
    docs = table.union(copies).union(awkward).union(copies.limit(3).withColumn("doc_id", F.lit(None).cast("long")))
    docs = materialise(docs, "all")
    rows = [tuple(r) for r in docs.collect()]

    def stage(name, held):
        nonlocal docs
        docs = materialise(dict(corpus_pipeline.STAGES)[name](spark, docs, ""), name)
        return sorted(map(repr, map(tuple, docs.collect()))) if held else docs.collect()

    # Language: the winner's share of n-grams against what that language's own texts have.
    filters = langid.fit(docs)

    def identified(text):
        share, total = filters.shares([text or ""])
        n, best = int(total[0]), int(share[0].argmax())
        usual = langid.LEAST_SHARE * filters.own_share[best]
        return n > 0 and 0 < share[0][best] >= usual - langid.ERRORS * np.sqrt(usual * (1 - usual) * langid.DEPENDENT / n)

    rows = [r for r in rows if identified(r[1])]
    assert stage("language_id", True) == sorted(map(repr, rows))

    # Exact copies: one row of each text, with the smallest id. Rows with one id and text are alike.
    kept = {}
    for r in rows:
        kept.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), []).append(r)
    rows = [min(group, key=lambda r: (r[0] is None, r[0] or 0)) for group in kept.values()]
    got = stage("exact_dedup", False)
    assert sorted(repr((r.doc_id, r.text)) for r in got) == sorted(repr(r[:2]) for r in rows)

    # Near copies: one row of each component, with the smallest id.
    rows = [tuple(r) for r in got]
    numbered = [(k, *r[1:]) for k, r in enumerate(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)))]
    ids = sorted((r[0] for r in rows), key=lambda i: (i is None, i or 0))
    wanted = [ids[k] for k, n, component in test_jaccard.brute_force(numbered) if component == k]
    got = stage("ngram_jaccard", False)
    assert sorted(repr(r.doc_id) for r in got) == sorted(map(repr, wanted)) and len(got) < len(rows)

    # The mix: as often as its SQL says.
    rows = [tuple(r) for r in got]
    words = {repr(r[0]): len((r[1] or "").split()) for r in rows}
    planned = {repr(r[0]): r[4] // words[repr(r[0])] for r in test_mixing.in_sql(rows) if words[repr(r[0])]}
    got = stage("mix_sources", False)
    drawn = {}
    for r in got:
        drawn[repr(r.doc_id)] = drawn.get(repr(r.doc_id), 0) + 1
    assert {k: n for k, n in drawn.items() if words[k]} == {k: n for k, n in planned.items() if n}

    # Packing: every drawn row's ids, whole and once, in sequences that are nearly as few as they can be.
    packed = stage("best_fit_packing", False)
    sizes = sorted(len(test_packing.ids_of(r.text)) for r in got)
    by_sequence = {}
    for p in packed:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(p.length for p in packed) == sum(sizes)
    least = -(-sum(n % 2048 for n in sizes) // 2048) + sum(n // 2048 for n in sizes)
    assert least <= len(by_sequence) <= 1.05 * least + 1


def test_run_leaves_only_its_result(spark):
    before = {p.name for p in Path(shared_dir(spark).removeprefix("file://")).iterdir()}
    packed = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    after = {p.name for p in Path(shared_dir(spark).removeprefix("file://")).iterdir()}
    assert [n for n in after - before if n.startswith("pipeline-")] and all(n.startswith("pipeline-packed") for n in after - before)
    assert packed.count() > 0
