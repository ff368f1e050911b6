import hashlib
import re

from pyspark.sql import functions as F

from terragrain.llm import common, dedup

from .cases import AWKWARD, DOCUMENTS, documents


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), []).append(r[0])
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        for k, i in enumerate(sorted(ids, key=lambda i: (i is None, i or 0))):
            out.append((i, keep, len(ids), k == 0, sha))
    return sorted(out, key=repr)


def test_awkward_rows(spark):
    got = dedup.exact_dedup(documents(spark, clashing=True)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(map(tuple, got.collect()), key=repr) == expected(AWKWARD)


def test_colliding_digests_are_told_apart_by_their_bytes(spark):
    rows = [(i, f"text {i % 40}", "en", "a", 1) for i in range(200)]
    weak = dedup.decide(spark.createDataFrame(rows, DOCUMENTS), digest=lambda t: F.substring(F.md5(t), 1, 1))
    got = weak.select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows)


def test_large_groups_in_parts(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rows = [(i % 90 if i % 7 else None, f"text {i % 3 if i % 2 else i}", "en", "a", 1) for i in range(200)]
    for digest in (dedup.sha256_digest, lambda t: F.substring(F.md5(t), 1, 1)):
        got = dedup.decide(spark.createDataFrame(rows, DOCUMENTS), digest=digest).select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256")
        assert sorted(map(tuple, got.collect()), key=repr) == expected(rows)


def test_empty_table_and_columns(spark):
    assert dedup.exact_dedup(documents(spark, [])).count() == 0
    docs = documents(spark, clashing=True)
    kept = dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({r[4] for r in expected(AWKWARD)})


def test_state_takes_in_later_rows(spark, tmp_path):
    staged, state = f"{tmp_path}/staged", f"{tmp_path}/state"
    dedup.stage(documents(spark, [(5, "a", "en", "s", 1), (6, "b", "en", "s", 1)]), staged)
    dedup.update_state(spark, staged, state).collect()
    dedup.stage(documents(spark, [(3, "a", "en", "s", 1)]), staged)
    kept = {r["first"]["doc_id"]: r["group_size"] for r in dedup.update_state(spark, staged, state).collect()}
    assert kept == {3: 2, 6: 1}


def test_locators_tell_the_rows_of_all_calls_apart(spark, tmp_path):
    """A weak digest that says 'equal' of all texts: those of a later call are compared with the first call's."""
    staged, state = f"{tmp_path}/staged", f"{tmp_path}/state"
    weak = lambda t: F.substring(F.md5(t), 1, 0)
    for rows in ([(5, "a"), (6, "b")], [], [(3, "b"), (4, "c")], [(9, "a")]):
        dedup.stage(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), staged, digest=weak)
        whole = dedup.update_state(spark, staged, state)
    found = spark.read.parquet(staged)
    assert found.count() == found.select("locator").distinct().count() == 5
    (only,) = whole.collect()
    assert (only["first"]["doc_id"], only["group_size"]) == (3, 5)
    assert found.where(F.col("locator") == only["first"]["locator"]).first()["row"]["text"] == "b"
    assert sorted(r["full"] for r in dedup.compare_bytes(found, whole, None).collect()) == ["a", "a", "c"]
