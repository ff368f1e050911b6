import random
import re

import pytest

from terragrain.llm import common, jaccard

from .cases import AWKWARD, documents


def sets_of(rows):
    out = []
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        n = min(5, len(words))
        out.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set())
    return out


def brute_force(rows):
    sets = sets_of(rows)
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                parent[find(i)] = find(j)
    smallest = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            smallest[find(k)] = min(smallest.get(find(k), r[0]), r[0])
    return sorted([(r[0], len(sets[k]), smallest.get(find(k))) for k, r in enumerate(rows)], key=repr)


def got(df):
    return sorted(map(tuple, jaccard.similarity_components(df).select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def corpus(seed, bases=12, copies=14, words=60):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = r.choices(vocabulary, k=20)
    rows = []
    for _ in range(bases):
        base = r.choices(vocabulary, k=words) + (passage if r.random() < 0.6 else [])
        for _ in range(r.randint(1, copies)):
            own = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            if r.random() < 0.2:
                own = own[: r.randint(3, len(own))]
            rows.append((r.randrange(10_000), " ".join(own), "en", "a", 1))
    r.shuffle(rows)
    return list({row[0]: row for row in rows}.values())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    assert got(documents(spark, rows)) == brute_force(rows)


def test_many_small_batches_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BATCH_SHINGLES", 500)
    monkeypatch.setattr(jaccard, "BUCKET_BYTES", 2_000)
    rows = corpus(4)
    assert got(documents(spark, rows)) == brute_force(rows)


def test_only_texts_and_shingles_that_are_wanted_are_shuffled(spark, monkeypatch):
    """Where no side is small enough for a broadcast, a Bloom filter drops the other rows before the join."""
    plans = {}
    write = jaccard.materialise

    def watch(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(jaccard, "materialise", watch)
    rows = corpus(5)
    with common.settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        assert got(documents(spark, rows)) == brute_force(rows)
    assert plans["tokens"] and all("might_contain" in p for p in plans["tokens"])
    assert plans["paired-tokens"] and all("might_contain" in p for p in plans["paired-tokens"])


def test_awkward_rows(spark):
    assert got(documents(spark, clashing=True)) == brute_force(AWKWARD)


def test_chains_are_followed(spark):
    words = [f"v{k}" for k in range(140)]
    rows = [(100 - k, " ".join(words[4 * k : 4 * k + 80]), "en", "a", 1) for k in range(15)]
    assert got(documents(spark, rows)) == brute_force(rows)
    assert {r[2] for r in got(documents(spark, rows))} == {86}


def test_empty_table_and_stage(spark):
    assert got(documents(spark, [])) == []
    docs = documents(spark, corpus(5), clashing=True)
    kept = jaccard.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r[2] for r in brute_force(corpus(5))}


def test_shingles_follow_the_bytes():
    (a, *key), (b, *other), (c, *_), (none, hi, lo) = jaccard.shingle_sets(["Éa b  Ab\tab", "Éa B ab\nAB ", "éa b ab ab", None])
    assert len(a) == 1 and a.tolist() == b.tolist() and key == other
    assert a.tolist() != c.tolist() and (len(none), hi, lo) == (0, 0, 0)


def test_long_texts_are_looked_up_in_parts(monkeypatch):
    text = " ".join(f"w{k % 97} x{k % 31}" for k in range(3000))
    whole = [s.tolist() for s, _, _ in jaccard.shingle_sets([text, "a b", text])]
    monkeypatch.setattr(jaccard, "PART_BYTES", 50)
    monkeypatch.setattr(jaccard, "WORDS_AT_ONCE", 20)
    assert [s.tolist() for s, _, _ in jaccard.shingle_sets([text, "a b", text])] == whole


def thue_morse(n):
    return "".join("ab"[bin(k).count("1") % 2] for k in range(n))


def test_words_that_collide_under_polynomials_stay_apart(spark):
    word = thue_morse(2048)
    rows = [(1, word, "en", "a", 1), (2, word.translate(str.maketrans("ab", "ba")), "en", "a", 1)]
    assert got(documents(spark, rows)) == brute_force(rows) == [(1, 1, 1), (2, 1, 2)]


def test_an_id_of_minus_one_beside_missing_ids(spark):
    base = [f"q{k}" for k in range(60)]
    rows = [(-1, " ".join([*base[:-1], "x"]), "en", "a", 1), (-5, " ".join(base), "en", "a", 1), (None, "apart from all the others here", "en", "a", 1), (None, " ".join([*base[:-1], "y"]), "en", "a", 1)]
    docs = documents(spark, rows)
    assert got(docs) == brute_force(rows)
    assert sorted(map(repr, (r.doc_id for r in jaccard.keep_one_of_each(docs).collect()))) == ["-5", "None"]


def test_rows_without_ids_are_reduced_to_one_of_each(spark):
    base = [f"q{k}" for k in range(60)]
    rows = [(None, " ".join([*base[:k], "x", *base[k + 1 :]]), "en", "a", 1) for k in range(10, 20)] + [(7, "some other words that stand alone", "en", "a", 1)] * 3 + [(None, None, "en", "a", 1)] * 2
    kept = jaccard.keep_one_of_each(documents(spark, rows)).collect()
    assert sorted(repr(r.doc_id) for r in kept) == ["7", "None", "None", "None"]


def test_many_rows_without_ids(spark):
    docs = spark.range(100_000).selectExpr("CAST(NULL AS LONG) AS doc_id", "concat('word', id % 50000, ' and some more of ', id % 50000) AS text")
    out = jaccard.similarity_components(docs)
    assert out.count() == 100_000 and out.where("component_id IS NOT NULL").count() == 0
    assert jaccard.keep_one_of_each(docs).count() == 50_000


def test_a_large_group_of_near_copies(spark):
    # Each has one word of its own in 120, so all are alike, and most shingles are everybody's.
    docs = spark.range(20_000).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 120), k -> if(k = 1 + id % 120, concat('own', id), concat('base', k)))) AS text")
    assert [tuple(r) for r in jaccard.similarity_components(docs).groupBy("component_id").count().collect()] == [(0, 20_000)]
    assert [r.doc_id for r in jaccard.keep_one_of_each(docs).collect()] == [0]


@pytest.mark.parametrize("seed", [6, 7])
def test_frequent_shingles_and_pivots_in_parts(spark, monkeypatch, seed):
    monkeypatch.setattr(jaccard, "HOT_ROWS", 3)
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    rows = corpus(seed)
    assert got(documents(spark, rows)) == brute_force(rows)


@pytest.mark.parametrize("seed", [8, 9])
def test_without_pivots_all_is_compared(spark, monkeypatch, seed):
    monkeypatch.setattr(jaccard, "PIVOT_ROUNDS", 0)
    monkeypatch.setattr(jaccard, "HOT_ROWS", 3)
    rows = corpus(seed)
    assert got(documents(spark, rows)) == brute_force(rows)
