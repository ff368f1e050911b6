import duckdb
import pytest

from terragrain.llm import mixing

from .cases import AWKWARD, DOCUMENTS, documents

COLUMNS = ["doc_id", "size", "source_size", "target", "taken"]


def in_sql(rows):
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    return sorted([tuple(r) for r in con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({mixing.SQL})").fetchall()], key=repr)


def in_spark(df):
    return sorted(map(tuple, mixing.mix_sources(df).select(*COLUMNS).collect()), key=repr)


@pytest.mark.parametrize("rows", [AWKWARD, [(i, "w " * (i % 13), "en", f"s{i * i % 7}", 1) for i in range(300)], []])
def test_equals_sql(spark, rows):
    assert in_spark(documents(spark, rows, clashing=True)) == in_sql(rows)


@pytest.mark.parametrize("fan", [2, 3, 7])
def test_small_blocks_and_ranges(spark, monkeypatch, fan):
    monkeypatch.setattr(mixing, "FAN", fan)
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 60)
    rows = [(i, "w " * (i % 13), "en", "hot" if i % 3 else f"s{i % 5}", 1) for i in range(400)] + [(1000 + i, None, "en", "hot", 1) for i in range(200)]
    assert in_spark(documents(spark, rows)) == in_sql(rows)


def test_targets_caps_and_reruns(spark):
    rows = [(i, "w " * (1 + i % 17), "en", "hot" if i % 3 else f"s{i % 5}", 1) for i in range(2000)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    first = mixing.mix_sources(docs).collect()
    assert sorted(first) == sorted(mixing.mix_sources(docs.repartition(7)).collect())
    source = {r[0]: r[3] for r in rows}
    taken, target, size = {}, {}, {}
    for r in first:
        assert r.taken <= 3 * r.size
        s = source[r.doc_id]
        taken[s] = taken.get(s, 0) + r.taken
        target[s], size[s] = r.target, r.source_size
    assert sum(taken.values()) <= sum(size.values())
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    for s in taken:
        assert target[s] <= 3 * size[s]
        assert abs(taken[s] - target[s]) <= 2 * 17


def test_rows_without_an_id_come_near_their_targets(spark):
    rows = [(None, "w " * 9 + f"{s}{i}", "en", s, 1) for s in "ab" for i in range(100)]
    got = mixing.mix_sources(spark.createDataFrame(rows, DOCUMENTS)).collect()
    for target in {r.target for r in got}:
        assert abs(sum(r.taken for r in got if r.target == target) - target) <= 20
    assert in_spark(documents(spark, rows)) == in_sql(rows)


@pytest.mark.parametrize("alike, fan", [(3, 2), (7, 5), (1024, 4096)])
def test_rows_alike_are_units_of_their_own(spark, monkeypatch, alike, fan):
    """A third of all rows has one text and no id, others repeat an id, with one text or several."""
    monkeypatch.setattr(mixing, "ALIKE", alike)
    monkeypatch.setattr(mixing, "FAN", fan)
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 60)
    rows = [(None, "one text that is everywhere", "en", "hot", 1)] * 150 + [(7, "w " * (1 + i % 3), "en", "hot", 1) for i in range(60)]
    rows += [(i, "w " * (i % 13), "en", f"s{i % 3}" if i % 7 else None, 1) for i in range(200)] + [(9, "same", "en", "s1", 1)] * 30
    df = documents(spark, rows).repartition(5)
    got = in_spark(df)
    assert got == in_sql(rows)
    sums = {}
    for r in got:
        sums[r[2:4]] = sums.get(r[2:4], 0) + r[4]
    assert all(abs(taken - target) <= 26 for (_, target), taken in sums.items())
    drawn = mixing.draw_mix(df)
    planned = {}
    for r in got:
        planned[repr(r[0])] = planned.get(repr(r[0]), 0) + r[4]
    words = {}
    for r in drawn.select("doc_id", "text").collect():
        words[repr(r.doc_id)] = words.get(repr(r.doc_id), 0) + len((r.text or "").split())
    assert {i: n for i, n in words.items() if n} == {i: n for i, n in planned.items() if n}


def test_drawn_rows_keep_their_columns(spark):
    docs = documents(spark, clashing=True)
    drawn = mixing.draw_mix(docs)
    assert drawn.columns == docs.columns and drawn.count() > 0
    assert mixing.draw_mix(documents(spark, [], clashing=True)).count() == 0


def test_drawn_rows_repeat_as_planned(spark):
    docs = documents(spark, [(i, "w " * 10, "en", "big" if i < 90 else "small", 1) for i in range(100)])
    drawn = mixing.draw_mix(docs)
    assert drawn.columns == docs.columns
    planned = {r.doc_id: r.taken // 10 for r in mixing.mix_sources(docs).collect() if r.taken}
    assert {r["doc_id"]: r["count"] for r in drawn.groupBy("doc_id").count().collect()} == planned
