import random
import re
from hashlib import sha256

import pytest

from terragrain.llm import leaks

from .cases import AWKWARD, PROSE, documents


def words(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)


def item_windows(items):
    for item, text in items:
        own = words(text)
        n = min(10, len(own))
        for i in range(len(own) - n + 1 if n else 0):
            yield item, own[i : i + n]


def brute_force(docs, items):
    runs = list(item_windows(items))
    out = []
    for doc, text, *_ in docs:
        own, hit, found = words(text), set(), set()
        for item, run in runs:
            for i in range(len(own) - len(run) + 1):
                if own[i] == run[0] and own[i : i + len(run)] == run:
                    hit.update(range(i, i + len(run)))
                    found.add(item)
        names = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(own), len(hit), len(names), sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS words", "'x' AS items", "1 AS window")


def got(spark, docs, items):
    df = documents(spark, docs, True).selectExpr("*", "1 AS bucket", "'x' AS terms", "'x' AS postings", "1 AS docs")
    return sorted(map(tuple, leaks.find_leaks(df, benchmark(spark, items)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=repr)


ITEMS = [
    (1, PROSE), (2, PROSE + " again"), (10, "word"), (11, "word WORD"), (3, None), (4, ""), (5, " .,! "), (6, "no such words here"), (7, "der die das und ist"), (7, "12345 678"), (None, "a row without"), (8, "One"), (8, "One"),
]


def test_awkward_rows(spark):
    assert got(spark, AWKWARD, ITEMS) == brute_force(AWKWARD, ITEMS)
    assert got(spark, AWKWARD, []) == brute_force(AWKWARD, [])
    assert got(spark, [], ITEMS) == []


def passages(seed, docs=120, items=25):
    pick = random.Random(seed)
    vocabulary = ["w%d" % k for k in range(40)] + ["Über", "naïve", "日本", "x"]
    text = lambda n: " ".join(pick.choice(vocabulary) + pick.choice(["", ",", "."]) for _ in range(n))
    bench = [(k, text(pick.choice((1, 3, 9, 10, 11, 30)))) for k in range(items)]
    bench.append((100, bench[3][1]))
    rows = []
    for k in range(docs):
        parts = [text(pick.randint(0, 60))]
        for _ in range(pick.randint(0, 3)):
            own = pick.choice(bench)[1].split()
            a = pick.randint(0, len(own) - 1)
            parts += [" ".join(own[a : a + pick.randint(1, 30)]).upper() if k % 2 else " ".join(own), text(pick.randint(0, 20))]
        rows.append((k, "\n".join(parts), "en", "a", 0))
    return rows, bench


@pytest.mark.parametrize(("words_", "docs_", "part"), [(1 << 20, 1 << 15, 1 << 20), (200, 3, 50), (1, 1, 10)])
def test_equals_brute_force(spark, monkeypatch, words_, docs_, part):
    monkeypatch.setattr(leaks, "SHARD_WORDS", words_)
    monkeypatch.setattr(leaks, "SHARD_DOCS", docs_)
    monkeypatch.setattr(leaks, "PART_BYTES", part)
    rows, bench = passages(words_)
    assert got(spark, rows, bench) == brute_force(rows, bench)


@pytest.mark.parametrize(("reach", "shard"), [(6, 1 << 20), (14, 100)])
def test_spans_and_proximity(spark, monkeypatch, reach, shard):
    monkeypatch.setattr(leaks, "SHARD_WORDS", shard)
    rows, bench = passages(5, 40, 12)
    rows += [(500, "w1 q w2 q q q w3", "en", "a", 0), (501, "w3 q q", "en", "a", 0), (502, "w1 w2", "en", "a", 0)]
    bench = [(k, t) for k, t in bench if k % 2] + [(200, "w1 w2 w3")]
    found = leaks.find(leaks.build_index(documents(spark, rows)), leaks.windows(benchmark(spark, bench)), reach).collect()
    runs = list(item_windows(bench))
    texts = {d: words(t) for d, t, *_ in rows}
    assert len(found) == len(rows)
    for r in found:
        own = texts[r["doc_id"]]
        hit, close = set(), set()
        for item, run in runs:
            for i in range(len(own) - len(run) + 1):
                if own[i : i + len(run)] == run:
                    hit.update(range(i, i + len(run)))
            if any(set(run) <= set(own[p : p + reach]) for p in range(len(own))):
                close.add(item)
        assert {k for s in r["spans"] for k in range(s["start"], s["end"])} == hit
        assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:], strict=False))
        assert set(r["near_items"]) == close
