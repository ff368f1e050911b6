import random
import re
import zlib
from collections import Counter

import pytest

from terragrain.llm import spelling

from .cases import AWKWARD, documents


def words_of(rows):
    counts = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc}:{run}".encode()) if doc is not None else 1
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 3}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def brute_force(counts):
    forms, links = {}, {}
    for w, n in counts.items():
        links[w] = [v for v in counts if near(w, v)]
        best = min(links[w], key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= 2 * n else None
    out = []
    for w, n in counts.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w], root, n, len(links[w]), counts[forms[w]] if forms[w] is not None else None))
    return sorted(out, key=repr)


def got(spark, rows, clashing=True):
    df = documents(spark, rows, clashing)
    if clashing:
        df = df.selectExpr("*", "'x' AS word", "1 AS n", "'x' AS form", "'x' AS cell")
    return sorted(map(tuple, spelling.group_spellings(df).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


def vocabulary(seed, size, letters, longest, head=""):
    pick = random.Random(seed)
    return sorted({head + "".join(pick.choices(letters, k=pick.randint(5, longest))) for _ in range(size)})


def texts(words, seed):
    pick = random.Random(seed)
    return [(k, " ".join(w for w in words for _ in range(pick.choice((0, 3, 4, 7, 20)))), "en", "a", 0) for k in range(3)]


@pytest.mark.parametrize(("letters", "longest", "head", "cell"), [("ab", 8, "", 1024), ("ab", 8, "", 4), ("abcé", 6, "", 16), ("abc", 7, "samestart", 8), ("aAb", 6, "", 2)])
def test_equals_brute_force(spark, monkeypatch, letters, longest, head, cell):
    monkeypatch.setattr(spelling, "CELL_WORDS", cell)
    monkeypatch.setattr(spelling, "BATCH_ENTRIES", 100)
    rows = texts(vocabulary(len(letters) + cell, 300, letters, longest, head), 2)
    counts = words_of(rows)
    assert len(counts) > 10
    assert got(spark, rows) == brute_force(counts)


def test_awkward_rows(spark):
    assert got(spark, AWKWARD) == brute_force(words_of(AWKWARD))
    assert got(spark, []) == []


def test_letters_end_where_the_contract_says(spark):
    text = " ".join(["naïve×x naive÷x NAÏVE Äpfel äpfel ąbcdefg xyzµvwxyz don't’letters 日本letters"] * 4)
    rows = [(5, text, "en", "a", 0), (None, text, "en", "a", 0)]
    assert got(spark, rows) == brute_force(words_of(rows))


def test_long_texts_and_long_words(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PART_CHARS", 100)
    monkeypatch.setattr(spelling, "COUNTED_WORDS", 50)
    words = vocabulary(9, 200, "abcdef", 9)
    long = "q" * 300
    rows = [(1, " ".join(words * 7), "en", "a", 0), (2, " ".join([long, long + "r", long[1:], "s" + long] * 4), "en", "a", 0)]
    assert got(spark, rows) == brute_force(words_of(rows))


def test_cells_are_split_until_they_are_small(spark, monkeypatch):
    monkeypatch.setattr(spelling, "CELL_WORDS", 20)
    words = spark.createDataFrame([(w, 3) for w in vocabulary(4, 3000, "abcdefgh", 10, "kkkkkkkkkk")], "word string, n long")
    entries = spelling.cells(words)
    sizes = entries.groupBy(*spelling.CELL).count().selectExpr("max(count) AS most", "sum(count) AS entries").first()
    assert sizes["most"] <= 64 + 8
    pairs = spelling.near_words(words).selectExpr("sum(n_near)").first()[0]
    vocab = [r["word"] for r in words.collect()]
    known = set(vocab)
    wanted = set()
    for w in vocab:
        for k in range(len(w)):
            wanted |= {frozenset((w, v)) for v in [w[:k] + c + w[k + 1 :] for c in "abcdefghk"] + [w[:k] + w[k + 1 :]] if v in known and v != w}
    assert pairs == 2 * len(wanted)
