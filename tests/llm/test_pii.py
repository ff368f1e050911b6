import hashlib
import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terragrain.llm import pii

from .cases import AWKWARD, documents

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def brute_force(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = (True, all(int(p) <= 255 for p in m.group().split(".")) if kind == 1 else True, 13 <= len(digits) <= 19 and pii.luhn(digits), 9 <= len(digits) <= 15)[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=500)
@given(st.text(alphabet=st.sampled_from(list("aB9.%+-@ ()_0123\né٣")), max_size=60))
def test_base_equals_brute_force(text):
    assert pii.base_spans(text) == brute_force(text)


ROWS = [
    *AWKWARD,
    (20, "é😀 mail a.b@x.org, a@b.c_d@e.f or 10.0.0.1 and 256.1.1.1, card 4111 1111 1111 1111, call +1 (456) 555-2186.", "en", "a", 1),
    (21, "@@a@b..c@d.e 1.2.3.4.5 +1 23", "en", "a", 1),
    (23, "0" * 5_000 + ".1.2.3 then " + "0" * 5_000 + "1.2.3.4 and " + "7" * 5_000 + ".1.2.3", "en", "a", 1),
    (22, "9" * 100_000 + "@" + "a." * 50_000, "en", "a", 1),
    *[(30 + k, f"report {w} says wexford writes to zed@corp.example {v}\nnothing else here", "en", "a", 1) for k, (w, v) in enumerate(zip(("alpha", "beta", "gamma", "delta"), ("daily", "weekly", "monthly", "never"), strict=True))],
    *[(40 + k, f"report number {n} goes to p{k}@corp.example says {n}", "en", "a", 1) for k, n in enumerate(("one", "two", "three", "four", "five", "six"))],
]


def test_awkward_rows(spark):
    got = pii.scan_personal_data(documents(spark, ROWS, clashing=True)).collect()
    assert len(got) == len(ROWS)
    texts = {r[0]: r[1] for r in ROWS}
    for r in got:
        own = brute_force(texts[r.doc_id] or "") if r.doc_id not in (22, 23) else pii.base_spans(texts[r.doc_id])
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in own)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in own) for k in range(4))
        assert r.spans.startswith(joined)


def test_terms_that_keep_to_one_entity_disclose_it(spark):
    got = {r.doc_id: r.spans for r in pii.scan_personal_data(documents(spark, ROWS)).collect()}
    text = ROWS[len(AWKWARD) + 4][1]
    at = text.index("wexford")
    assert f"term:{at}:{at + 7}" in got[30]
    assert not any("term" in got[40 + k] for k in range(6))
    says = text.index("says")
    assert f"term:{says}:" not in got[30]


def test_a_term_of_many_texts_without_entities_discloses_none(spark):
    texts = [f"note {w} mentions harbour for zed@corp.example {w}" for w in ("alpha", "beta", "gamma", "delta")]
    texts += [f"the harbour was quiet in {w} and nobody came" for w in ("spring", "summer", "autumn", "winter", "january", "february", "march", "april")]
    rows = [(k, text, "en", "a", 1) for k, text in enumerate([*texts, *(f"filler number {'x' * k} goes here" for k in range(3, 15))])]
    got = {r.doc_id: r.spans for r in pii.scan_personal_data(documents(spark, rows)).collect()}
    at = texts[0].index("harbour")
    assert f"term:{at}:" not in got[0]
    assert f"term:{texts[0].index('mentions')}:" in got[0]


def test_copies_of_a_text_count_once(spark):
    texts = [f"note {w} mentions harbour for zed@corp.example {w}" for w in ("alpha", "beta", "gamma", "delta")]
    rows = [(k, text, "en", "a", 1) for k, text in enumerate([*texts, *["the harbour was quiet"] * 30, *(f"filler number {'x' * k} goes here" for k in range(3, 15))])]
    got = {r.doc_id: r.spans for r in pii.scan_personal_data(documents(spark, rows)).collect()}
    assert f"term:{texts[0].index('harbour')}:" in got[0]


def test_long_numbers_are_addresses_only_where_their_value_is():
    assert pii.base_spans(ROWS[len(AWKWARD) + 2][1]) == [(1, 0, 5006), (1, 5012, 10019)]


def disclosing(rows, near=8):
    """The (entity text, term) pairs by the definition, on different texts."""
    texts = sorted({r[1] for r in rows if r[1] is not None})
    with_term, with_entity, with_both, around = {}, {}, {}, {}
    for text in texts:
        spans = pii.base_spans(text)
        inside = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[^\W\d_]{3,}", text) if not any(m.start() < e and s < m.end() for _, s, e in spans)]
        terms, entities = {w for *_, w in inside}, {(k, text[a:b].lower()) for k, a, b in spans}
        for w in terms:
            with_term[w] = with_term.get(w, 0) + 1
        for e in entities:
            with_entity[e] = with_entity.get(e, 0) + 1
            for w in terms:
                with_both[e, w] = with_both.get((e, w), 0) + 1
        for k, a, b in spans:
            left, right = text.rfind("\n", 0, a) + 1, text.find("\n", b)
            own = [t for t in inside if t[0] >= left and (right < 0 or t[1] <= right)]
            words = [w for s, _, w in own if s < a][-near:] + [w for s, _, w in own if s >= b][:near]
            for w in terms:
                around.setdefault(((k, text[a:b].lower()), w), set()).add(" ".join(words))
            around.setdefault((k, text[a:b].lower()), set()).add(" ".join(words))
    out = set()
    for (e, w), n in with_both.items():
        names = math.log2(len(texts) / with_entity[e])
        if with_entity[e] >= pii.SUPPORT and len(around[e]) >= pii.SUPPORT and n >= pii.SUPPORT and len(around[e, w]) >= pii.SUPPORT and names > 0:
            if math.log2(len(texts) * n / (with_entity[e] * with_term[w])) >= pii.DISCLOSED * names:
                out.add(w)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_terms_equal_brute_force(spark, seed):
    r = random.Random(seed)
    common = [f"{a}{b}word" for a in "abcdefgh" for b in "klmnop"]
    people = [(f"name{chr(97 + k)}", f"p{k}@corp.example") for k in range(6)]
    rows = []
    for i in range(160):
        words = r.choices(common, k=r.randint(3, 14))
        if r.random() < 0.5:
            name, mail = r.choice(people)
            words.insert(r.randrange(len(words)), mail)
            if r.random() < 0.8:
                words.insert(r.randrange(len(words)), name)
            if r.random() < 0.3:
                words.insert(r.randrange(len(words)), "\n")
        rows.append((i, " ".join(words), "en", "a", 1))
    rows += rows[:30]
    wanted = disclosing(rows)
    got = set()
    for row in pii.find_personal_data(documents(spark, rows)).collect():
        text = rows[row.doc_id][1]
        got |= {text[s.start : s.end].lower() for s in row.spans if s.kind == 4}
    assert wanted and got == wanted


def test_repeated_and_missing_ids_are_sanitised_once_each(spark):
    rows = [(1, "a@b.example", "en", "a", 1), (1, "+1 456 555 2186", "en", "a", 1), (None, "x@y.example", "en", "a", 1), (None, None, "en", "a", 1)]
    docs = documents(spark, rows, clashing=True)
    out = pii.sanitise(docs)
    assert out.columns == docs.columns
    assert sorted(map(repr, ((r.doc_id, r.text) for r in out.collect()))) == ["(1, '[email]')", "(1, '[phone]')", "(None, '[email]')", "(None, None)"]


def test_sanitised_text(spark):
    out = {r.doc_id: r.text for r in pii.sanitise(documents(spark, ROWS[len(AWKWARD) :])).collect()}
    assert out[20].startswith("é😀 mail [email], [email]") and "[card]" in out[20] and "[phone]" in out[20] and "[ip]" in out[20]
    assert "wexford" not in out[30] and "[term]" in out[30]


def test_disclosing_terms_are_marked_wherever_they_stand(spark):
    far = ROWS[len(AWKWARD) + 4][1] + "\nWexford again, " + "and so on " * 200 + "wexford\n"
    rows = [*ROWS[len(AWKWARD) :], (50, far, "en", "a", 1), (51, "only wexford, no address", "en", "a", 1)]
    got = {r.doc_id: r.spans.split(",") for r in pii.scan_personal_data(documents(spark, rows)).collect()}
    for i, text in ((50, far), (51, rows[-1][1])):
        assert {f"term:{m.start()}:{m.end()}" for m in re.finditer("(?i)wexford", text)} <= set(got[i])
    out = {r.doc_id: r.text.lower() for r in pii.sanitise(documents(spark, rows)).collect()}
    assert not any("wexford" in text for text in out.values())


def test_empty_table(spark):
    assert pii.scan_personal_data(documents(spark, [])).count() == 0
