import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from terragrain.llm import packing

from .cases import AWKWARD, documents

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(list("aB'st.,!? \n\t\x1c\x85\xa0éÉß½²<|endoftext|>"))), max_size=40), max_size=4))
def test_encoder_equals_tokenizer(texts):
    got = packing.encoder_for(PATH).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [ids_of(t)[:-1] for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([" ", "\n ", "\xa0", "\u3000", "\x1c", "\x85 ", "\u2028", "it's", "Stra\xdfe", "e\u0301", "\u0301", "\u03a3", "A\u03a3", "12", "<|endoftext|>", "\u65e5\u672c", ".", "!?"]), max_size=60).map("".join))
def test_parts_of_long_texts_with_unusual_spaces(text):
    encoder = packing.WordEncoder(PATH)
    encoder.PART = 7
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == ids_of(text)[:-1]


MEASURED = """
import resource, sys
from terragrain.llm import packing
text = "some words of a page that isn't short,\\xa0na\\xefve as it is. " * 360_000
encoder = packing.encoder_for(sys.argv[1])
encoder.encode([text[:1000]])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
ids = encoder.encode([text])[0]
print(len(ids) // 4, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


def test_memory_of_a_long_text_with_unusual_spaces():
    """20 million characters with a no-break space in every sentence take less than 200 MB."""
    n, megabytes = map(int, subprocess.run([sys.executable, "-c", MEASURED, PATH], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2]).stdout.split())
    assert n > 4_000_000 and megabytes < 200


def check(rows, packed, length):
    wanted = sorted((len(ids_of(r[1])), r[0] is None, r[0] or 0) for r in rows)
    by_doc, by_sequence = {}, {}
    for p in packed:
        assert 1 <= p.length <= length
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert sum(p.length for p in packed) == sum(n for n, _, _ in wanted)
    texts = {r[0]: r[1] for r in rows}
    for doc_id, pieces in by_doc.items():
        ids = ids_of(texts[doc_id])
        for p in pieces:
            assert p.start == p.piece * length
            own = np.array(ids[p.start : p.start + p.length], "<u4").tobytes()
            assert p.length == min(length, len(ids) - p.start) and p.ids_crc32 == zlib.crc32(own)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= length
    return len(by_sequence)


def test_awkward_rows(spark):
    packed = packing.pack_documents(documents(spark, clashing=True), PATH).collect()
    check(AWKWARD, packed, 2048)
    assert sorted(str(p.doc_id) for p in packed if p.piece == 0) == sorted(str(r[0]) for r in AWKWARD)


def test_few_sequences_over_several_shards(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["word"] * int(n)), "en", "a", 1) for i, n in enumerate(rng.integers(1, 90, 600))]
    pieces = packing.materialise(packing.cut_pieces(documents(spark, rows), PATH, length=64), "pieces")
    packed = packing.pack_pieces(pieces, 64, shard_rows=100).collect()
    least = -(-sum(p.length for p in packed) // 64)
    assert check(rows, packed, 64) <= 1.03 * least


def test_kept_ids_are_the_pieces(spark):
    packed = packing.pack_documents(documents(spark, [(1, "a b c " * 30, "en", "s", 1)]), PATH, length=16, keep_ids=True).collect()
    joined = b"".join(p.ids for p in sorted(packed, key=lambda p: p.piece))
    assert np.frombuffer(joined, "<u4").tolist() == ids_of("a b c " * 30)


def test_empty_table(spark):
    assert packing.pack_documents(documents(spark, []), PATH).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_each_item_goes_where_the_squares_become_smallest(seed):
    lengths, capacity = np.random.default_rng(seed).integers(1, 20, 120), 24
    bins = packing.sum_of_squares(lengths, capacity)
    left = {}
    for s, b in zip(lengths.tolist(), bins.tolist(), strict=True):
        def squares(gaps):
            return sum(c * c for g, c in zip(*np.unique([g for g in gaps if g], return_counts=True), strict=True)) if any(gaps) else 0
        fitting = [k for k, g in left.items() if g >= s]
        if b in left:
            assert left[b] >= s
            chosen = squares([g - s if k == b else g for k, g in left.items()])
            assert chosen == min(squares([g - s if k == other else g for k, g in left.items()]) for other in fitting)
        else:
            assert not fitting
        left[b] = left.get(b, capacity) - s
