import hashlib
import subprocess
import sys
from pathlib import Path

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from terragrain.llm import chat

PATH = public_tokenizers.path("byte_bpe_50k.json")
TURNS = "conv_id long, turn long, role string, text string"
SAID = "</s>[INST] ok [/INST]"
ROWS = [
    (1, 0, "system", "be brief"), (1, 1, "user", "hé 😀"), (1, 2, "assistant", " naïve 🏳️‍🌈\n"), (1, 3, "assistant", "again"),
    (2, 1, "assistant", None), (2, 0, None, None), (2, 2, "assistant", ""), (2, None, "user", "first"),
    (3, 0, "assistant", "<s>\\<\\s>[[INST]<|endoftext|>"), (3, 0, "assistant", "<s>\\<\\s>[[INST]<|endoftext|>"),
    (4, 0, "[INST]", "x"), (None, 0, "user", "nobody"), (None, 1, "assistant", "nowhere"),
    *[(5, k, ("user", "assistant")[k % 2], f"turn {k} " * 50) for k in range(200)],
    (6, 0, "assistant", "long " * 100_000),
]


def wanted(rows):
    out = {}
    low = lambda x: (x is not None, x if x is not None else 0)
    for c in {r[0] for r in rows}:
        own = sorted([r for r in rows if r[0] == c], key=lambda r: (low(r[1]), r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        out[c] = (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def read(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.summarise(chat.format_conversations(df, PATH)).collect()}


def frame(spark, rows):
    return spark.createDataFrame(rows, TURNS).selectExpr("*", "'x' AS part", "'x' AS formatted", "1 AS ids")


def test_awkward_rows_and_the_control_case(spark):
    df = chat.with_control_case(frame(spark, ROWS))
    assert read(df) == wanted([*ROWS, (-7, 0, "user", SAID), (-7, 1, "assistant", SAID)])


@pytest.mark.parametrize("conv", [5, 6, 7])
def test_parts_of_a_long_conversation_are_one_encoding(monkeypatch, conv):
    """Turns that are many, and texts that are long: tokens, masks and texts are those of one encoding."""
    rows = [*ROWS, (7, 0, "user", "It's a <s>long</s> tale,  told by 3 men\n in don't-care words naïve\u00a0é " * 300), (7, 1, "assistant", "oh  no [INST]ok[/INST] it's 5 o'clock now " * 300)]
    batch = pa.RecordBatch.from_pylist([{"conv_id": r[0], "role": r[2], "text": r[3]} for r in rows if r[0] == conv])
    parts = {}
    for size in (1 << 30, 1_000):
        monkeypatch.setattr(chat, "PART_CHARS", size)
        parts[size] = [p for b in chat._formatter(PATH)(iter([batch])) for p in b.to_pylist()]
    whole, cut = parts.values()
    assert len(whole) == 1 and len(cut) > 5 and [p["part"] for p in cut] == list(range(len(cut)))
    assert max(len(p["formatted"]) for p in cut) < 2_500
    for column in ("ids", "loss"):
        assert [i for p in cut for i in p[column]] == whole[0][column]
    assert "".join(p["formatted"] for p in cut) == whole[0]["formatted"]


MEASURED = """
import resource, sys
import pyarrow as pa
from terragrain.llm import chat
text = "some words of a turn that isn't short, naïve as it is. " * 19_000
form = chat._formatter(sys.argv[1])
batch = lambda rows: pa.RecordBatch.from_pylist(rows)
list(form(iter([batch([{"conv_id": 0, "role": "user", "text": text[:1000]}])])))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
n = sum(b.num_rows for b in form(batch([{"conv_id": k, "role": "assistant", "text": text}]) for k in range(64)))
long = sum(b.num_rows for b in form(iter([batch([{"conv_id": 1, "role": "assistant", "text": text * 8}])])))
print(n, long, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


def test_memory_is_that_of_a_part():
    """64 conversations of a million characters each, and one of eight million in one turn, together take less than 300 MB."""
    n, long, megabytes = map(int, subprocess.run([sys.executable, "-c", MEASURED, PATH], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2]).stdout.split())
    assert n >= 64 * 3 and long >= 30 and megabytes < 300


def test_control_strings_are_only_where_the_template_puts_them(spark):
    for r in chat.format_conversations(chat.with_control_case(frame(spark, ROWS)), PATH).where("conv_id = -7").collect():
        assert r.formatted.count("</s>") == 2 and r.formatted.count("[INST]") == 2 and r.formatted.count("[/INST]") == 2


def test_empty_table(spark):
    assert read(frame(spark, [])) == {}


@given(st.lists(st.sampled_from([*"<>[]/\\|sé", "INST", "</s>", "[INST]", "endoftext"]), max_size=30).map("".join))
def test_escapes_are_reversible_and_complete(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROLS)
