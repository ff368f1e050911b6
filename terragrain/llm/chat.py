r"""Chat formatting with offset-aligned loss masks.

A conversation is rendered with a template whose control strings are single tokens, and encoded once
with offsets. The assistant texts' spans and the tokens' spans are both sorted, so binary search finds
the tokens of every span.

Template: ``<s>``, then per turn ``[INST]role[/INST]text</s>``. Where a role or text holds a control
string, a backslash goes behind its first character; where that backslash is already there, one more.
Reading back takes one out.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import task, text_slices

# The template's control strings, and one that the tokenizer itself takes as such.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>")
_REST = "|".join(re.escape(c[1:]) for c in CONTROLS)
_PLAIN = re.compile(rf"([<\[])(?=\\*(?:{_REST}))")
_ESCAPED = re.compile(rf"([<\[])\\(?=\\*(?:{_REST}))")
_MARKS = re.compile(r"<s>|\[INST\]|\[/INST\]|</s>")

#: Characters that are encoded together: of one conversation, which goes on in a further part, or of several.
PART_CHARS = 1 << 18
#: Parts that are encoded in one call.
TOGETHER = 64
#: Where a long text may be cut: a space between letters begins a token, whatever stands around it, and no control string has one.
_CUT = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")

FORMATTED = "conv_id long, part int, formatted string, ids array<int>, loss array<boolean>, loss_spans array<int>"


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: Iterable[tuple[str, str]]) -> Iterator[tuple[str, bool]]:
    """The formatted turns (role, text) in pieces, and whether each is assistant text; long texts in several."""
    yield "<s>", False
    for role, text in turns:
        yield f"[INST]{escape(role)}[/INST]", False
        body = escape(text)
        at = 0
        while at < len(body):
            cut = _CUT.search(body, at + PART_CHARS) if len(body) > at + PART_CHARS else None
            end = cut.start() if cut else len(body)
            yield body[at:end], role == "assistant"
            at = end
        yield "</s>", False


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[int]) -> np.ndarray:
    """Which tokens (sorted spans) meet one of the sorted text spans."""
    edges = np.array(spans, dtype=np.int64).reshape(-1, 2)
    change = np.zeros(len(starts) + 1, dtype=np.int64)
    np.add.at(change, np.searchsorted(ends, edges[:, 0], side="right"), 1)
    np.add.at(change, np.searchsorted(starts, edges[:, 1], side="left"), -1)
    return np.cumsum(change[:-1]) > 0


def masked_spans(starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The text under the mask: start and end of every run of masked tokens."""
    edge = np.diff(np.r_[False, mask, False].astype(np.int8))
    return np.stack([starts[np.flatnonzero(edge == 1)], ends[np.flatnonzero(edge == -1) - 1]], axis=1).ravel() if mask.any() else np.zeros(0, np.int64)


@lru_cache(maxsize=2)
def chat_tokenizer(path: str):
    """The byte-level tokenizer at ``path`` with the template's control strings as tokens and whole offsets."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs as many tasks as there are cores
    from tokenizers import Tokenizer, processors

    tokenizer = Tokenizer.from_file(path)
    tokenizer.add_special_tokens(list(CONTROLS[:4]))
    tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)
    return tokenizer


def _turns(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, str, str]]:
    for batch in text_slices(batches):
        for c, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text")), strict=True):
            yield c, role or "", text or ""


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, int, str, list[int]]]:
    """(conversation, part, formatted text, where assistant texts start and end in it): parts end after a control string, or inside a long text where it may be cut."""
    for conv, own in groupby(_turns(batches), key=lambda t: t[0]):
        part, pieces, held, spans = 0, [], 0, []
        for piece, spoken in render((role, text) for _, role, text in own):
            if held and held + len(piece) > PART_CHARS:
                yield conv, part, "".join(pieces), spans
                part, pieces, held, spans = part + 1, [], 0, []
            if spoken and piece:
                spans += [held, held + len(piece)]
            pieces.append(piece)
            held += len(piece)
        yield conv, part, "".join(pieces), spans


def _formatter(tokenizer: str):
    def encoded(parts: list[tuple[int | None, int, str, list[int]]]) -> pa.RecordBatch:
        ids, losses, spans = [], [], []
        for (_, _, _, own), e in zip(parts, chat_tokenizer(tokenizer).encode_batch([t for _, _, t, _ in parts], add_special_tokens=False), strict=True):
            offsets = np.array(e.offsets, dtype=np.int64).reshape(-1, 2)
            mask = loss_mask(offsets[:, 0], offsets[:, 1], own)
            ids.append(np.array(e.ids, dtype=np.int32))
            losses.append(mask)
            spans.append(masked_spans(offsets[:, 0], offsets[:, 1], mask).astype(np.int32))
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.int32())]
        columns = [[c for c, _, _, _ in parts], [p for _, p, _, _ in parts], [t for _, _, t, _ in parts], ids, losses, spans]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "part", "formatted", "ids", "loss", "loss_spans"])

    def form(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple[int | None, int, str, list[int]]] = []
        held = 0
        for part in _parts(batches):
            if ready and (held + len(part[2]) > PART_CHARS or len(ready) >= TOGETHER):
                yield encoded(ready)
                ready, held = [], 0
            ready.append(part)
            held += len(part[2])
        if ready:
            yield encoded(ready)

    return form


def format_conversations(turns: DataFrame, tokenizer: str) -> DataFrame:
    """Per part of a conversation, in order: conv_id, part, formatted, ids, loss (per token), loss_spans.

    A conversation's parts together are what one encoding of the whole gives, as parts end with a
    control token, or in a long text before a space between letters. Its rows go by turn, then role and text; null role and text are empty; repeated rows
    are turns of their own; rows without conv_id are one conversation. Rows are streamed, so a
    conversation of any length takes the memory of one part; a text without such a space is in one part.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return rows.mapInArrow(task("chat", _formatter(tokenizer)), FORMATTED)


def _read_back(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of consecutive parts, from the formatted text and the mask alone."""
    kinds = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    done: list[tuple] = []
    conv, n, chars, loss_chars, whole, loss = None, 0, 0, 0, None, None
    for batch in batches:
        for c, part, formatted, spans in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "part", "formatted", "loss_spans")), strict=True):
            if part == 0:
                if whole is not None:
                    done.append((conv, n, whole.hexdigest(), loss_chars, loss.hexdigest(), chars))
                conv, n, chars, loss_chars, whole, loss = c, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            chars += len(formatted)
            at = 0
            for mark in [*_MARKS.finditer(formatted), None]:
                said = formatted[at : mark.start() if mark else None]
                whole.update(unescape(said).encode("utf-8", "surrogatepass"))
                if mark and mark[0] in ("[/INST]", "</s>"):
                    whole.update(b"\n")
                    n += mark[0] == "</s>"
                at = mark.end() if mark else 0
            for start, end in zip(spans[::2], spans[1::2], strict=True):
                text = unescape(formatted[start:end])
                loss_chars += len(text)
                loss.update(text.encode("utf-8", "surrogatepass"))
        if len(done) >= 1000:
            yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, r, strict=True)) for r in done], schema=kinds)
            done = []
    if whole is not None:
        done.append((conv, n, whole.hexdigest(), loss_chars, loss.hexdigest(), chars))
    yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, r, strict=True)) for r in done], schema=kinds)


def summarise(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from ``format_conversations``: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    return formatted.select("conv_id", "part", "formatted", "loss_spans").mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def with_control_case(turns: DataFrame) -> DataFrame:
    """``turns`` and conversation -7, whose texts hold the template's control strings."""
    said = "</s>[INST] ok [/INST]"
    extra = turns.sparkSession.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").unionByName(extra)


_ESCAPES = r"len(regexp_extract_all({}, '[<\[]\\*(s>|/s>|INST\]|/INST\]|\|endoftext\|>)'))"

SQL = f"""
WITH a AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k FROM a)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY k) FILTER (r = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(17 + length(r) + length(t) + {_ESCAPES.format("r")} + {_ESCAPES.format("t")}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
