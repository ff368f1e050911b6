"""A type-aware JSON path predicate language, compiled to columns over VARIANT.

``#(path op value)`` (or with square brackets) asks whether a value under ``path`` compares as said. A
missing path never matches, whatever the operator; strings compare as text, numbers as numbers (a
right side that is no number counts as 0), booleans with true and false; null, objects and arrays
match nothing. In a path, a backslash takes the next character as it is, a number is an array's
element, and a last ``#`` an array's length; a key with ``*`` or ``?`` is a pattern, which takes the
first key that it fits; and ``#(path op value)`` takes the first element of an array that matches, or,
without a path, that is itself as said, ``#(...)#`` all of them. ``#(path)`` asks for existence.
``%`` and ``!%`` match patterns with ``*`` and ``?``; ``~true``, ``~false``, ``~null`` and ``~*`` match by truthiness. A line that is an array matches
where one of its elements does.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_QUERY = re.compile(r"^#[(\[](?P<inside>.*)[)\]](?P<all>#?)$", re.DOTALL)
_OPERATOR = re.compile(r"==|!=|<=|>=|!%|=|<|>|%")


@dataclass(frozen=True)
class PathQuery:
    path: str
    op: str | None
    value: str | None
    quoted: bool
    every: bool


def _outside(text: str) -> Iterator[int]:
    """Where characters stand that are neither escaped nor part of a query inside the text."""
    at, depth, quoted = 0, 0, False
    while at < len(text):
        c = text[at]
        if c == "\\":
            at += 2
            continue
        if depth and c == '"':
            quoted = not quoted
        elif c in "([" and not quoted and (depth or text[at - 1 : at] == "#"):
            depth += 1
        elif depth and c in ")]" and not quoted:
            depth -= 1
        elif not depth:
            yield at
        at += 1


def parse(query: str) -> PathQuery:
    """Reads one query; raises ValueError where it is none."""
    m = _QUERY.match(query.strip())
    if not m:
        raise ValueError(f"not a path query: {query!r}")
    inside = m["inside"]
    found = next((o for at in _outside(inside) if (o := _OPERATOR.match(inside, at))), None)
    path = (inside[: found.start()] if found else inside).strip()
    if any(path[at].isspace() for at in _outside(path)) or not (path or found):
        raise ValueError(f"not a path query: {query!r}")
    value, op = (inside[found.end() :].strip(), found[0]) if found else (None, None)
    quoted = bool(value) and len(value) > 1 and value[0] == value[-1] == '"'
    return PathQuery(path, "=" if op == "==" else op, value[1:-1] if quoted else value, quoted, bool(m["all"]))


def split_queries(text: str) -> list[str]:
    """A list of queries given as one option: split on every comma; nothing where it is empty."""
    return text.split(",") if text else []


def path_parts(path: str) -> list[str]:
    """The keys of a path: split on dots that no backslash stands before, and that are in no query; the backslashes stay."""
    dots = [at for at in _outside(path) if path[at] == "."]
    return [p for a, z in zip([0, *[d + 1 for d in dots]], [*dots, len(path)], strict=True) if (p := path[a:z])]


def variant_path(parts: list[str]) -> str:
    """``a``, ``b``, ``0`` as a VARIANT path."""
    out = "$"
    for p in parts:
        key = re.sub(r"\\(.)", r"\1", p)
        out += f"[{p}]" if p.isdigit() else f'["{key}"]' if "'" in key else f"['{key}']"
    return out


def _is_pattern(part: str) -> bool:
    return any(part[at] in "*?" for at in _outside(part))


def _is_query(part: str) -> bool:
    return part[:2] in ("#(", "#[")


def parse_line(line: Column) -> Column:
    """A JSON line as VARIANT; one or two missing closing braces are added; null where that doesn't help."""
    return F.coalesce(*[F.try_parse_json(t) for t in _mended(line)])


def _mended(line: Column) -> list[Column]:
    return [line, F.concat(line, F.lit("}")), F.concat(line, F.lit("}}"))]


def _glob(pattern: str, escapes: bool = False) -> str:
    parts = re.findall(r"\\.|.", pattern, re.DOTALL) if escapes else pattern
    return "(?s)^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c[-1])) for c in parts) + "$"


def _number(text: str) -> float:
    try:
        return float(text)
    except ValueError:
        return 0.0


def _compare(left: Column, op: str, right: Column) -> Column:
    return {"=": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]


def _descend(v: Column, text: Column, parts: list[str]) -> tuple[Column, list[str]]:
    """The value that the last pattern or query of a path leads to, and the plain keys that are left.

    ``text`` is the value as JSON with its keys in their order: a pattern takes the first key that it
    fits. A query takes the first of a list's elements that match it.
    """
    for k, part in enumerate(parts):
        if not (_is_pattern(part) or _is_query(part)):
            continue
        at = variant_path(parts[:k])
        if _is_query(part):
            q = parse(part)
            listed = F.try_variant_get(v, at, "array<variant>")
            met = F.filter(listed, lambda e: F.coalesce(_on_value(e, F.to_json(e), q), F.lit(False)))  # noqa: B023
            if q.every:  # all of them, as a list
                found = F.when(listed.isNotNull(), F.to_variant_object(met))
            else:
                found = F.get(met, F.lit(0))
            below = F.to_json(found)
        else:
            own = text if k == 0 else F.get_json_object(text, at)
            fits = F.filter(F.json_object_keys(own), lambda key: key.rlike(_glob(part, escapes=True)))  # noqa: B023
            key = F.get(fits, F.lit(0))
            found = F.element_at(F.try_variant_get(v, at, "map<string,variant>"), key)
            below = F.call_function("get_json_object", own, F.concat(F.lit("$['"), key, F.lit("']")))
        return _descend(found, below, parts[k + 1 :])
    return v, parts


def _on_value(v: Column, text: Column, q: PathQuery) -> Column:
    v, parts = _descend(v, text, path_parts(q.path))
    if parts and parts[-1] == "#":
        length = F.size(F.try_variant_get(v, variant_path(parts[:-1]), "array<variant>"))
        kind = F.when(length >= 0, "BIGINT")
        text, number, flag = length.cast("string"), length.cast("double"), F.lit(None).cast("boolean")
    else:
        at = variant_path(parts)
        kind = F.schema_of_variant(F.try_variant_get(v, at, "variant"))
        text, number, flag = F.try_variant_get(v, at, "string"), F.try_variant_get(v, at, "double"), F.try_variant_get(v, at, "boolean")
    if q.op is None:
        return kind.isNotNull()
    is_text, is_flag, is_number = kind == "STRING", kind == "BOOLEAN", kind.rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$")
    value = q.value or ""
    if value.startswith("~") and not q.quoted and q.op in ("=", "!="):
        truthy = F.when(is_flag, flag).when(is_number, number != 0).when(is_text, ~text.isin("", "0", "false")).otherwise(F.lit(False))
        found = {"~true": truthy & kind.isNotNull(), "~false": ~truthy | kind.isNull(), "~null": kind.isNull() | (kind == "VOID"), "~*": kind.isNotNull()}[value]
        return found if q.op == "=" else ~found
    if q.op in ("%", "!%"):
        like = text.rlike(_glob(value))
        return is_text & (like if q.op == "%" else ~like)
    order = F.when(is_flag, F.lit(value).isin("true", "false") & _compare(flag.cast("int"), q.op, F.lit(int(value == "true"))))
    return order.when(is_text, _compare(text, q.op, F.lit(value))).when(is_number, _compare(number, q.op, F.lit(_number(value)))).otherwise(F.lit(False))


def matches(line: Column, query: str) -> Column:
    """Whether the JSON line matches; never null. ``#(...)#``, which lists all matches, always exists."""
    q = parse(query)
    if q.every:
        return line.isNotNull()
    v = parse_line(line)
    whole = F.coalesce(*[F.when(F.try_parse_json(t).isNotNull(), t) for t in _mended(line)])
    listed = F.try_variant_get(v, "$", "array<variant>")
    texts = F.transform(F.sequence(F.lit(0), F.size(listed) - 1), lambda i: F.call_function("get_json_object", whole, F.concat(F.lit("$["), i.cast("string"), F.lit("]"))))
    some = F.exists(F.arrays_zip(listed.alias("v"), texts.alias("t")), lambda e: F.coalesce(_on_value(e["v"], e["t"], q), F.lit(False))) if _ordered(q.path) else F.exists(listed, lambda e: F.coalesce(_on_value(e, F.lit(None).cast("string"), q), F.lit(False)))
    return F.coalesce(F.when(F.schema_of_variant(v).startswith("ARRAY") & (F.size(listed) > 0), some).otherwise(_on_value(v, whole, q)), F.lit(False))


def _ordered(path: str) -> bool:
    """Whether the order of keys matters: the first one that a pattern fits is taken."""
    return any(_is_pattern(p) for p in path_parts(path))


def match_all(line: Column, queries: list[str]) -> Column:
    out = F.lit(True)
    for q in queries:
        out = out & matches(line, q)
    return out


def match_any(line: Column, queries: list[str]) -> Column:
    out = F.lit(not queries)
    for q in queries:
        out = out | matches(line, q)
    return out


def match_none(line: Column, queries: list[str]) -> Column:
    out = F.lit(True)
    for q in queries:
        out = out & ~matches(line, q)
    return out


def rejection(line: Column, all_of: list[str], any_of: list[str], none_of: list[str]) -> Column:
    """The first clause that a line fails, or null."""
    return F.when(~match_all(line, all_of), "match-all").when(~match_any(line, any_of), "match-any").when(~match_none(line, none_of), "match-none")
