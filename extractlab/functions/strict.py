"""Strict JSON: where each value of a reply stands, in bytes, and what makes a text unacceptable.

Spark's parsers give values but no positions, so one pass over each text's tokens runs in Python over Arrow batches.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Most steps of a pointer.
DEPTH = 32
_TOKEN = re.compile(
    r'[ \t\n\r]*(?:(?P<mark>[][{}:,])|(?P<text>"[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+")'
    r"|(?P<word>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null))"
)
_SCHEMA = "problem string, spans array<struct<pointer: string, left: long, right: long>>"


def byte_offsets(text: str) -> np.ndarray:
    """Where each character begins in UTF-8, and the end."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    widths = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    return np.concatenate([[0], np.cumsum(widths)])


def spans(text: str) -> tuple[str | None, list[tuple[str, int, int]]]:
    """(problem, [(JSON pointer, first byte, byte after the last)]), containers after what they hold.

    Each open container is [pointer, start, names seen (an object) or count (an array), what may come next]."""
    at = int if text.isascii() else byte_offsets(text).item
    found: list[tuple[str, int, int]] = []
    open_: list[list] = []
    place, position, done = "", 0, False
    while m := _TOKEN.match(text, position):
        position = m.end()
        kind, token = m.lastgroup, m[m.lastgroup]
        if done:
            return "trailing_content", []
        top = open_[-1] if open_ else None
        expected = top[3] if top else "value"
        if expected in ("name", "name or end") and kind == "text":
            name = json.loads(token)
            if name in top[2]:
                return "duplicate_key", []
            top[2].add(name)
            place, top[3] = f"{top[0]}/{name.replace('~', '~0').replace('/', '~1')}", "colon"
            continue
        if kind == "mark" and (token, expected) in ((":", "colon"), (",", "comma")):
            top[3] = "value" if token == ":" or isinstance(top[2], int) else "name"
            if token == ",":
                place = f"{top[0]}/{top[2]}"
            continue
        if expected.startswith("value") and (kind != "mark" or token in "{["):
            if len(open_) > DEPTH:
                return "nesting_limit", []
            here, start = place, m.start(kind)
            if kind == "mark":
                open_.append([here, start, set(), "name or end"] if token == "{" else [here, start, 0, "value or end"])
                place = f"{here}/0"
                continue
        elif kind == "mark" and token == "}" and expected in ("name or end", "comma") and isinstance(top[2], set):
            here, start = open_.pop()[:2]
        elif kind == "mark" and token == "]" and expected in ("value or end", "comma") and isinstance(top[2], int):
            here, start = open_.pop()[:2]
        else:
            return "invalid_json", []
        found.append((here, at(start), at(position)))
        if not open_:
            done = True
        else:
            above = open_[-1]
            above[3] = "comma"
            if isinstance(above[2], int):
                above[2] += 1
    if text[position:].strip(" \t\n\r"):
        return ("trailing_content" if done else "invalid_json"), []
    return (None, found) if done else ("incomplete_json", [])


def _read(texts: pd.Series) -> pd.DataFrame:
    rows = [("no_text", []) if t is None else spans(t) for t in texts]
    return pd.DataFrame({"problem": [p for p, _ in rows], "spans": [[{"pointer": n, "left": a, "right": b} for n, a, b in s] for _, s in rows]})


def strict_json(text: Column) -> Column:
    """struct(problem, spans): null problem if the text is one strict JSON value. Refused are repeated names,
    NaN and infinities, anything after the value, and more than 32 levels; null text is ``no_text``."""
    return F.pandas_udf(_read, _SCHEMA)(text)


def _pairs(pairs: list[tuple[str, object]]) -> dict[str, object]:
    if len(own := dict(pairs)) < len(pairs):
        raise ValueError("duplicate_key")
    return own


def _constant(name: str) -> None:
    raise ValueError(name)


_DECODER = json.JSONDecoder(object_pairs_hook=_pairs, parse_constant=_constant, parse_int=len, parse_float=len)
_LOOSE = json.JSONDecoder(parse_constant=_constant, parse_int=len, parse_float=len)


def _within(value: object, depth: int) -> bool:
    """Whether no value has more than so many containers around it."""
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return depth >= 0 and all(_within(v, depth - 1) for v in inner)


def problem(text: str) -> str | None:
    """What :func:`spans` says of a text, without its spans: a text that the standard parser takes goes through that, as does a flat one
    with no other fault than a repeated name or something after the value."""
    flat = text.count("[") + text.count("{") <= DEPTH
    try:
        value = _DECODER.decode(text)
        if flat or _within(value, DEPTH):
            return None
    except json.JSONDecodeError as e:
        if flat and e.msg == "Extra data":
            return "trailing_content"
    except (ValueError, RecursionError):
        if flat and _loosely(text):
            return "duplicate_key"
    return spans(text)[0]


def _loosely(text: str) -> bool:
    """Whether the standard parser takes a text that may repeat names."""
    try:
        _LOOSE.decode(text)
    except ValueError:
        return False
    return True


def _judge(texts: pd.Series) -> pd.Series:
    return pd.Series(["no_text" if t is None else problem(t) for t in texts], dtype=object)


def strict_problem(text: Column) -> Column:
    """The problem of :func:`strict_json` alone."""
    return F.pandas_udf(_judge, "string")(text)


def exact_keys(names: Column, wanted: list[str]) -> Column:
    """Whether an object's names are just these."""
    return F.coalesce(F.array_sort(names) == F.array(*(F.lit(n) for n in sorted(wanted))), F.lit(False))


def token_bytes(token: Column, data: Column) -> Column:
    """A token's bytes: the listed ones if they all are bytes, else its text in UTF-8."""
    usable = F.coalesce(F.forall(data, lambda b: F.coalesce(b.between(0, 255), F.lit(False))), F.lit(False))
    listed = F.unhex(F.array_join(F.transform(data, lambda b: F.lpad(F.hex(b), 2, "0")), ""))
    return F.when(usable, listed).otherwise(F.encode(token, "UTF-8"))


def log_probability(value: Column) -> Column:
    """The value if it can be a log-probability (finite and at most 0), else null."""
    return F.when(~F.isnan(value) & (value <= 0) & (value > float("-inf")), value)
