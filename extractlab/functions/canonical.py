"""Canonical bytes of nested JSON: names in order at every level, no white space, UTF-8 kept, no NaN.

Spark's own writers keep neither a number's spelling nor refuse repeated names, so one pass over each text runs
in Python over Arrow batches. Equal values have equal bytes whatever the order of their names.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Unusable(ValueError):
    """Not strict JSON; the text is a fixed code."""


def _once(pairs: list[tuple[str, object]]) -> dict[str, object]:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise Unusable("duplicate_key")
    return found


def _finite(_: str) -> float:
    raise Unusable("non_finite_number")


def canonical_text(text: str, layout: dict[str, str | list[str]] | None = None) -> str:
    """A text in canonical form, or, of an object, what a layout picks: names to a name, or to an object of several."""
    value = json.loads(text, object_pairs_hook=_once, parse_constant=_finite)
    if layout is not None:
        value = {new: value[old] if isinstance(old, str) else {n: value[n] for n in old} for new, old in layout.items()}
    try:
        return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)
    except ValueError:  # a number beyond the largest double is read as infinite
        raise Unusable("non_finite_number") from None


def canonical_json(text: Column, layout: dict[str, str | list[str]] | None = None) -> Column:
    """struct(problem, text): the canonical form, or why there is none (``no_text``, ``invalid_json``, ``duplicate_key``, ``non_finite_number``,
    ``other_names`` if a layout finds no name that it picks)."""

    def read(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            try:
                out.append((None, canonical_text(t, layout)) if t is not None else ("no_text", None))
            except Unusable as e:
                out.append((str(e), None))
            except (ValueError, RecursionError):
                out.append(("invalid_json", None))
            except (KeyError, TypeError):
                out.append(("other_names", None))
        return pd.DataFrame(out, columns=["problem", "text"])

    return F.pandas_udf(read, "problem string, text string")(text)


def canonical_sha256(text: Column) -> Column:
    """Lowercase hex of the canonical bytes' digest; null if there are none."""
    return F.sha2(canonical_json(text)["text"], 256)
