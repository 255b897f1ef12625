"""Operators that need a fold in order: each reads one group (a job, an owner, a list) after another.

Groups are not materialised: rows are dealt out by key, sorted within each partition and read as a stream,
so many small groups cost no more than their rows and a large one needs no memory but its fold's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

OUT_ROWS = 10_000


def in_order(rows: DataFrame, key: str, order: list[str], fold: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str | StructType) -> DataFrame:
    """What ``fold`` yields for the rows of each key, which it gets in order; the key is their first column."""
    part = rows.select(key, *(c for c in rows.columns if c != key)).repartition(key).sortWithinPartitions(key, *order)
    out = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(out)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for _, group in groupby(stream(batches), itemgetter(0)):
            for row in fold(group):
                held.append(row)
                if len(held) >= OUT_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), arrow.types, strict=True)], schema=arrow)
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), arrow.types, strict=True)], schema=arrow)

    return part.mapInArrow(run, out)


def pack_greedily(rows: DataFrame, key: str, order: str, size: str, capacity: int, joint: int = 0) -> DataFrame:
    """(key, order, pack, used): in order, a row joins the open pack if it fits together with a separator of
    ``joint``, else it opens the next one. A row over the capacity stands alone with ``used`` null."""

    def fold(group: Iterator[tuple]) -> Iterator[tuple]:
        pack, used = 0, None
        for k, o, n in group:
            if used is not None and used + joint + n <= capacity:
                used += joint + n
            else:
                pack, used = pack + 1, n if n <= capacity else None
            yield k, o, pack, used

    kinds = dict(rows.dtypes)
    return in_order(rows.select(key, order, size), key, [order], fold, f"{key} {kinds[key]}, {order} {kinds[order]}, pack int, used bigint")


def throttled(events: DataFrame, key: str, time: str, order: str, pause: int) -> DataFrame:
    """The events that go out when the next one must come at least ``pause`` after the last that did."""

    def fold(group: Iterator[tuple]) -> Iterator[tuple]:
        last = None
        for row in group:
            if last is None or row[1] - last >= pause:
                last = row[1]
                yield row

    part = events.select(key, time, order)
    return in_order(part, key, [time, order], fold, part.schema)
