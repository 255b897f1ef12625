"""Rows of an extracted list against the rows of the truth, both in document order, by sparse weighted chaining.

Only pairs of rows that share something are made: an equi-join on a list's field and value finds the exactly matching
accepted cells of each pair, another one the agreeing missing cells of rows without an accepted one. Of a list's
pairs the best chain is then taken: with suffix maxima in a binary indexed tree it costs k log k for k pairs, never the
product of both lengths, and a task holds the pairs of one list. Lists of a few rows are weighed many at a time, in a small table.

Joins want their tables dealt out by all their keys, so each of several shuffles every cell. :func:`weighed` and :func:`matched_rows` are unions and
groupings instead, with the case among their keys: tables dealt out by case beforehand, over equally many tasks, aren't shuffled again.

Actual cells: case_id, list_id, pos (from 0), field_id, status, value, pages, row_pages. Expected cells: case_id, list_id, ix (from 0),
field_id, truth_status, truth_values (all that count), truth_pages, truth_row_pages, present.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from extractlab.operators import structure

LIST = ("case_id", "list_id")
#: Lists of at most so many rows on both sides are weighed in a table; their weights are below LIGHT, so that their sums are one number.
SHORT, LIGHT = 12, 1 << 15
Weight = tuple[int, int, int]


class SuffixMaxima:
    """The largest weight among the expected rows from a given one on."""

    def __init__(self, rows: list[int]):
        self.rows, self.tree = rows, [(0, 0, 0)] * (len(rows) + 1)

    def put(self, row: int, weight: Weight) -> None:
        k = len(self.rows) - bisect_left(self.rows, row)
        while k < len(self.tree):
            self.tree[k] = max(self.tree[k], weight)
            k += k & -k

    def after(self, row: int) -> Weight:
        k, most = len(self.rows) - bisect_left(self.rows, row + 1), (0, 0, 0)
        while k > 0:
            most = max(most, self.tree[k])
            k &= k - 1
        return most


def best_chain(pairs: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """The order-preserving (actual, expected) of some (actual, expected, correct, missing) with the most (correct cells,
    agreeing missing cells, pairs), lexicographically. From a place on, of equally good ways the one that pairs the nearest expected
    row counts, with its first actual row; else the one that skips the most actual rows, with its first expected row.

    Pairs of one total form a staircase, as one before another would have a larger total; so the next pair of a
    chain is found in it by bisection."""
    totals: dict[Weight, list[tuple[int, int, Weight]]] = defaultdict(list)
    maxima = SuffixMaxima(sorted({e for _, e, _, _ in pairs}))
    most = (0, 0, 0)
    by_row: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for a, e, c, m in pairs:
        by_row[a].append((e, c, m))
    for a in sorted(by_row, reverse=True):
        found = []
        for e, c, m in sorted(by_row[a]):
            c2, m2, n2 = maxima.after(e)
            total = (c + c2, m + m2, 1 + n2)
            found.append((e, total))
            totals[total].append((a, e, (c, m, 1)))
        for e, total in found:
            maxima.put(e, total)
            most = max(most, total)
    out, i, j = [], 0, 0
    stairs = {t: sorted(own, key=lambda p: (p[0], -p[1])) for t, own in totals.items()}
    while most != (0, 0, 0):
        own = stairs[most]
        stop = bisect_left(own, 1, key=lambda p: p[1] < j)  # expected rows fall along the stairs
        near = bisect_left(own, 1, bisect_left(own, i, key=lambda p: p[0]), stop, key=lambda p: p[1] <= j)
        a, e, w = own[near] if near < stop else own[stop - 1]
        out.append((a, e))
        i, j, most = a + 1, e + 1, tuple(x - y for x, y in zip(most, w, strict=True))
    return out


def short_chains(of: np.ndarray, actual: np.ndarray, expected: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(list, actual, expected) of the best chains of many short lists at once, whose numbers are ``of``: the best sums from each place on, and a
    walk through them that takes a pair, else skips the actual row, else the expected one."""
    lists, n, m = int(of.max()) + 1, int(actual.max()) + 1, int(expected.max()) + 1
    own = np.zeros((n, m, lists), np.int64)
    own[actual, expected, of] = weight
    best = np.zeros((n + 1, m + 1, lists), np.int64)
    for i in reversed(range(n)):
        for j in reversed(range(m)):
            best[i, j] = np.maximum(np.maximum(best[i + 1, j], best[i, j + 1]), np.where(own[i, j] > 0, own[i, j] + best[i + 1, j + 1], 0))
    at, i, j = np.arange(lists), np.zeros(lists, int), np.zeros(lists, int)
    out = []
    while len(at):
        here = best[i, j, at]
        pair = (own[i, j, at] > 0) & (own[i, j, at] + best[i + 1, j + 1, at] == here)
        up = here == best[i + 1, j, at]
        out.append((at[pair], i[pair], j[pair]))
        i, j = i + (pair | up), j + (pair | ~up)
        inside = (i < n) & (j < m)
        at, i, j = at[inside], i[inside], j[inside]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _matched(rows: pa.Table, out: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The matched rows of whole lists, whose pairs follow each other, each list's first one with a _place of 1."""
    place, actual, expected, correct, missing = (rows[c].to_numpy() for c in ("_place", "actual", "expected", "correct", "missing"))
    starts = np.flatnonzero(place == 1)
    if not len(starts):
        return
    of = np.cumsum(place == 1) - 1
    short = np.maximum.reduceat(np.maximum(actual, expected), starts) < SHORT
    short &= np.maximum.reduceat(np.maximum(correct, missing), starts) < LIGHT
    found = [(np.empty(0, int),) * 3]
    if short.any():
        few = short[of]
        number = np.cumsum(short) - 1
        k, a, e = short_chains(number[of[few]], actual[few], expected[few], (correct[few].astype(np.int64) << 40) + (missing[few].astype(np.int64) << 20) + 1)
        found.append((np.flatnonzero(short)[k], a, e))
    for k in np.flatnonzero(~short):
        own = slice(starts[k], starts[k + 1] if k + 1 < len(starts) else None)
        chain = best_chain(list(zip(*(c[own].tolist() for c in (actual, expected, correct, missing)), strict=True)))
        found.append((np.full(len(chain), k), *np.array(chain, int).reshape(-1, 2).T))
    k, a, e = (np.concatenate(x) for x in zip(*found, strict=True))
    own = rows.select(out.names[:-2]).take(pa.array(starts[k]))
    yield from pa.table([*own.columns, pa.array(a, pa.int32()), pa.array(e, pa.int32())], schema=out).to_batches()


def align_rows(weights: DataFrame, keys: list[str]) -> DataFrame:
    """Matched (keys, actual, expected) of the pairs (keys, actual, expected, correct, missing) of every list."""
    kinds = dict(weights.dtypes)
    schema = StructType.fromDDL(", ".join([*(f"{k} {kinds[k]}" for k in keys), "actual int", "expected int"]))
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last list may go on in the next batch
        for b in batches:
            starts = np.flatnonzero(b["_place"].to_numpy() == 1)
            if len(starts):
                last = int(starts[-1])
                yield from _matched(pa.Table.from_batches([*held, b.slice(0, last)]), out)
                held = [b.slice(last)]
            elif b.num_rows:
                held.append(b)
        if held:
            yield from _matched(pa.Table.from_batches(held), out)

    # The window brings a list's pairs together, with a shuffle only where they aren't yet; its number tells lists apart.
    part = weights.select(*keys, *(F.col(c).cast("int") for c in ("actual", "expected", "correct", "missing")))
    part = part.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy("actual", "expected"))).sortWithinPartitions(*keys, "actual", "expected")
    return part.mapInArrow(run, schema)


def contained(pages: Column, within: Column) -> Column:
    return F.size(F.array_except(pages, within)) == 0


def row_weights(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """(case_id, list_id, actual, expected, correct, missing): pairs of rows that can be one. The actual row's pages lie within the
    expected row's; a row with accepted cells needs an exactly correct one, a row without needs an agreeing missing one."""
    # A row's few columns go along with it, so that pairs are counted in one shuffle and no cell is joined again.
    own = actual.groupBy(*LIST, "pos").agg(
        F.first("row_pages").alias("row_pages"), F.collect_list(F.when(F.col("status") == "extracted", F.struct("field_id", "value", "pages"))).alias("_taken"), F.collect_list(F.when(F.col("status") == "missing", F.col("field_id"))).alias("_absent"))
    real = expected.groupBy(*LIST, "ix").agg(
        F.first("truth_row_pages").alias("truth_row_pages"), F.collect_list(F.when(F.col("truth_status") == "extracted", F.struct("field_id", F.array_distinct("truth_values").alias("values"), "truth_pages"))).alias("_true"),
        F.collect_list(F.when(F.col("truth_status") == "missing", F.col("field_id"))).alias("_gone"))
    taken = own.select(*LIST, "pos", "row_pages", "_absent", F.explode("_taken").alias("t")).select(*LIST, "pos", "row_pages", "_absent", "t.field_id", F.col("t.value").alias("_value"), "t.pages")
    true = real.select(*LIST, "ix", "truth_row_pages", "_gone", F.explode("_true").alias("t")).select(*LIST, "ix", "truth_row_pages", "_gone", "t.field_id", F.explode("t.values").alias("_value"), "t.truth_pages")
    same = taken.join(true, [*LIST, "field_id", "_value"]).where((F.size("pages") > 0) & contained(F.col("pages"), F.col("truth_pages")) & contained(F.col("row_pages"), F.col("truth_row_pages")))
    # Missing cells count for pairs with a correct cell, and by themselves for rows without an accepted one.
    beside = F.aggregate("_absent", F.lit(0), lambda n, f: n + F.size(F.filter("_gone", lambda g: g == f)))
    both = same.select(*LIST, "pos", "ix", beside.cast("long").alias("missing")).groupBy(*LIST, "pos", "ix").agg(F.count("*").alias("correct"), F.max("missing").alias("missing"))
    absent = own.where(F.size("_taken") == 0).select(*LIST, "pos", "row_pages", F.explode("_absent").alias("field_id"))
    gone = real.select(*LIST, "ix", "truth_row_pages", F.explode("_gone").alias("field_id"))
    blank = absent.join(gone, [*LIST, "field_id"]).where(contained(F.col("row_pages"), F.col("truth_row_pages")))
    alone = blank.groupBy(*LIST, "pos", "ix").agg(F.count("*").alias("missing")).withColumn("correct", F.lit(0).cast("long"))
    return both.unionByName(alone).select(*LIST, F.col("pos").alias("actual"), F.col("ix").alias("expected"), "correct", "missing")


def actual_rows(actual: DataFrame) -> DataFrame:
    """(case_id, list_id, pos, row_pages, cells) of cells: one row for each row of a list."""
    return actual.groupBy(*LIST, "pos").agg(F.first("row_pages").alias("row_pages"), F.collect_list(F.struct("field_id", "status", "value", "pages")).alias("cells"))


def expected_rows(expected: DataFrame) -> DataFrame:
    """(case_id, list_id, ix, truth_row_pages, truth) of true cells."""
    cell = F.struct("field_id", "truth_status", "truth_values", "truth_pages", "present")
    return expected.groupBy(*LIST, "ix").agg(F.first("truth_row_pages").alias("truth_row_pages"), F.collect_list(cell).alias("truth"))


def weighed(rows: DataFrame, truth: DataFrame) -> DataFrame:
    """What :func:`row_weights` says, of whole rows and without a join: what can agree meets in groups by case, field and value, so that
    rows that are dealt out by case stay where they are."""
    told = lambda status: F.filter("cells", lambda c: (c["status"] == status) & c["field_id"].isNotNull())
    mark = lambda field, value, pages: F.struct(field.alias("field_id"), value.alias("value"), pages.alias("pages"))
    nowhere = F.lit(None).cast("array<int>")
    # A row with accepted cells is known by their values, one without by its missing cells, whose value is null.
    own = rows.select(*LIST, "pos", "row_pages", told("extracted").alias("_taken"), F.transform(told("missing"), lambda c: c["field_id"]).alias("_absent"))
    marks = F.when(F.size("_taken") > 0, F.transform(F.filter("_taken", lambda c: c["value"].isNotNull() & (F.size(c["pages"]) > 0)), lambda c: mark(c["field_id"], c["value"], c["pages"])))
    own = own.select(*LIST, F.struct("pos", "row_pages", "_absent").alias("a"), F.explode(marks.otherwise(F.transform("_absent", lambda f: mark(f, F.lit(None).cast("string"), nowhere)))).alias("k"))
    true = lambda status: F.filter("truth", lambda t: (t["truth_status"] == status) & t["field_id"].isNotNull())
    values = F.flatten(F.transform(true("extracted"), lambda t: F.transform(F.array_compact(F.array_distinct(t["truth_values"])), lambda v: mark(t["field_id"], v, t["truth_pages"]))))
    gone = F.transform(true("missing"), lambda t: t["field_id"])
    real = truth.select(*LIST, F.struct("ix", "truth_row_pages", gone.alias("_gone")).alias("e"), F.explode(F.concat(values, F.transform(gone, lambda f: mark(f, F.lit(None).cast("string"), nowhere)))).alias("k"))
    key = [*LIST, F.col("k.field_id").alias("field_id"), F.col("k.value").alias("value")]
    both = own.select(*key, F.struct("a.*", "k.pages").alias("a")).unionByName(real.select(*key, F.struct("e.*", "k.pages").alias("e")), allowMissingColumns=True)
    met = both.groupBy(*LIST, "field_id", "value").agg(F.collect_list("a").alias("a"), F.collect_list("e").alias("e")).where((F.size("a") > 0) & (F.size("e") > 0))
    pairs = met.select(*LIST, F.col("value").isNotNull().cast("long").alias("correct"), F.explode("a").alias("a"), "e").select(*LIST, "correct", "a", F.explode("e").alias("e"))
    pairs = pairs.where(contained(F.col("a.row_pages"), F.col("e.truth_row_pages")) & ((F.col("correct") == 0) | contained(F.col("a.pages"), F.col("e.pages"))))
    beside = F.aggregate("a._absent", F.lit(0), lambda n, f: n + F.size(F.filter("e._gone", lambda g: g == f)))
    return pairs.select(*LIST, F.col("a.pos").alias("actual"), F.col("e.ix").alias("expected"), "correct", beside.cast("long").alias("missing")).groupBy(
        *LIST, "actual", "expected").agg(F.sum("correct").alias("correct"), F.max("missing").alias("missing"))


def matched_rows(actual: DataFrame, expected: DataFrame, pairs: DataFrame) -> DataFrame:
    """(case_id, list_id, own: pos, pages, cells, accepted, matched; truth_pages, truth): every actual row with the expected one that it is matched with
    or, a blank one, that has its place in the gap (see :func:`extractlab.operators.structure.placed`); and every expected row of no actual one, whose ``own`` is null.

    Rows meet as groups of one union, not in joins, so that tables that are dealt out by case stay where they are."""
    cell = F.struct("field_id", "status", "value", "pages")
    met = actual.unionByName(pairs.select(*LIST, F.col("actual").alias("pos"), F.col("expected").alias("matched")), allowMissingColumns=True)
    rows = met.groupBy(*LIST, "pos").agg(F.first("row_pages", True).alias("pages"), F.collect_list(F.when(F.col("matched").isNull(), cell)).alias("cells"), F.max("matched").alias("matched"))
    rows = structure.placed(rows.withColumn("accepted", F.exists("cells", lambda c: c["status"].eqNullSafe("extracted"))))
    own = rows.select(*LIST, F.coalesce("ix", -1 - F.col("pos")).alias("_at"), F.struct("pos", "pages", "cells", "accepted", "matched").alias("own"))
    true = F.struct("field_id", "truth_status", "truth_values", "truth_pages", "present").alias("true")
    whole = own.unionByName(expected.select(*LIST, F.col("ix").alias("_at"), "truth_row_pages", true), allowMissingColumns=True)
    return whole.groupBy(*LIST, "_at").agg(F.first("own", True).alias("own"), F.first("truth_row_pages", True).alias("truth_pages"), F.collect_list("true").alias("truth"))


def cell_values(actual: DataFrame, expected: DataFrame, pairs: DataFrame) -> DataFrame:
    """Cells with their truth, by the matched rows, as values of a report: kind, identity, pos, status, value, pages, truth_status, truth_value,
    allowed, truth_pages, present. Cells of unmatched rows have no truth; true cells that no row matched have no status."""
    met = pairs.select(*LIST, F.col("actual").alias("pos"), F.col("expected").alias("ix"))
    own = actual.join(met, [*LIST, "pos"], "left").select(*LIST, "pos", "field_id", "status", "value", "pages", F.coalesce("ix", F.lit(-1)).alias("ix"))
    true = expected.select(*LIST, "ix", "field_id", "truth_status", "truth_values", "truth_pages", "present")
    both = own.join(true, [*LIST, "ix", "field_id"], "full")
    identity = F.to_json(F.struct("list_id", F.when(F.col("ix") >= 0, F.col("ix")).alias("ix"), "field_id"), {"ignoreNullFields": "false"})
    return both.select(
        "case_id", F.lit("list_cell").alias("kind"), identity.alias("identity"), F.coalesce("pos", F.lit(-1)).alias("pos"), "status", "value", "pages", "truth_status",
        F.get("truth_values", F.lit(0)).alias("truth_value"), F.coalesce("truth_values", F.array().cast("array<string>")).alias("allowed"), "truth_pages", F.coalesce("present", F.lit(False)).alias("present"),
    )
