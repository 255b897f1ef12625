"""Operators on literal cases: precedence, stitching, alignment, limits, selection, the store."""

from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from extractlab.operators import admission, alignment, flow, merge, ordered, store, verify


@pytest.mark.parametrize(("readings", "status", "raw"), [
    ([("missing", None), ("missing", None)], "missing", None), ([("missing", None), ("unreadable", None)], "unreadable", None),
    ([("extracted", "A"), ("ambiguous", None)], "ambiguous", None), ([("invalid", "x"), ("missing", None)], "invalid", "x"),
    ([("extracted", "A"), ("extracted", "A"), ("extracted", "B")], "ambiguous", None), ([("extracted", "A"), ("missing", None)], "extracted", "A"),
    ([("extracted", "é"), ("extracted", "e\u0301")], "ambiguous", None),
])
def test_scalars(spark, readings, status, raw):
    rows = spark.createDataFrame([(1, i, s, r) for i, (s, r) in enumerate(readings)], "job int, batch int, status string, raw string")
    got = merge.merge_scalars(rows, ["job"]).first()
    assert (got["status"], got["raw"]) == (status, raw)


def test_incomplete_traversal_is_unreadable(spark):
    rows = spark.createDataFrame([(1, 0, "missing", None)], "job int, batch int, status string, raw string")
    assert merge.merge_scalars(rows, ["job"], F.lit(False)).first()["status"] == "unreadable"


def test_stitching(spark):
    rows = [(1, 1, True, False, "x"), (1, 2, True, True, "x"), (1, 3, False, True, "x"), (1, 4, False, False, "y"), (1, 5, True, False, "z")]
    df = spark.createDataFrame(rows, "job int, pos int, continues_next boolean, continues_previous boolean, a string")
    got = [(r["parts"], r["lone"], r["a"]) for r in merge.stitch(df, "job", "pos", ["a"]).orderBy("island").collect()]
    assert got == [(3, False, "x"), (1, False, "y"), (1, True, None)]


CASES = [("AB", (2, 0)), ("BA", (1, 1)), ("AA", (1, 1)), ("ABC", (2, 1)), ("A", (1, 0)), ("XB", (1, 1))]


@pytest.mark.parametrize(("actual", "counts"), CASES)
def test_alignment(actual, counts):
    pairs = alignment.best_chain([(i, j, 1, 0) for i, a in enumerate(actual) for j in range(2) if a == "AB"[j]])
    assert (len(pairs), len(actual) - len(pairs)) == counts


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 6), st.integers(0, 6), st.data())
def test_alignment_is_the_preferred_best_one(n, m, data):
    """Of all ways from each place: a pair first, then skipping the actual row, then the expected one, whichever is largest."""
    weights = {(i, j): data.draw(st.sampled_from([None, (0, 1), (1, 0), (1, 1), (2, 0)])) for i, j in product(range(n), range(m))}
    known = {}

    def way(i, j):
        if i == n or j == m:
            return (0, 0, 0), ()
        if (i, j) not in known:
            ways = [way(i + 1, j), way(i, j + 1)]
            if weights[i, j]:
                total, rest = way(i + 1, j + 1)
                ways.insert(0, (tuple(x + y for x, y in zip(total, (*weights[i, j], 1), strict=True)), ((i, j), *rest)))
            known[i, j] = max(ways, key=lambda w: w[0])
        return known[i, j]

    got = alignment.best_chain([(i, j, *w) for (i, j), w in weights.items() if w])
    assert tuple(got) == way(0, 0)[1]


def test_long_lists_align_without_a_table():
    """Two lists of 20,000 rows with 60,000 pairs in common."""
    pairs = [(i, j, 1, 0) for i in range(20_000) for j in (i - 7, i, i + 3) if 0 <= j < 20_000]
    got = alignment.best_chain(pairs)
    assert len(got) == 20_000 and got[0] == (0, 0) and got[-1] == (19_999, 19_999)


def test_row_weights_need_shared_cells_and_pages(spark):
    cells = "case_id int, list_id string, pos int, field_id string, status string, value string, pages array<int>, row_pages array<int>"
    actual = spark.createDataFrame([
        (1, "x", 0, "a", "extracted", "A", [1], [1]), (1, "x", 0, "b", "missing", None, [], [1]), (1, "x", 1, "a", "missing", None, [], [1]), (1, "x", 1, "b", "missing", None, [], [1]),
        (1, "x", 2, "a", "extracted", "Z", [1], [1]), (1, "x", 2, "b", "missing", None, [], [1]), (1, "x", 3, "a", "extracted", "A", [2], [2]),
    ], cells)
    true = "case_id int, list_id string, ix int, field_id string, truth_status string, truth_values array<string>, truth_pages array<int>, truth_row_pages array<int>, present boolean"
    expected = spark.createDataFrame([(1, "x", 0, "a", "extracted", ["A", "B", "A"], [1], [1], True), (1, "x", 0, "b", "missing", None, [1], [1], False), (1, "x", 1, "a", "extracted", ["C"], [1, 2], [1, 2], True)], true)
    got = {tuple(r) for r in alignment.row_weights(actual, expected).collect()}
    assert got == {(1, "x", 0, 0, 1, 1), (1, "x", 1, 0, 0, 1)}
    pairs = alignment.align_rows(alignment.row_weights(actual, expected), ["case_id", "list_id"])
    assert [tuple(r) for r in pairs.collect()] == [(1, "x", 0, 0)]
    values = {(r["pos"], r["identity"], r["status"], r["truth_status"]) for r in alignment.cell_values(actual, expected, pairs).collect()}
    assert len(values) == 8 and sum(v[0] == -1 for v in values) == 1


def test_packing(spark):
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate([5, 4, 3, 99, 10, 1])], "job long, pos int, cost int")
    got = [(r["pack"], r["used"]) for r in ordered.pack_greedily(df, "job", "pos", "cost", 10, 1).orderBy("pos").collect()]
    assert got == [(1, 5), (1, 10), (2, 3), (3, None), (4, 10), (5, 1)]


def test_lockout(spark):
    times = [(1, t, t, False) for t in (0, 1, 2, 3, 4)] + [(1, 10, 10, True), (1, 900, 900, True), (2, 5, 5, True)]
    df = spark.createDataFrame(times, "owner long, t long, event_id long, correct boolean")
    got = {(r["owner"], r["event_id"]): (r["result"], r["retry_after"]) for r in admission.lockouts(df).collect()}
    assert got[1, 3] == ("refused", None) and got[1, 4] == ("locked", 896) and got[1, 10] == ("locked", 890)
    assert got[1, 900] == ("accepted", None) and got[2, 5] == ("accepted", None)


def test_sessions_end_at_just_the_gap(spark):
    df = spark.createDataFrame([(1, 0, 1), (1, 899, 2), (1, 1799, 3)], "owner long, t long, event_id long")
    assert [(r["start"], r["events"]) for r in flow.sessions(df, "owner", "t", "event_id", 900).orderBy("start").collect()] == [(0, 2), (1799, 1)]


def test_grid_and_selection(spark):
    grid = verify.grid(spark).collect()
    assert len(grid) == 192 and (grid[127]["v2"], grid[127]["v1"], grid[127]["margin"]) == (True, 700, 900)
    assert verify.grid(spark, alternates=False).count() == 96
    rows = [(0, False, None, 0, 0.9, 1), (1, True, 700, 900, 0.9, 0), (2, True, 700, 900, 0.9, 0), (3, False, 300, 0, 0.5, 0)]
    df = spark.createDataFrame(rows, "index int, v2 boolean, v1 int, margin int, completeness double, wrong int").withColumn("wrong_profiles", F.lit(0))
    assert verify.select_point(df).first()["index"] == 1


@settings(max_examples=20, deadline=None)
@given(st.sampled_from(["extracted", "missing", "invalid", "ambiguous", "unreadable"]), st.integers(0, 1000), st.booleans(), st.sampled_from([None, "a", "b"]))
def test_verification_never_upgrades(spark, status, mille, well, alternate):
    got = spark.range(1).select(verify.ladder(F.lit(status), F.lit("a"), F.lit(well), F.lit(mille), 500, F.lit(alternate).cast("string")).alias("x")).first()["x"]
    assert got == status or status == "extracted"


def test_replay_matches_direct_decisions(spark):
    """The counts over threshold buckets equal those of every value at every point."""
    values = [(j, m, c, k) for j, m, c, k in product(range(3), (0, 300, 701, 999), (True, False), (True, False))]
    jobs = [(0, 0, True), (1, 200, True), (2, 901, False)]
    got = verify.risk_coverage(
        spark.createDataFrame(values, "job int, mille int, confirmed boolean, correct boolean"), spark.createDataFrame(jobs, "job int, lead int, right boolean"), spark
    ).collect()
    lead = {j: x for j, x, _ in jobs}
    for p in got:
        own = [v for v in values if (p["v1"] is None or v[1] >= p["v1"]) and (not p["v2"] or v[2]) and lead[v[0]] > 0 and lead[v[0]] > p["margin"]]
        assert (p["accepted"], p["wrong"]) == (len(own), sum(not v[3] for v in own))
        assert p["profiles"] == sum(x > 0 and x > p["margin"] for x in lead.values())


def test_store(spark):
    profiles = spark.createDataFrame([(1, 7, 2, "a", 1), (2, 7, 1, "b", 0)], "id long, owner long, version int, name string, created int")
    asks = spark.createDataFrame([(1, 7, 2), (1, 7, 1), (1, 8, 2), (2, 7, 1)], "id long, owner long, expected int")
    assert sorted(r["result"] for r in store.outcomes(profiles, asks).collect()) == ["applied", "applied", "conflict", "not_found"]
    assert {r["id"]: r["version"] for r in store.updated(profiles, asks).collect()} == {1: 3, 2: 2}
    assert store.deleted(profiles, asks).count() == 0
    drafts = spark.createDataFrame([(1, 1, 7, "a"), (2, 1, 7, "b"), (3, 2, 7, "c"), (1, 3, 7, "z"), (9, 3, 7, "n")], "id long, batch int, owner long, name string")
    assert {r["batch"]: r["result"] for r in store.saved(profiles, drafts).collect()} == {1: "unchanged", 2: "inserted", 3: "conflict"}


def test_rows_are_weighed_with_two_joins(spark):
    """One for exactly correct cells, one for rows without an accepted cell; missing cells beside a correct one need none, and count as often as they are given."""
    a = spark.createDataFrame([(1, "l", 0, "x", "extracted", "v", [1], [1]), (1, "l", 0, "y", "missing", None, [], [1]), (1, "l", 0, "y", "missing", None, [], [1]), (1, "l", 1, "y", "missing", None, [], [1])],
        "case_id int, list_id string, pos int, field_id string, status string, value string, pages array<int>, row_pages array<int>")
    e = spark.createDataFrame([(1, "l", 0, "x", "extracted", ["v", "v"], [1], [1], True), (1, "l", 0, "y", "missing", None, [], [1], False)],
        "case_id int, list_id string, ix int, field_id string, truth_status string, truth_values array<string>, truth_pages array<int>, truth_row_pages array<int>, present boolean")
    found = alignment.row_weights(a, e)
    assert sorted(tuple(r) for r in found.collect()) == [(1, "l", 0, 0, 1, 2), (1, "l", 1, 0, 0, 1)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
