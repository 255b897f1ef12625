"""Lists merged in document order, on literal cases: a status has a reason only if the list is unresolved."""

from extractlab import catalog
from extractlab.operators import lists, merge
from extractlab.plans import lists as plans
from extractlab.sources import adapters
from pyspark.sql import functions as F

X = ("extracted", "x")
SCHEMA = (
    "job int, batch int, row int, source_key string, pages string, continues_previous boolean, continues_next boolean, enumerated boolean, "
    "status string, reason string, traversed boolean, a_status string, a string"
)


def merged(spark, rows, traversed=True, empty=("complete", None), whole=True):
    """rows: (batch, row, key, previous, next, status, value)."""
    full = [
        (1, b, r, k, None if k is None else k[1:], p, n, whole, *(("complete", None) if r else empty), traversed, s, v) for b, r, k, p, n, s, v in rows
    ]
    return tuple(lists.merge_lists(spark.createDataFrame(full, SCHEMA), ["a"]).select("status", "reason", "rows").first())


def test_replays(spark):
    assert merged(spark, [(1, 1, "k", False, False, *X), (2, 1, "k", False, False, *X)]) == ("complete", None, 1)
    assert merged(spark, [(1, 1, "k", False, False, *X), (2, 1, "k", False, False, "extracted", "y")]) == ("unresolved", "ambiguous", 1)
    assert merged(spark, [(1, 1, "k", False, False, "missing", None), (2, 1, "k", False, False, *X)]) == ("partial", None, 1)
    assert merged(spark, [(1, 1, "k1", False, False, *X), (2, 1, "k2", False, False, *X)]) == ("complete", None, 2)  # other pages, another row


def test_continuations(spark):
    assert merged(spark, [(1, 1, "k", False, True, *X), (2, 1, "m", True, False, *X)]) == ("complete", None, 1)
    assert merged(spark, [(1, 1, "k", False, True, *X), (2, 1, "m", True, False, "extracted", "y")]) == ("unresolved", "ambiguous", 1)
    assert merged(spark, [(1, 1, "k", False, True, *X), (2, 1, "m", True, True, "missing", None), (3, 1, "n", True, False, *X)]) == ("complete", None, 1)
    assert merged(spark, [(1, 1, "k", False, True, *X)]) == ("unresolved", "ambiguous", 1)
    assert merged(spark, [(1, 1, "k", True, False, *X), (2, 1, "m", False, False, *X)]) == ("partial", None, 2)
    # A headless half is open, so what follows it can't join either.
    assert merged(spark, [(1, 1, "k", True, True, *X), (2, 1, "m", True, False, *X), (3, 1, "n", False, False, *X)]) == ("partial", None, 3)
    # A replay in between doesn't part two halves; a batch without rows does.
    assert merged(spark, [(1, 1, "j", False, False, *X), (1, 2, "k", False, True, *X), (2, 1, "j", False, False, *X), (3, 1, "m", True, False, *X)]) == ("complete", None, 2)
    assert merged(spark, [(1, 1, "k", False, True, *X), (2, None, None, None, None, None, None), (3, 1, "m", True, False, *X)]) == ("unresolved", "ambiguous", 2)


def test_empty_and_unread_lists(spark):
    none = (1, None, None, None, None, None, None)
    assert merged(spark, [none]) == ("complete", None, 0)
    assert merged(spark, [none], empty=("unresolved", "missing")) == ("unresolved", "missing", 0)
    assert merged(spark, [none], empty=("unresolved", "missing"), whole=False) == ("unresolved", "unreadable", 0)
    assert merged(spark, [none], empty=("unresolved", "unreadable")) == ("unresolved", "unreadable", 0)
    assert merged(spark, [(1, 1, "k", False, False, "missing", None)], traversed=False) == ("unresolved", "unreadable", 1)
    assert merged(spark, [(1, 1, "k", False, False, *X), (2, *none[1:])], empty=("unresolved", "unreadable")) == ("partial", None, 1)


def test_numbers_agree_in_normal_form(spark):
    from extractlab.functions.scalar import normal_number

    rows = spark.createDataFrame([(1, 1, "extracted", "10", [2, 1]), (1, 2, "invalid", "10.00", [3, 2]), (2, 1, "extracted", "x", [1]), (2, 2, "extracted", "10", [1])], "job int, batch int, status string, raw string, pages array<int>")
    got = {r["job"]: (r["status"], r["raw"], r["normalized"], r["pages"]) for r in merge.merge_scalars(rows, ["job"], normal=normal_number(F.col("raw"))).collect()}
    assert got == {1: ("extracted", "10", "10", [2, 1, 3]), 2: ("ambiguous", None, None, [1])}


def test_shares_grow_with_the_lines(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    for module in (adapters, plans):
        monkeypatch.setattr(module, "LINES", 500)
    wanted = adapters.shares(adapters.table(spark, sf, "lineitem"), 500)
    assert wanted > 8
    for name in ("merge_lists", "credited_once", "continuation_stitch"):
        assert catalog.queries()[name](spark, sf).rdd.getNumPartitions() == wanted, name
