"""Decisions that depend on earlier ones: literal cases, random lines against a walk, and cuts that change nothing."""

import random

import pytest
from pyspark.sql import functions as F

from extractlab.operators import admission, contracts, flow, rules, timing


def decided(spark, rows, **more):
    df = spark.createDataFrame(rows, "service long, id long, owner long, t long, e long").repartition(3)
    return {r["id"]: (r["active"], r["own"], r["decision"]) for r in admission.admission(df, "service", "owner", "t", "e", **more).collect()}


def test_refused_requests_take_no_place(spark):
    got = decided(spark, [(1, 1, 7, 0, 100), (1, 2, 7, 50, 150), (1, 3, 7, 120, 200)])
    assert got == {1: (0, 0, "admitted"), 2: (1, 1, "active_document"), 3: (0, 0, "admitted")}
    # A run of over an hour counts to its end; a job that ends just then no longer runs.
    assert decided(spark, [(1, 1, 7, 0, 9000), (1, 2, 8, 8000, 8100), (1, 3, 7, 9000, 9100)]) == {1: (0, 0, "admitted"), 2: (1, 0, "admitted"), 3: (0, 0, "admitted")}


def test_a_full_service_is_busy(spark):
    got = decided(spark, [(1, i, i, i, 1000) for i in range(9)] + [(2, 20, 0, 5, 10)])
    assert [got[i][2] for i in range(9)] == ["admitted"] * 8 + ["busy"] and got[20] == (0, 0, "admitted")


def walked(rows, jobs):
    out, live = {}, {}
    for service, i, owner, t, e in sorted(rows, key=lambda r: (r[0], r[3], r[1])):
        own = [x for x in live.get(service, []) if x[0] > t]
        mine = sum(o == owner for _, o in own)
        say = "active_document" if mine else "busy" if len(own) >= jobs else "admitted"
        out[i] = (len(own), mine, say)
        live[service] = own + ([(e, owner)] if say == "admitted" else [])
    return out


@pytest.mark.parametrize("block", [admission.BLOCK, 50])
def test_admission_against_a_walk(spark, monkeypatch, block):
    monkeypatch.setattr(admission, "BLOCK", block)
    r = random.Random(5)
    rows = [(r.randrange(3), i, r.randrange(9), t, t + r.choice([0, 1, 30, 400])) for i, t in enumerate(r.randrange(4000) for _ in range(600))]
    assert decided(spark, rows, jobs=3) == walked(rows, 3)


def test_alerts_against_a_walk(spark, monkeypatch):
    monkeypatch.setattr(admission, "BLOCK", 700)
    r = random.Random(6)
    times = sorted(r.randrange(20_000) for _ in range(900)) + [30_000] * 40 + [50_000]
    held, last, wanted = [], None, []
    for i, t in enumerate(times):
        held = [x for x in held if x > t - 300] + [t]
        if len(held) >= 12 and (last is None or last <= t - 300):
            last = t
            wanted.append((t, i))
    df = spark.createDataFrame([(t, i) for i, t in enumerate(times)], "t long, event_id long").repartition(4)
    assert sorted(tuple(x) for x in admission.alerts(df, "t", "event_id", 12, 300).collect()) == wanted and len(wanted) > 5


def test_delivery_cases(spark):
    """(part, attempt, t, ended, outcome, retry_after, cancelled, parts) with a window of 60 seconds and three attempts."""
    logs = {
        "complete": [(1, 1, 0, 1, "confirmed", 0, None, 2), (2, 1, 1, 2, "confirmed", 0, None, 2)],
        "unfinished": [(1, 1, 0, 1, "confirmed", 0, None, 2)],
        "cancelled": [(1, 1, 0, 1, "confirmed", 0, 1, 2), (2, 1, 1, 2, "confirmed", 0, 1, 2)],
        "failed": [(1, 1, 0, 1, "retry_after", 5, None, 1), (1, 2, 6, 7, "retry_after", 5, None, 1), (1, 3, 12, 13, "retry_after", 5, None, 1), (1, 4, 20, 21, "confirmed", 0, None, 1)],
        "late": [(1, 1, 0, 1, "retry_after", 59, None, 1)],
        "again": [(1, 1, 0, 1, "retry_after", 58, None, 1), (1, 2, 59, 59, "confirmed", 0, None, 1)],
        "over": [(1, 1, 0, 1, "confirmed", 0, None, 2), (2, 1, 60, 61, "confirmed", 0, None, 2)],
        "blocked": [(1, 1, 0, 1, "forbidden", 0, None, 1)], "uncertain": [(1, 1, 0, 1, "timed_out", 0, None, 1), (1, 2, 1, 2, "confirmed", 0, None, 1)],
    }
    schema = "delivery string, part int, attempt int, t long, ended long, outcome string, retry_after long, cancelled long, parts int"
    df = spark.createDataFrame([(k, *r) for k, rows in logs.items() for r in rows], schema)
    got = {r["delivery"]: (r["outcome"], r["part"]) for r in flow.delivered(df, "delivery", "parts", 60, 3).collect()}
    assert got == {
        "complete": ("complete", None), "unfinished": ("unfinished", None), "cancelled": ("cancelled", 2), "failed": ("failed", 1), "late": ("failed", 1), "again": ("complete", None),
        "over": ("failed", 2), "blocked": ("blocked", 1), "uncertain": ("uncertain", 1),
    }


def test_capture_cases(spark):
    rows = [
        ("PNG", 1, True, "camera", None, 5, 1), ("JPEG", 10**8, True, "camera", None, 5, 1), ("JPEG", 1, True, "camera", None, 2560, 21 << 20),
        ("JPEG", 1, False, "telegram", "standard", 1281, 1 << 30), ("JPEG", 1, False, "telegram", "hd", 1280, 1), ("JPEG", 1, False, "telegram", "hd", 2560, 1), ("JPEG", 1, False, "camera", None, 2561, 20 << 20),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, f string, px long, gps boolean, source string, sent string, side int, size long")
    got = [r["x"] for r in df.select("i", contracts.capture_reasons(*(F.col(c) for c in ("f", "px", "gps", "source", "sent", "side", "size"))).alias("x")).orderBy("i").collect()]
    assert got == [["not_jpeg"], ["pixel_limit"], ["location_metadata_present", "camera_original_too_small", "exceeds_bot_api_file_limit"], ["telegram_standard_size_mismatch"], ["telegram_hd_size_mismatch"], [], []]


def test_first_and_later(spark):
    rows = [("a", i, w) for i, w in enumerate([90, 10, 20, 30, 90])] + [("b", 1, 5)]
    got = {r["k"]: r.asDict() for r in timing.first_and_later(spark.createDataFrame(rows, "k string, i int, wall int"), ["k"], "i", "wall").collect()}
    assert got["a"] == {"k": "a", "count": 5, "p50": 30.0, "p95": 90.0, "first_case": 90, "later_p50": 25.0, "later_count": 4}
    assert got["b"] == {"k": "b", "count": 1, "p50": 5.0, "p95": 5.0, "first_case": 5, "later_p50": None, "later_count": 0}


def test_list_spread(spark):
    rows = [(1, "x", [1]), (1, "x", [2]), (2, "x", [1]), (2, "y", [2]), (3, "x", [1, 2]), (4, "x", [3])]
    got = {r["job"]: (r["crosses_pages"], r["record_split"]) for r in rules.list_spread(spark.createDataFrame(rows, "job int, l string, p array<int>"), ["job"], "l", "p").collect()}
    assert got == {1: (True, False), 2: (False, False), 3: (True, True), 4: (False, False)}
