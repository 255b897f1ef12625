"""Replays of traces against a walk through each job's calls."""

from pyspark.sql import functions as F

from extractlab.operators import replay, verify

JOBS = "job long, setup long, pages long, manual boolean, matching string, lead int, failure string, phase long, elapsed long"
BATCHES = "job long, batch int, pages long, first_s long, rejects boolean, attempted boolean, second_s long, second_error string, second_rejects boolean"


def walk(job, batches, v2, budget):
    """How the job ends, before any margin."""
    _, setup, pages, manual, matching, _, failure, phase, elapsed = job
    clock, skipped, broke = setup, 0, False
    if clock > budget:
        return "processing_budget_exhausted"
    if not manual and matching is None:
        return "trace_without_matching"
    if not manual and matching != "matched":
        return "unmatched"
    for _, _, _, first, rejects, attempted, second, error, again in batches:
        clock += first
        if clock > budget:
            return "processing_budget_exhausted"
        if rejects:
            return "mixed"
        if v2:
            if not attempted:
                return "trace_lacks_alternate_view"
            clock += second
            if clock > budget:
                return "processing_budget_exhausted"
            if error:
                return error
            if again:
                return "mixed"
        elif attempted:
            skipped += second
            broke = broke or error not in (None, "recognition_contract_violation")
    if failure:
        if clock + phase > budget:
            return "processing_budget_exhausted"
        if broke or (skipped and failure in ("processing_budget_exhausted", "runtime_timeout", "worker_timeout") and elapsed > budget):
            return "trace_undetermined_for_policy"
        return failure
    return "complete" if batches and sum(b[2] for b in batches) == pages else "trace_incomplete_for_policy"


def cases():
    jobs, batches = [], []
    failures = (None, "runtime_timeout", "worker_timeout", "runtime_failure", "damaged_input")
    for i in range(600):
        n = i % 4
        jobs.append((i, 5 + 40 * (i % 17 == 0), n + (i % 13 == 0), i % 6 == 0, (None, "matched", "matched", "uncertain")[i // 5 % 4], None if i % 11 == 0 else i * 37 % 1000 - 50, failures[i // 3 % 5], i % 9, 20 + i % 30))
        for b in range(n):
            x = i * 31 + b * 17
            batches.append((i, b + 1, 1, x % 12, x % 19 == 0, x % 7 != 0, x % 9, (None, None, "runtime_failure", "recognition_contract_violation")[x // 7 % 4], x % 23 == 0))
    return jobs, batches


def test_endings_match_a_walk(spark):
    jobs, batches = cases()
    found = replay.endings(spark.createDataFrame(jobs, JOBS), spark.createDataFrame(batches, BATCHES), 35)
    got = {r["job"]: (r["off"], r["on"]) for r in found.collect()}
    assert got == {j[0]: tuple(walk(j, [b for b in batches if b[0] == j[0]], v2, 35) for v2 in (False, True)) for j in jobs}
    assert {x for pair in got.values() for x in pair} >= {*replay.UNREPLAYABLE, "complete", "mixed", "unmatched", "processing_budget_exhausted", "damaged_input"}


def test_the_grid_counts_every_job_at_every_point(spark):
    jobs, batches = cases()
    ends = replay.endings(spark.createDataFrame(jobs, JOBS), spark.createDataFrame(batches, BATCHES), 35)
    values = [(j[0], j[0] * 7 % 1000, j[0] % 3 > 0, j[0] % 5 > 0) for j in jobs]
    right = spark.createDataFrame([(j[0], j[0] % 4 > 0) for j in jobs], "job long, right boolean")
    got = replay.replay_grid(ends, right, spark.createDataFrame(values, "job long, mille int, confirmed boolean, correct boolean"), spark).collect()
    by_id = {j[0]: j for j in jobs}
    for p in got:
        states = {}
        for j in jobs:
            end = walk(j, [b for b in batches if b[0] == j[0]], p["v2"], 35)
            barred = j[1] > 35 or j[3] or j[4] != "matched"
            lead = j[5]
            states[j[0]] = end if barred or (lead is not None and lead > 0 and lead > p["margin"]) else "uncertain"
        done = {k for k, s in states.items() if s == "complete"}
        taken = [v for v in values if v[0] in done and (p["v1"] is None or v[1] >= p["v1"]) and (not p["v2"] or v[2])]
        assert sum(p[s] for s in replay.STATES) == len(jobs) and p["complete"] == len(done)
        assert p["unreplayable"] == sum(s in replay.UNREPLAYABLE for s in states.values()) and p["uncertain"] == sum(s == "uncertain" for s in states.values())
        assert (p["accepted"], p["wrong"]) == (len(taken), sum(not v[3] for v in taken))
        assert p["profiles"] == sum(not by_id[k][3] for k in done) and p["wrong_profiles"] == sum(not by_id[k][3] and k % 4 == 0 for k in done)


def test_empty_traces(spark):
    ends = replay.endings(spark.createDataFrame([], JOBS), spark.createDataFrame([], BATCHES), 35)
    right, values = spark.createDataFrame([], "job long, right boolean"), spark.createDataFrame([], "job long, mille int, confirmed boolean, correct boolean")
    assert replay.replay_grid(ends, right, values, spark).agg(F.sum("complete"), F.count("*")).first()[:] == (0, 192)


def test_a_point_with_unreplayable_cases_is_not_selected(spark):
    rows = [(0, False, None, 0, 0, 0, 0.9, 1), (1, True, 300, 0, 0, 0, 0.5, 0), (2, False, 300, 0, 0, 0, 0.5, 0)]
    points = spark.createDataFrame(rows, "index int, v2 boolean, v1 int, margin int, wrong long, wrong_profiles long, completeness double, unreplayable long")
    assert [r["index"] for r in verify.select_point(points).collect()] == [2]
