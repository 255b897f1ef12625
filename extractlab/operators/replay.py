"""Replays of recorded jobs: what each would have come to under every calibration point, from its trace alone.

``jobs``: job, setup (seconds in any unit, like all times here), pages, manual (the user chose the profile), matching
(the recorded response's status; null: none recorded), lead (of the selected candidate; null: not measured), failure
(the code that ended the recording; null: none), phase (time charged to it), elapsed (time at the failure).
``batches``: job, batch, pages, first_s, rejects, attempted, second_s, second_error, second_rejects; the second reading
is that of the alternate view.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from extractlab.functions.scalar import zero_error_bound
from extractlab.operators.contracts import failure_state
from extractlab.operators.rules import undetermined
from extractlab.operators.verify import MARGIN_GRID, V1_GRID, grid

#: Why a trace can't tell how a job would have ended; an error that doesn't change the runtime's state.
UNREPLAYABLE = ("trace_without_matching", "trace_lacks_alternate_view", "trace_undetermined_for_policy", "trace_incomplete_for_policy")
HARMLESS, LATE = "recognition_contract_violation", "processing_budget_exhausted"
STATES = ("complete", "uncertain", "unmatched", "mixed", "timeout", "input_refused", "failed", "unreplayable")


def endings(jobs: DataFrame, batches: DataFrame, budget: int) -> DataFrame:
    """(job, off, on, passes): how each job ends without and with the alternate view, and how many of the grid's
    margins its match passes (all, if none applies). Once, with running totals, for all points: a token threshold
    never changes how a job ends, and a margin only whether its batches are read at all."""
    so_far = Window.partitionBy("job").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.col("attempted"), F.col("second_s")).otherwise(0)
    rows = jobs.join(batches.withColumnRenamed("pages", "_covered"), "job", "left")
    clock = F.col("setup") + F.sum("first_s").over(so_far)
    rows = rows.withColumn("_clock", clock).withColumn("_own", own).withColumn("_again", F.sum(own).over(so_far))
    second = F.col("second_error").isNotNull()
    off = F.when(F.col("_clock") > budget, LATE).when(F.col("rejects"), "mixed")
    on = (
        F.when(F.col("_clock") + F.col("_again") - F.col("_own") > budget, LATE).when(F.col("rejects"), "mixed").when(~F.col("attempted"), "trace_lacks_alternate_view")
        .when(F.col("_clock") + F.col("_again") > budget, LATE).when(second, F.col("second_error")).when(F.col("second_rejects"), "mixed")
    )
    facts = [c for c in jobs.columns if c != "job"]
    ends = rows.withColumn("_off", off).withColumn("_on", on).groupBy("job").agg(
        *(F.first(c).alias(c) for c in facts),
        *(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("batch"))).alias(c) for c in ("_off", "_on")),
        F.coalesce(F.sum("first_s"), F.lit(0)).alias("_firsts"), F.coalesce(F.sum("_own"), F.lit(0)).alias("_seconds"), F.coalesce(F.sum("_covered"), F.lit(0)).alias("_covered"),
        F.coalesce(F.bool_or(F.col("attempted") & second & (F.col("second_error") != HARMLESS)), F.lit(False)).alias("_broke"),
    )

    def last(spent: Column, skips: Column | None) -> Column:
        failed = F.when(spent + F.col("phase") > budget, LATE)
        if skips is not None:
            failed = failed.when(skips, "trace_undetermined_for_policy")
        failed = failed.otherwise(F.col("failure"))
        return F.when(F.col("failure").isNotNull(), failed).when(~F.col("_covered").eqNullSafe(F.col("pages")) | (F.col("_covered") == 0), "trace_incomplete_for_policy").otherwise("complete")

    total = F.col("setup") + F.col("_firsts")
    skips = undetermined(budget, F.col("_seconds"), F.col("_broke"), F.col("failure"), F.col("elapsed"))
    before = F.when(F.col("setup") > budget, LATE).when(
        ~F.col("manual"), F.when(F.col("matching").isNull(), "trace_without_matching").when(F.col("matching") != "matched", "unmatched")
    )
    passed = sum((F.when(F.col("lead") > m, 1).otherwise(0) for m in MARGIN_GRID), F.lit(0))
    passes = F.when(F.col("manual") | before.isNotNull(), len(MARGIN_GRID)).when(F.col("lead") > 0, passed).otherwise(0)
    return ends.select(
        "job", F.coalesce(before, F.col("_off"), last(total, skips)).alias("off"), F.coalesce(before, F.col("_on"), last(total + F.col("_seconds"), None)).alias("on"),
        passes.alias("passes"), "manual",
    )


def state(ending: Column) -> Column:
    """The execution's state by its ending."""
    return F.when(ending.isin("complete", "uncertain", "unmatched", "mixed"), ending).when(ending.isin(*UNREPLAYABLE), "unreplayable").otherwise(failure_state(ending))


def replay_grid(ends: DataFrame, jobs: DataFrame, values: DataFrame, spark: SparkSession) -> DataFrame:
    """For every calibration point: jobs by state, accepted values and automatically selected profiles, right and wrong.

    ``ends`` from :func:`endings`; ``jobs``: job, right (whether the selected profile is); ``values``: job, mille,
    confirmed, correct. Only merged results count. Jobs and values are first counted by what decides about
    them, so at most 2 x 8 x 9 and 12 x 2 x 2 x 2 x 9 counts meet the points, however many there are."""
    def at_least(x: Column, levels: tuple) -> Column:
        return sum((F.when(x >= t, 1).otherwise(0) for t in levels), F.lit(0))

    points = grid(spark).withColumn("_p1", F.coalesce(at_least(F.col("v1"), V1_GRID[1:]), F.lit(0))).withColumn("_p3", at_least(F.col("margin"), MARGIN_GRID))
    known = ends.join(jobs, "job")
    job_cells = known.select(F.explode(F.array(*(F.struct(F.lit(v2).alias("w2"), state(F.col(c)).alias("ending")) for v2, c in ((False, "off"), (True, "on"))))).alias("e"), "passes", "manual", "right")
    job_cells = job_cells.select("e.*", "passes", "manual", "right").groupBy("w2", "ending", "passes").agg(
        F.count("*").alias("n"), F.count_if(~F.col("manual")).alias("picked"), F.count_if(~F.col("manual") & ~F.col("right")).alias("mispicked")
    )
    met = points.join(F.broadcast(job_cells), F.col("v2") == F.col("w2"))
    read = F.col("passes") >= F.col("_p3")
    now = F.when(read, F.col("ending")).otherwise("uncertain")
    done = read & (F.col("ending") == "complete")
    by_state = met.groupBy("index").agg(
        *(F.sum(F.when(now == s, F.col("n")).otherwise(0)).alias(s) for s in STATES), F.sum(F.when(done, F.col("picked")).otherwise(0)).alias("profiles"), F.sum(F.when(done, F.col("mispicked")).otherwise(0)).alias("wrong_profiles")
    )
    cells = values.join(ends.select("job", "passes", (F.col("off") == "complete").alias("_off"), (F.col("on") == "complete").alias("_on")), "job").groupBy(
        at_least(F.col("mille"), V1_GRID[1:]).alias("c1"), F.col("confirmed").alias("c2"), "passes", "_off", "_on"
    ).agg(F.count("*").alias("n"), F.count_if(~F.col("correct")).alias("wrong"))
    fits = (F.col("c1") >= F.col("_p1")) & (F.col("passes") >= F.col("_p3")) & F.when(F.col("v2"), F.col("_on") & F.col("c2")).otherwise(F.col("_off"))
    by_value = points.join(F.broadcast(cells), fits).groupBy("index").agg(F.sum("n").alias("accepted"), F.sum("wrong").alias("wrong"))
    sums = [*STATES, "profiles", "wrong_profiles", "accepted", "wrong"]
    out = points.join(by_state, "index", "left").join(by_value, "index", "left").na.fill(0, sums)
    return out.select("index", "v2", "v1", "margin", *sums, F.round(zero_error_bound(F.col("accepted"), F.col("wrong")), 9).alias("bound"))
