"""The full report of a corpus: every counter of a case, summed over all cases and over each label of five dimensions.

Two tables go in. ``cases`` (case_id, the dimensions, quality, execution_state, expected_matching and
actual_matching, expected_profile, selected_profile, automatic, consistent: whether the selection is what the matching
response names, expected_outcome and actual_outcome, recognised) and ``values`` (case_id, kind: scalar or
list_cell, identity, pos, status, value, pages, truth_status, truth_value, allowed: other values that count,
truth_pages, present). ``shapes`` (case_id, given, wanted, row) has the ids that came back and those that were asked for: a row for
the fields and one for the lists of a case, and one with ``row`` true for each row of a list. ``structures``, if there are
lists, is what :func:`extractlab.operators.structure.structure` says of them. Cells of lists whose rows are matched already can be counted by row
(:func:`cell_counts`) and come as sums beside that; then no cell is a row of ``values`` and no row of a list one of ``shapes``.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from extractlab.functions.scalar import zero_error_bound

#: The dimensions, the states of an execution, the kinds of a value.
DIMENSIONS = ("script", "language", "category", "quality", "delivery_path")
STATES = ("completed", "failed", "cancelled", "timeout", "not_run", "input_refused")
KINDS = ("scalar", "list_cell")
_OF_KIND = ("accepted_values", "incorrect_accepted_values", "known_values", "known_values_recovered", "readable_present_values", "readable_present_values_recovered")
CASE_COUNTERS = (
    "cases", "readable_cases", "unambiguous_profiles", "automatic_profile_selections", "correct_automatic_profile_selections",
    "incorrect_automatic_profile_selections", "matching_status_errors", "outcome_errors", *(f"{s}_cases" for s in STATES),
)
VALUE_COUNTERS = (
    "readable_present_values", "known_readable_values", "accepted_values", "correct_accepted_values", "incorrect_accepted_values",
    "known_readable_values_recovered", "readable_present_values_recovered", "false_missing_values", *(f"{k}_{c}" for k in KINDS for c in _OF_KIND),
)
#: Of the sums of :func:`cell_counts`, those that counters need.
CELL_SUMS = ["_taken", "_right", "_missing", "_true", "_present", "_odd"]
SHAPE_COUNTERS = ("schema_errors", "list_structure_errors", "confirmed_empty_lists")


def matches(own: Column | None = None, true: Column | None = None) -> Column:
    """An extracted value is right if it equals the truth or an allowed variant, and its pages are among the truth's. ``own`` and
    ``true`` hold the value and its truth, if they aren't columns."""
    o, t = (lambda name, of=of: F.col(name) if of is None else of[name] for of in (own, true))
    same = o("value").eqNullSafe(t("truth_value")) | F.array_contains(t("allowed"), o("value"))
    pages = (F.size(o("pages")) > 0) & (F.size(F.array_except(o("pages"), t("truth_pages"))) == 0)
    return F.coalesce((o("status") == "extracted") & (t("truth_status") == "extracted") & same & pages, F.lit(False))


def wrong_shape(given: Column, wanted: Column, row: Column) -> Column:
    """Whether a set of ids isn't what was asked for; a set of fields or lists may name none twice."""
    return ~(F.array_sort(F.array_distinct(given)) == F.array_sort(wanted)) | (~row & (F.size(F.array_distinct(given)) < F.size(given)))


def shape_errors(shapes: DataFrame) -> DataFrame:
    """(case_id, schema_errors): one for each set of ids that isn't what was asked for."""
    return shapes.groupBy("case_id").agg(F.count_if(wrong_shape(F.col("given"), F.col("wanted"), F.col("row"))).alias("schema_errors"))


def cell_counts(wanted: Column) -> dict[str, Column]:
    """Counts of one of :func:`extractlab.operators.alignment.matched_rows`, to be summed by list or case: its cells, and what
    :func:`extractlab.operators.structure.judgement` wants of rows. ``wanted`` are the ids of a row's cells."""
    cells, truth, own = F.coalesce("own.cells", F.array()), F.col("truth"), F.col("own")
    at = lambda c, status: c["status"] == status
    of = lambda t: F.struct(t["truth_status"].alias("truth_status"), F.get(t["truth_values"], F.lit(0)).alias("truth_value"), F.coalesce(t["truth_values"], F.array().cast("array<string>")).alias("allowed"), t["truth_pages"].alias("truth_pages"))
    same = lambda c, t: t["field_id"] == c["field_id"]
    matched, real = F.col("own.matched").isNotNull(), F.size(truth) > 0
    right = F.filter(cells, lambda c: at(c, "extracted") & F.exists(truth, lambda t: same(c, t) & matches(c, of(t))))
    said = F.aggregate(F.filter(cells, lambda c: at(c, "missing")), F.lit(0), lambda n, c: n + F.size(F.filter(truth, lambda t: same(c, t) & t["present"])))
    absent = F.transform(F.filter(cells, lambda c: at(c, "missing")), lambda c: c["field_id"])
    blank = own.isNotNull() & ~matched & real & ~F.col("own.accepted") & (F.size(F.array_except("own.pages", "truth_pages")) == 0)
    extra = own.isNotNull() & ~matched
    given = F.transform(cells, lambda c: c["field_id"])
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return {
        "_taken": F.size(F.filter(cells, lambda c: at(c, "extracted"))), "_right": F.when(matched, F.size(F.array_distinct(F.transform(right, lambda c: c["field_id"])))).otherwise(0),
        "_missing": F.when(matched, said).otherwise(0), "_true": F.size(F.filter(truth, lambda t: t["truth_status"] == "extracted")), "_present": F.size(F.filter(truth, lambda t: t["present"])),
        "_odd": one(own.isNotNull() & wrong_shape(given, wanted, F.lit(True))), "_rows": one(own.isNotNull()), "_extra": one(extra), "_accepted": one(extra & F.col("own.accepted")),
        "_claims": F.when(blank, F.size(F.array_intersect(absent, F.transform(F.filter(truth, lambda t: t["present"]), lambda t: t["field_id"])))).otherwise(0), "_expected": one(real),
    }


def context_columns() -> dict[str, Column]:
    """Of a case: whether it delivered a recognition (known), and under the right profile (context)."""
    c = F.col
    delivered = c("execution_state") == "completed"
    told = ~c("automatic") | (c("actual_matching") == "matched")
    context = delivered & told & c("consistent") & (c("expected_matching") == "matched") & c("selected_profile").eqNullSafe(c("expected_profile"))
    return {"known": delivered & c("recognised"), "context": context}


def counted(cases: DataFrame, values: DataFrame, shapes: DataFrame, structures: DataFrame | None = None) -> DataFrame:
    """All counters of each case. Only completed executions deliver results, but every case and every true value
    stays in the denominators; a value is credited once; without the right profile no value is right."""
    cases = cases.withColumns(context_columns())
    delivered, context = F.col("execution_state") == "completed", F.col("context")
    automatic = delivered & F.col("automatic") & (F.col("actual_matching") == "matched")
    seen = F.when(F.col("execution_state") == "input_refused", "input_refused").when(delivered, F.col("actual_matching"))
    known = F.col("known")
    flags = {
        "cases": F.lit(True), "readable_cases": F.col("quality") == "readable", "unambiguous_profiles": F.col("expected_matching") == "matched",
        "automatic_profile_selections": automatic, "correct_automatic_profile_selections": automatic & context, "incorrect_automatic_profile_selections": automatic & ~context,
        "matching_status_errors": ~seen.eqNullSafe(F.col("expected_matching")),
        "outcome_errors": F.when(known, F.col("actual_outcome") != F.col("expected_outcome")).otherwise(F.col("expected_matching") == "matched"),
        **{f"{s}_cases": F.col("execution_state") == s for s in STATES},
    }
    base = cases.select("case_id", *DIMENSIONS, context.alias("_context"), known.alias("_known"), *(F.when(c, 1).otherwise(0).cast("long").alias(k) for k, c in flags.items()))
    facts = values.join(base.select("case_id", "_context", "_known", F.col("readable_cases").alias("_readable")), "case_id").withColumn("_match", F.col("_known") & F.col("_context") & matches())
    first = F.row_number().over(Window.partitionBy("case_id", "kind", "identity").orderBy((~F.col("_match")).cast("int"), "pos")) == 1
    facts = facts.withColumn("_right", F.col("_match") & first)
    taken, right = F.col("_known") & (F.col("status") == "extracted"), F.col("_right")
    true, visible = F.col("truth_status") == "extracted", F.col("present") & (F.col("_readable") == 1)
    of = {
        "accepted_values": taken, "incorrect_accepted_values": taken & ~right, "known_values": true, "known_values_recovered": right,
        "readable_present_values": visible, "readable_present_values_recovered": right & (F.col("_readable") == 1),
    }
    sums = {
        "readable_present_values": visible, "known_readable_values": true, "accepted_values": taken, "correct_accepted_values": right, "incorrect_accepted_values": taken & ~right,
        "known_readable_values_recovered": right, "readable_present_values_recovered": right & (F.col("_readable") == 1),
        "false_missing_values": F.col("_known") & F.col("_context") & (F.col("status") == "missing") & F.col("present"),
        **{f"{k}_{c}": (F.col("kind") == k) & x for k in KINDS for c, x in of.items()},
    }
    by_case = facts.groupBy("case_id").agg(*(F.count_if(c).alias(k) for k, c in sums.items()))
    whole = base.join(by_case, "case_id", "left").join(shape_errors(shapes), "case_id", "left")
    if structures is None:
        whole = whole.withColumns({"list_structure_errors": F.lit(0).cast("long"), "confirmed_empty_lists": F.lit(0).cast("long"), "_blank": F.lit(0).cast("long")})
    else:
        whole = whole.join(structures.withColumnRenamed("false_missing_values", "_blank"), "case_id", "left")
    whole = whole.na.fill(0, [*VALUE_COUNTERS, *SHAPE_COUNTERS, "_blank"])
    if structures is not None and "_taken" in structures.columns:
        whole = with_cells(whole)
    of_known = {k: F.when(F.col("_known"), F.col(k)).otherwise(0) for k in SHAPE_COUNTERS}
    blank = F.when(F.col("_known") & F.col("_context"), F.col("_blank")).otherwise(0)
    return whole.withColumns(of_known | {"false_missing_values": F.col("false_missing_values") + blank}).drop("_context", "_known", "_blank")


def with_cells(whole: DataFrame) -> DataFrame:
    """Counters of cases with those of the cells of their lists, which are sums of :func:`cell_counts`."""
    whole = whole.na.fill(0, CELL_SUMS)
    here = lambda c, *when: F.when(reduce(and_, when), F.col(c)).otherwise(0)
    known, context, readable = F.col("_known"), F.col("_context"), F.col("readable_cases") == 1
    taken, right, true, present = here("_taken", known), here("_right", known, context), F.col("_true"), here("_present", readable)
    seen = here("_right", known, context, readable)
    of = {"accepted_values": taken, "incorrect_accepted_values": taken - right, "known_values": true, "known_values_recovered": right, "readable_present_values": present, "readable_present_values_recovered": seen}
    more = {
        "readable_present_values": present, "known_readable_values": true, "accepted_values": taken, "correct_accepted_values": right, "incorrect_accepted_values": taken - right, "known_readable_values_recovered": right,
        "readable_present_values_recovered": seen, "false_missing_values": here("_missing", known, context), "schema_errors": F.col("_odd"), **{f"list_cell_{k}": x for k, x in of.items()},
    }
    return whole.withColumns({k: F.col(k) + x for k, x in more.items()}).drop(*CELL_SUMS)


def report(counts: DataFrame) -> DataFrame:
    """(dimension, label, all counters, rates, bounds): sums over all cases and each label, in one pass."""
    names = [*CASE_COUNTERS, *VALUE_COUNTERS, *SHAPE_COUNTERS]
    sets = [[], *([F.col(d)] for d in DIMENSIONS)]
    out = counts.groupingSets(sets, *(F.col(d) for d in DIMENSIONS)).agg(*(F.sum(c).alias(c) for c in names), *(F.grouping(d).alias(f"_{d}") for d in DIMENSIONS))
    dimension = F.coalesce(*(F.when(F.col(f"_{d}") == 0, d) for d in DIMENSIONS), F.lit("total"))
    label = F.coalesce(*(F.when(F.col(f"_{d}") == 0, F.col(d)) for d in DIMENSIONS), F.lit("all"))

    def rate(a: str, b: str) -> Column:
        return F.round(F.try_divide(a, b), 9)

    kinds = [
        x for k in KINDS for x in (
            rate(f"{k}_incorrect_accepted_values", f"{k}_accepted_values").alias(f"{k}_error_rate"), rate(f"{k}_known_values_recovered", f"{k}_known_values").alias(f"{k}_recall"),
            rate(f"{k}_readable_present_values_recovered", f"{k}_readable_present_values").alias(f"{k}_readable_completeness"),
            F.round(zero_error_bound(F.col(f"{k}_accepted_values"), F.col(f"{k}_incorrect_accepted_values")), 9).alias(f"{k}_bound"),
        )
    ]
    return out.select(
        dimension.alias("dimension"), label.alias("label"), *names,
        rate("incorrect_accepted_values", "accepted_values").alias("accepted_value_error"), rate("incorrect_automatic_profile_selections", "automatic_profile_selections").alias("automatic_profile_error"),
        rate("readable_present_values_recovered", "readable_present_values").alias("readable_completeness"), rate("known_readable_values_recovered", "known_readable_values").alias("known_value_recall"),
        rate("correct_automatic_profile_selections", "unambiguous_profiles").alias("profile_selection_recall"), *kinds,
        F.round(zero_error_bound(F.col("accepted_values"), F.col("incorrect_accepted_values")), 9).alias("accepted_values_bound"),
        F.round(zero_error_bound(F.col("automatic_profile_selections"), F.col("incorrect_automatic_profile_selections")), 9).alias("automatic_profiles_bound"),
    )
