"""The full corpus report over the stand-in tables."""

from __future__ import annotations

from extractlab.operators import report
from extractlab.plans.registry import query
from extractlab.sources.adapters import table

# Cases: two languages of a script, six execution states, matching and outcome expected and found.
_CASES = """(SELECT d.doc_id AS case_id, d.lang AS script, d.lang || CASE WHEN d.doc_id % 2 = 0 THEN '-a' ELSE '-b' END AS language, d.source AS category, CASE WHEN l.quality = 1 THEN 'readable' ELSE 'difficult' END AS quality,
      CASE WHEN d.doc_id % 3 = 0 THEN 'pdf' ELSE 'photo' END AS delivery_path,
      CASE WHEN d.doc_id % 13 = 0 THEN 'failed' WHEN d.doc_id % 17 = 0 THEN 'timeout' WHEN d.doc_id % 41 = 0 THEN 'cancelled' WHEN d.doc_id % 43 = 0 THEN 'not_run' WHEN d.doc_id % 47 = 0 THEN 'input_refused' ELSE 'completed' END AS execution_state,
      CASE WHEN d.doc_id % 10 < 8 THEN 'matched' WHEN d.doc_id % 47 = 0 THEN 'input_refused' ELSE 'no_profile' END AS expected_matching, CASE WHEN d.doc_id % 11 < 9 THEN 'matched' ELSE 'uncertain' END AS actual_matching,
      d.doc_id % 3 AS expected_profile, CASE WHEN d.doc_id % 31 = 0 THEN 7 ELSE d.doc_id % 3 END AS selected_profile, d.doc_id % 6 <> 5 AS automatic, d.doc_id % 37 <> 0 AS consistent,
      CASE WHEN d.doc_id % 4 = 0 THEN 'partial' ELSE 'complete' END AS expected_outcome, CASE WHEN d.doc_id % 5 = 0 THEN 'partial' ELSE 'complete' END AS actual_outcome, d.doc_id % 23 <> 0 AS recognised
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
# Three values of a case, of which the second cell sometimes repeats the first one's identity.
_VALUES = """(SELECT d.doc_id AS case_id, CASE WHEN v = 0 THEN 'scalar' ELSE 'list_cell' END AS kind, CASE WHEN v = 2 AND d.doc_id % 9 = 0 THEN 1 ELSE v END AS identity, v AS pos,
      CASE WHEN (d.doc_id + v) % 11 = 0 THEN 'ambiguous' WHEN (d.doc_id + v) % 5 = 0 THEN 'missing' ELSE 'extracted' END AS status,
      CAST(CASE WHEN (d.doc_id + v) % 19 = 0 THEN (d.n_chars + 1) % 10 WHEN (d.doc_id + v) % 7 = 1 THEN d.n_chars % 10 + 100 ELSE d.n_chars % 10 END AS INT) AS value, ARRAY_OF(1 + v % 2) AS pages,
      CASE WHEN (d.doc_id + v) % 7 = 0 THEN 'missing' ELSE 'extracted' END AS truth_status, CAST(d.n_chars % 10 AS INT) AS truth_value, ARRAY_OF(CAST(d.n_chars % 10 + CASE WHEN d.doc_id % 2 = 0 THEN 100 ELSE 200 END AS INT)) AS allowed,
      CASE WHEN d.doc_id % 29 = 0 THEN ARRAY_OF(1) ELSE ARRAY_OF(1, 2) END AS truth_pages, (d.doc_id + v) % 7 <> 0 AS present
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id CROSS JOIN (SELECT 0 AS v UNION ALL SELECT 1 UNION ALL SELECT 2) k)"""
# What was asked for and what came back: the fields, the lists, and one row of a list.
_SHAPES = """(SELECT d.doc_id AS case_id, ARRAY_OF('a', 'b') AS wanted, CASE WHEN (d.doc_id + v) % 53 = 0 THEN ARRAY_OF('a') WHEN (d.doc_id + v) % 59 = 0 THEN ARRAY_OF('b', 'a', 'a') ELSE ARRAY_OF('b', 'a') END AS given, v = 2 AS row
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id CROSS JOIN (SELECT 0 AS v UNION ALL SELECT 1 UNION ALL SELECT 2) k)"""


def _dialect(sql: str, spark: bool) -> str:
    return sql.replace("ARRAY_OF", "array" if spark else "list_value")


_FLAGS = {
    "cases": "true", "readable_cases": "quality = 'readable'", "unambiguous_profiles": "expected_matching = 'matched'", "automatic_profile_selections": "auto", "correct_automatic_profile_selections": "auto AND ctx",
    "incorrect_automatic_profile_selections": "auto AND NOT ctx", "matching_status_errors": "CASE WHEN execution_state = 'input_refused' THEN 'input_refused' WHEN execution_state = 'completed' THEN actual_matching END IS DISTINCT FROM expected_matching",
    "outcome_errors": "CASE WHEN known THEN actual_outcome <> expected_outcome ELSE expected_matching = 'matched' END", **{f"{s}_cases": f"execution_state = '{s}'" for s in report.STATES},
}
_OF = {
    "accepted_values": "taken", "incorrect_accepted_values": "taken AND NOT ok", "known_values": "truth_status = 'extracted'", "known_values_recovered": "ok", "readable_present_values": "present AND readable", "readable_present_values_recovered": "ok AND readable",
}
_SUMS = {
    "readable_present_values": "present AND readable", "known_readable_values": "truth_status = 'extracted'", "accepted_values": "taken", "correct_accepted_values": "ok", "incorrect_accepted_values": "taken AND NOT ok",
    "known_readable_values_recovered": "ok", "readable_present_values_recovered": "ok AND readable", "false_missing_values": "known AND ctx AND status = 'missing' AND present",
    **{f"{k}_{c}": f"kind = '{k}' AND ({x})" for k in report.KINDS for c, x in _OF.items()},
}
_COUNTED = f"""(WITH c AS (SELECT *, execution_state = 'completed' AND automatic AND actual_matching = 'matched' AS auto, execution_state = 'completed' AND recognised AS known,
        execution_state = 'completed' AND (NOT automatic OR actual_matching = 'matched') AND consistent AND expected_matching = 'matched' AND selected_profile = expected_profile AS ctx FROM {_dialect(_CASES, False)} x),
    m AS (SELECT v.*, ctx, known, quality = 'readable' AS readable, known AND ctx AND status = 'extracted' AND truth_status = 'extracted' AND (value = truth_value OR list_contains(allowed, value)) AND len(list_filter(pages, lambda p: NOT list_contains(truth_pages, p))) = 0 AS hit
        FROM {_dialect(_VALUES, False)} v JOIN c USING (case_id)),
    f AS (SELECT *, known AND status = 'extracted' AS taken, hit AND row_number() OVER (PARTITION BY case_id, kind, identity ORDER BY CAST(NOT hit AS INT), pos) = 1 AS ok FROM m),
    s AS (SELECT case_id, {", ".join(f"count(*) FILTER (WHERE {x}) AS {k}" for k, x in _SUMS.items())} FROM f GROUP BY case_id),
    h AS (SELECT case_id, count(*) FILTER (WHERE len(given) <> 2 AND NOT (row AND len(given) = 3)) AS e FROM {_dialect(_SHAPES, False)} y GROUP BY case_id)
    SELECT c.case_id, script, language, category, quality, delivery_path, {", ".join(f"CAST({x} AS BIGINT) AS {k}" for k, x in _FLAGS.items())}, {", ".join(f"coalesce({k}, 0) AS {k}" for k in _SUMS)},
        CASE WHEN known THEN coalesce(e, 0) ELSE 0 END AS schema_errors, 0 AS list_structure_errors, 0 AS confirmed_empty_lists FROM c LEFT JOIN s ON c.case_id = s.case_id LEFT JOIN h ON c.case_id = h.case_id)"""


def _rate(a: str, b: str, name: str) -> str:
    return f"round(sum({a}) / nullif(sum({b}), 0), 9) AS {name}"


_RATES = ", ".join([
    _rate("incorrect_accepted_values", "accepted_values", "accepted_value_error"), _rate("incorrect_automatic_profile_selections", "automatic_profile_selections", "automatic_profile_error"),
    _rate("readable_present_values_recovered", "readable_present_values", "readable_completeness"), _rate("known_readable_values_recovered", "known_readable_values", "known_value_recall"),
    _rate("correct_automatic_profile_selections", "unambiguous_profiles", "profile_selection_recall"),
    *(x for k in report.KINDS for x in (
        _rate(f"{k}_incorrect_accepted_values", f"{k}_accepted_values", f"{k}_error_rate"), _rate(f"{k}_known_values_recovered", f"{k}_known_values", f"{k}_recall"),
        _rate(f"{k}_readable_present_values_recovered", f"{k}_readable_present_values", f"{k}_readable_completeness"))),
    *(f"CASE WHEN sum({b}) = 0 AND sum({a}) > 0 THEN round(1 - pow(0.05, 1.0 / sum({a})), 9) END AS {n}" for a, b, n in (
        *((f"{k}_accepted_values", f"{k}_incorrect_accepted_values", f"{k}_bound") for k in report.KINDS), ("accepted_values", "incorrect_accepted_values", "accepted_values_bound"), ("automatic_profile_selections", "incorrect_automatic_profile_selections", "automatic_profiles_bound"))),
])
_ALL = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in (*report.CASE_COUNTERS, *report.VALUE_COUNTERS, *report.SHAPE_COUNTERS))


def _counted(spark, sf):
    tables = {t: table(spark, sf, t) for t in ("documents", "labels")}

    def read(sql: str):
        sql = _dialect(sql, True).replace("FROM documents d", "FROM {documents} d").replace("JOIN labels l", "JOIN {labels} l")
        return spark.sql(f"SELECT * FROM {sql} x", **tables)

    return report.counted(read(_CASES), read(_VALUES), read(_SHAPES))


@query("full_counts", f"SELECT * FROM {_COUNTED} c")
def full_counts(spark, sf):
    return _counted(spark, sf)


@query("full_report", " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, {label} AS label, {_ALL}, {_RATES} FROM {_COUNTED} c GROUP BY 1, 2" for d, label in [("total", "'all'"), *((d, d) for d in report.DIMENSIONS)]))
def full_report(spark, sf):
    return report.report(_counted(spark, sf))
