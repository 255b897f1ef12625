"""Many stand-in corpora, each judged as a whole."""

from __future__ import annotations

from extractlab.operators import corpus, planning
from extractlab.plans.registry import query
from extractlab.sources.adapters import table

# Every 70 events are a corpus; each rule holds for some of them only.
_CASES = """SELECT corpus, i, CASE WHEN i <= 40 + CASE WHEN corpus % 6 = 5 THEN 1 ELSE 0 END THEN 'readable' WHEN i <= 60 THEN 'difficult' ELSE 'negative' END AS quality, concat('s', i % (5 + corpus % 2)) AS script, concat('c', (i * 7) % (6 + corpus % 3)) AS category,
    CASE WHEN i <= 24 THEN 'image_file' WHEN i <= 32 + corpus % 2 THEN 'pdf' ELSE 'photo' END AS delivery_path, CASE WHEN corpus % 5 = 0 THEN 'review' ELSE 'quality_measurement' END AS purpose, NOT (corpus % 3 = 0 AND i = 3) AS reviewed,
    corpus % 7 <> 0 AS sealed, corpus % 4 = 0 AND i % 40 = 35 AS simulated, NOT (corpus % 3 = 1 AND i = 39) AS verified, NOT (corpus % 5 = 1 AND i = 55) AS captured, i % (2 + corpus % 4) = 0 AS crosses, i = 26 + corpus % 9 AS splits,
    CASE WHEN i BETWEEN 33 AND 60 THEN 'chat' END AS source, CASE WHEN i BETWEEN 33 AND 40 THEN CASE WHEN i < 37 + corpus % 2 THEN 'hd' ELSE 'standard' END END AS sent_quality, CASE WHEN i BETWEEN 41 AND 60 THEN concat('k', i % (4 + corpus % 2)) END AS condition,
    CASE WHEN i IN (5, 6 + corpus % 2 * 40) THEN 2 ELSE 1 END AS inputs, CASE WHEN i <= 12 THEN 'two_sided_card' WHEN i > 60 THEN concat('n', i % (5 + corpus % 2)) ELSE 'plain' END AS scenario, concat('l', i % (3 + corpus % 3)) AS layout,
    CASE WHEN i % 9 = 0 THEN concat('t', corpus % 2) END AS table_style, CASE WHEN i BETWEEN 41 AND 60 THEN i - 40 + CASE WHEN corpus % 6 = 0 AND i = 60 THEN -1 ELSE 0 END END AS printed, CASE WHEN corpus % 8 = 0 AND i = 2 THEN 2 ELSE 3 END AS profiles,
    CASE WHEN corpus % 9 = 0 AND i = 1 THEN 'other' ELSE 'own' END AS owner, CASE WHEN corpus % 4 = 1 THEN 'tuning' ELSE 'benchmark' END AS split
    FROM (SELECT CAST(floor(event_id / 70.0) AS BIGINT) AS corpus, event_id % 70 + 1 AS i FROM events) e"""
_SCRIPTS, _CATEGORIES, _CONDITIONS = [f"s{i}" for i in range(5)], [f"c{i}" for i in range(6)], [f"k{i}" for i in range(4)]
_SCENARIOS, _LAYOUTS, _NEW = [f"n{i}" for i in range(5) for _ in range(2)], [f"l{i}" for i in range(5)], ["l4", "t0", "t1"]


def _set(value: str, where: str = "true") -> str:
    return f"coalesce(list_sort(list(DISTINCT {value}) FILTER (WHERE {where})), [])"


def _least(value: str, labels: list[str], k: int, where: str) -> str:
    return f"len(list_filter({labels}, lambda x: len(list_filter(coalesce(list({value}) FILTER (WHERE {where}), []), lambda y: x = y)) < {k})) > 0"


_R, _D, _N = "quality = 'readable'", "quality = 'difficult'", "quality = 'negative'"
_BOTH = {
    "review_preparation_only": "NOT bool_and(purpose = 'quality_measurement')", "human_review_or_ground_truth_pending": "NOT bool_and(reviewed)",
    "diversity_incomplete": f"{_set('script')} <> {_SCRIPTS} OR {_set('category')} <> {_CATEGORIES} OR {_set('quality')} <> ['difficult', 'negative', 'readable']",
}
_BENCHMARK = _BOTH | {
    "wrong_split": "NOT bool_and(split = 'benchmark')", "benchmark_composition_incomplete": f"[count(*) FILTER (WHERE {_R}), count(*) FILTER (WHERE {_D}), count(*) FILTER (WHERE {_N})] <> [40, 20, 10]",
    "benchmark_not_sealed_and_frozen": "NOT bool_and(sealed)", "benchmark_image_delivery_paths_incomplete": f"NOT list_has_all({_set('delivery_path', _R)}, ['photo', 'image_file'])",
    "benchmark_telegram_photo_delivery_unverified": "bool_or(delivery_path = 'photo' AND NOT (verified AND NOT simulated))", "benchmark_difficult_cases_require_physical_photographs": f"bool_or({_D} AND NOT captured)",
    "benchmark_physical_photo_coverage_incomplete": f"sum(CASE WHEN {_D} AND delivery_path = 'photo' AND captured AND NOT simulated THEN 1 ELSE 0 END) < 10",
}
_COMPOSITION = {
    "quality_composition": f"[count(*) FILTER (WHERE {_R}), count(*) FILTER (WHERE {_D}), count(*) FILTER (WHERE {_N}), count(*)] <> [40, 20, 10, 70]",
    "readable_script_coverage": _least("script", _SCRIPTS, 6, _R), "readable_category_coverage": _least("category", _CATEGORIES, 4, _R),
    "readable_delivery_split": f"[count(*) FILTER (WHERE {_R} AND delivery_path = 'image_file'), count(*) FILTER (WHERE {_R} AND delivery_path = 'pdf'), count(*) FILTER (WHERE {_R} AND delivery_path = 'photo')] <> [24, 8, 8]",
    "readable_multipage_list_across_boundary": f"count(*) FILTER (WHERE {_R} AND delivery_path = 'pdf' AND crosses) < 3", "readable_record_split_across_boundary": f"count(*) FILTER (WHERE {_R} AND delivery_path = 'pdf' AND splits) = 0",
    "readable_telegram_quality_split": f"[count(*) FILTER (WHERE {_R} AND sent_quality = 'standard'), count(*) FILTER (WHERE {_R} AND sent_quality = 'hd')] <> [4, 4]",
    "readable_two_sided_cards": f"count(*) FILTER (WHERE {_R} AND delivery_path = 'image_file' AND inputs = 2 AND scenario = 'two_sided_card') < 2",
    "readable_layout_variety": f"len(list_filter({_NEW}, lambda x: list_contains({_set('layout', _R)}, x) OR list_contains({_set('table_style', _R)}, x))) < 2 OR len({_set('layout', _R)}) < 4",
    "difficult_condition_coverage": _least("condition", _CONDITIONS, 3, _D), "difficult_telegram_photo_count": f"count(*) FILTER (WHERE {_D} AND source = 'chat') < 10",
    "difficult_script_coverage": f"{_set('script', _D)} <> {_SCRIPTS}", "difficult_category_coverage": f"len(list_filter({_set('category', _D)}, lambda x: x IN ('c0', 'c1', 'c2', 'c3', 'c4', 'c5'))) < 6",
    "printable_pages": f"coalesce(list_sort(list(CAST(printed AS BIGINT)) FILTER (WHERE {_D})), []) <> range(1, count(*) FILTER (WHERE {_D}) + 1)",
    "negative_scenarios": f"coalesce(list_sort(list(scenario) FILTER (WHERE {_N})), []) <> {_SCENARIOS}", "profile_library": "count(DISTINCT owner) <> 1 OR bool_or(profiles <> 3)",
}


def _oracle(rules: dict[str, str]) -> str:
    whens = ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in rules.items())
    return f"SELECT corpus, array_to_string(list_sort(list_filter([{whens}], lambda x: x IS NOT NULL)), ',') AS reasons FROM ({_CASES}) c GROUP BY corpus"


def _cases(spark, sf):
    return spark.sql(_CASES.replace("FROM events", "FROM {events}"), events=table(spark, sf, "events"))


@query("benchmark_eligibility", _oracle(_BENCHMARK))
def benchmark_eligibility(spark, sf):
    cases = _cases(spark, sf)
    return corpus.reasons(cases, planning.eligibility("benchmark", cases["split"], _SCRIPTS, _CATEGORIES), "corpus")


@query("calibration_eligibility", _oracle(_BOTH | {"wrong_split": "NOT bool_and(split = 'tuning')", "tuning_case_count_below_twenty": "count(*) < 20"}))
def calibration_eligibility(spark, sf):
    cases = _cases(spark, sf)
    return corpus.reasons(cases, planning.eligibility("calibration", cases["split"], _SCRIPTS, _CATEGORIES), "corpus")


@query("plan_composition", _oracle(_COMPOSITION))
def plan_composition(spark, sf):
    return corpus.reasons(_cases(spark, sf), planning.composition(_SCRIPTS, _CATEGORIES, _CONDITIONS, _SCENARIOS, _LAYOUTS, _NEW), "corpus")
