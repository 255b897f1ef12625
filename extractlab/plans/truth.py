"""Ground truth: its rules, and the structure of lists against it."""

from __future__ import annotations

from pyspark.sql import functions as F

from extractlab.operators import contracts, structure, truth
from extractlab.plans.registry import query
from extractlab.sources.adapters import adapter, table

# Actual rows of one list of a job: a third of the lists match row by row, others have gaps, some are empty.
_ROWS = """(SELECT job, pos, (job + pos) % 5 > 1 AS accepted, CAST(CASE WHEN job % 3 = 0 THEN pos - 1 WHEN (job * 3 + pos) % 4 < 2 THEN NULL ELSE pos - 1 + floor(pos / 3.0) END AS INT) AS matched FROM {list_rows} r WHERE job % 11 <> 0)"""
_LISTS = """(SELECT job, CASE WHEN job % 2 = 0 THEN 'complete' ELSE 'partial' END AS status, job % 17 <> 0 AS context, job % 13 <> 0 AS wanted, CASE WHEN job % 5 = 0 THEN 'partial' ELSE 'complete' END AS expected_status,
    CAST(CASE WHEN job % 11 = 0 THEN 0 WHEN job % 3 = 0 THEN count(*) ELSE 10 END AS INT) AS expected_rows FROM {list_rows} r GROUP BY job)"""


@query("list_structure", f"""WITH r AS (SELECT * FROM {_ROWS} r), l AS (SELECT * FROM {_LISTS} l),
    p AS (SELECT r.job, r.pos, max(y.pos) AS at, coalesce(max(y.matched), -1) AS matched FROM r LEFT JOIN r y ON y.job = r.job AND y.pos < r.pos AND y.matched IS NOT NULL GROUP BY 1, 2),
    k AS (SELECT r.job, r.pos, p.matched + count(*) AS ix FROM r JOIN p ON p.job = r.job AND p.pos = r.pos JOIN r x ON x.job = r.job AND x.pos <= r.pos AND x.pos > coalesce(p.at, 0) AND x.matched IS NULL AND NOT x.accepted
      WHERE r.matched IS NULL AND NOT r.accepted GROUP BY r.job, r.pos, p.matched),
    b AS (SELECT k.job, sum(CASE WHEN pos % 2 = 1 AND ix % 2 = 0 THEN 2 ELSE 1 END) AS claims FROM k JOIN l ON l.job = k.job WHERE ix < expected_rows AND NOT EXISTS (SELECT 1 FROM r z WHERE z.job = k.job AND z.pos > k.pos AND z.matched <= k.ix)
      AND (ix % 3 = 0 OR ix % 2 = pos % 2) GROUP BY k.job),
    g AS (SELECT job, count(*) AS n, count(*) FILTER (WHERE matched IS NULL) AS extra, count(*) FILTER (WHERE matched IS NULL AND accepted) AS taken FROM r GROUP BY job)
    SELECT l.job AS case_id, CAST(NOT wanted OR coalesce(taken, 0) > 0 OR (status = 'complete' AND NOT (coalesce(extra, 0) = 0 AND coalesce(n, 0) = expected_rows AND expected_status = 'complete')) AS BIGINT) AS list_structure_errors,
      CAST(wanted AND expected_rows = 0 AND expected_status = 'complete' AND status = 'complete' AND coalesce(n, 0) = 0 AND context AS BIGINT) AS confirmed_empty_lists, CASE WHEN context AND wanted THEN coalesce(claims, 0) ELSE 0 END AS false_missing_values
    FROM l LEFT JOIN g ON g.job = l.job LEFT JOIN b ON b.job = l.job""")
def list_structure(spark, sf):
    def read(sql):
        return spark.sql(f"SELECT job AS case_id, 'rows' AS list_id, x.* FROM {sql.replace('{list_rows}', '{rows}')} x", rows=adapter(spark, sf, "list_rows"))

    rows = read(_ROWS).selectExpr("*", "array(1 + pos % 2) AS pages", "CASE WHEN pos % 2 = 1 THEN array('a', 'b') ELSE array('a') END AS absent")
    lists = read(_LISTS)
    expected = lists.where("expected_rows > 0").select("case_id", "list_id", F.explode(F.expr("sequence(0, expected_rows - 1)")).alias("ix"))
    expected = expected.selectExpr("*", "CASE WHEN ix % 3 = 0 THEN array(1, 2) ELSE array(1 + ix % 2) END AS pages", "CASE WHEN ix % 2 = 0 THEN array('a', 'b') ELSE array('a') END AS present")
    return structure.structure(lists, rows, expected)


def _counted(rows, rules):
    return contracts.violations(rows, rules).groupBy("rule").agg(F.count("*").alias("n"))


def _oracle(table_sql: str, rules: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{r}' AS rule, count(*) AS n FROM ({table_sql}) t WHERE {c} HAVING count(*) > 0" for r, c in rules.items())


_VALUES = """SELECT job, batch, status, mille, CASE WHEN mille % 3 = 0 THEN NULL ELSE mille % 3 = 1 END AS present, raw AS value, mille % 5 AS k FROM {readings} r"""


@query("truth_value_rules", _oracle(_VALUES, {
    "invalid_page": "k IN (1, 2)", "extracted_needs_value_presence_page": "status = 'extracted' AND (value IS NULL OR present IS NOT TRUE OR k = 0)", "value_forbidden": "status <> 'extracted' AND (value IS NOT NULL OR mille % 4 <> 0)",
    "missing_needs_absence": "status = 'missing' AND present IS NOT FALSE", "absence_needs_missing": "present IS FALSE AND status <> 'missing'", "redundant_allowed_value": "mille % 4 = 1 OR (mille % 4 = 2 AND value = 'N')",
    "readable_present_needs_value": "job % 2 = 0 AND present IS TRUE AND status <> 'extracted'",
}))
def truth_value_rules(spark, sf):
    rows = adapter(spark, sf, "readings").selectExpr(
        "*", "CASE WHEN mille % 3 = 0 THEN NULL ELSE mille % 3 = 1 END AS present", "CASE mille % 5 WHEN 0 THEN array() WHEN 1 THEN array(0, 1) WHEN 2 THEN array(2, 2) ELSE array(1, 2) END AS pages",
        "CASE mille % 4 WHEN 0 THEN array() WHEN 1 THEN array('Q', 'Q') WHEN 2 THEN array('N', 'Q') ELSE array('Q') END AS allowed",
    )
    return _counted(rows, truth.value_rules(F.col("status"), F.col("present"), F.col("raw"), F.col("allowed"), F.col("pages").cast("array<int>"), F.col("job") % 2 == 0))


@query("truth_row_rules", _oracle("SELECT p_partkey AS k, p_size % 4 AS s FROM part", {
    "row_without_pages": "k % 6 = 0", "row_without_cells": "s = 0", "cell_repeated": "s = 1", "invalid_row_page": "k % 6 IN (1, 2)", "cell_page_outside_row": "s = 3 AND k % 6 IN (0, 3)",
}))
def truth_row_rules(spark, sf):
    rows = table(spark, sf, "part").selectExpr(
        "CASE p_partkey % 6 WHEN 0 THEN array() WHEN 1 THEN array(0, 2) WHEN 2 THEN array(2, 2) WHEN 3 THEN array(1) ELSE array(1, 2) END AS pages",
        "CASE p_size % 4 WHEN 0 THEN array() WHEN 1 THEN array('a', 'a') ELSE array('a', 'b') END AS fields", "CASE WHEN p_size % 4 = 3 THEN array(array(2), array()) ELSE array() END AS cell_pages",
    )
    return _counted(rows, truth.row_rules(F.col("pages").cast("array<int>"), F.col("fields").cast("array<string>"), F.col("cell_pages").cast("array<array<int>>")))


_TRUE_LISTS = """SELECT doc_id AS d, CASE doc_id % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'partial' ELSE 'unresolved' END AS status, doc_id % 5 <> 0 AS enumerated, CASE WHEN doc_id % 4 = 0 THEN 'invalid' END AS reason, doc_id % 7 < 4 AS got, doc_id % 11 < 8 AS resolved FROM documents"""


@query("truth_list_rules", _oracle(_TRUE_LISTS, {
    "row_repeated": "d % 13 = 0", "complete_needs_enumeration_resolution": "status = 'complete' AND NOT (enumerated AND resolved)", "partial_needs_read_and_unresolved": "status = 'partial' AND (NOT got OR enumerated AND resolved)",
    "unresolved_needs_reason_and_nothing_read": "status = 'unresolved' AND (got OR reason IS NULL)", "reason_needs_unresolved": "status <> 'unresolved' AND reason IS NOT NULL",
}))
def truth_list_rules(spark, sf):
    rows = spark.sql(_TRUE_LISTS.replace("FROM documents", "FROM {documents}"), documents=table(spark, sf, "documents"))
    keys = F.when(F.col("d") % 13 == 0, F.array(F.lit("r1"), F.lit("r1"))).otherwise(F.array(F.lit("r1"), F.lit("r2")))
    return _counted(rows, truth.list_rules(*(F.col(c) for c in ("status", "enumerated", "reason", "got", "resolved")), keys))


_OUTCOMES = """SELECT CASE WHEN doc_id % 3 = 0 THEN 'uncertain' ELSE 'matched' END AS matching, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'p' END AS profile,
    CASE doc_id % 4 WHEN 0 THEN 'complete' WHEN 1 THEN 'partial' WHEN 2 THEN 'failed' ELSE 'refused' END AS outcome, doc_id % 7 < 4 AS accepted, doc_id % 11 < 8 AS resolved, doc_id % 13 < 9 AS anything FROM documents"""


@query("truth_outcome_rules", _oracle(_OUTCOMES, {
    "matched_needs_profile": "matching = 'matched' AND coalesce(profile, '') = ''", "matched_refused": "matching = 'matched' AND outcome = 'refused'",
    "outcome_inconsistent": "matching = 'matched' AND ((outcome = 'complete' AND NOT (accepted AND resolved)) OR (outcome = 'partial' AND (NOT accepted OR resolved)) OR (outcome = 'failed' AND accepted))",
    "refusal_with_extraction": "matching <> 'matched' AND NOT (profile IS NULL AND outcome = 'refused' AND NOT anything)",
}))
def truth_outcome_rules(spark, sf):
    rows = spark.sql(_OUTCOMES.replace("FROM documents", "FROM {documents}"), documents=table(spark, sf, "documents"))
    return _counted(rows, truth.outcome_rules(*(F.col(c) for c in ("matching", "profile", "outcome", "accepted", "resolved", "anything"))))


_ARTIFACTS = """SELECT CASE page_id % 3 WHEN 0 THEN 'photo' WHEN 1 THEN 'pdf' ELSE 'original' END AS kind, CASE page_id % 4 WHEN 0 THEN 'ABC' WHEN 1 THEN NULL ELSE sha256(url) END AS sha, page_id % 5 = 0 AS simulated, page_id % 7 = 0 AS verified FROM pages"""


@query("artifact_rules", _oracle(_ARTIFACTS, {
    "invalid_sha256": "length(coalesce(sha, '')) <> 64", "simulation_needs_photo": "simulated AND kind <> 'photo'", "delivery_needs_real_photo": "verified AND NOT (kind = 'photo' AND NOT simulated)",
}))
def artifact_rules(spark, sf):
    rows = spark.sql(_ARTIFACTS.replace("sha256(url)", "sha2(url, 256)").replace("FROM pages", "FROM {pages}"), pages=table(spark, sf, "pages"))
    return _counted(rows, truth.artifact_rules(*(F.col(c) for c in ("kind", "sha", "simulated", "verified"))))


_PENDING = """SELECT CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'chat' ELSE 'camera' END AS source, CASE WHEN event_id % 5 < 2 THEN 'difficult' ELSE 'readable' END AS quality, CASE event_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'image_file' ELSE 'photo' END AS delivery,
    CASE WHEN event_id % 7 < 3 THEN 'crumpled' END AS condition, CASE WHEN event_id % 11 < 5 THEN 'hd' END AS sent, CASE WHEN event_id % 13 < 6 THEN 1 END AS printed, event_id % 17 < 12 AS alone FROM events"""


@query("pending_rules", _oracle(_PENDING, {
    "chat_quality_exactly_for_chat": "(source = 'chat' AND sent IS NULL) OR (source = 'camera' AND sent IS NOT NULL)", "difficult_needs_capture": "quality = 'difficult' AND NOT (source IS NOT NULL AND condition IS NOT NULL AND printed IS NOT NULL)",
    "readable_photo_needs_chat": "quality = 'readable' AND delivery = 'photo' AND NOT (source IS NOT DISTINCT FROM 'chat' AND condition IS NULL)", "unexpected_pending": "quality = 'readable' AND delivery <> 'photo' AND source IS NOT NULL",
    "camera_only_for_difficult": "source = 'camera' AND quality <> 'difficult'", "pending_must_be_only_input": "(source = 'chat' AND NOT (delivery = 'photo' AND alone)) OR (source = 'camera' AND NOT (delivery = 'image_file' AND alone))",
    "only_difficult_is_printed": "quality <> 'difficult' AND printed IS NOT NULL",
}))
def pending_rules(spark, sf):
    rows = spark.sql(_PENDING.replace("FROM events", "FROM {events}"), events=table(spark, sf, "events"))
    inputs = F.when(F.col("alone"), F.array(F.lit("capture"))).otherwise(F.array(F.lit("capture"), F.lit("other")))
    return _counted(rows, truth.pending_rules(*(F.col(c) for c in ("source", "quality", "delivery", "condition", "sent", "printed")), inputs, F.lit("capture")))
