"""Replays of whole traces over the calibration grid. The SQL walks through each job's steps one by one."""

from __future__ import annotations

from pyspark.sql import functions as F

from extractlab.operators import replay, verify
from extractlab.plans.recognition import _POINTS
from extractlab.plans.registry import query
from extractlab.sources.adapters import adapter

BUDGET = 3500
_LEADS = "(SELECT job, max(CASE WHEN ix = selected THEN mille END) - max(CASE WHEN ix <> selected THEN mille END) AS lead FROM {matching} m GROUP BY job)"
# Steps of a job in order (batch 0 is before, 1000 after all batches), their time, and what they end the job with.
_ENDS = f"""(WITH j AS (SELECT * FROM {{traces}} t), b AS (SELECT * FROM {{trace_batches}} t), v AS (SELECT unnest([false, true]) AS v2),
    skipped AS (SELECT job, sum(second_s) AS s, bool_or(second_error <> 'recognition_contract_violation') AS e FROM b WHERE attempted GROUP BY job),
    steps AS (SELECT job, v2, 0 AS batch, 0 AS k, setup AS s, NULL AS code FROM j CROSS JOIN v
      UNION ALL SELECT job, v2, 0, 1, 0, CASE WHEN manual THEN NULL WHEN matching IS NULL THEN 'trace_without_matching' WHEN matching <> 'matched' THEN 'unmatched' END FROM j CROSS JOIN v
      UNION ALL SELECT job, v2, batch, 0, first_s, CASE WHEN rejects THEN 'mixed' END FROM b CROSS JOIN v
      UNION ALL SELECT job, true, batch, 1, 0, 'trace_lacks_alternate_view' FROM b WHERE NOT attempted
      UNION ALL SELECT job, true, batch, 2, second_s, CASE WHEN second_error IS NOT NULL THEN second_error WHEN second_rejects THEN 'mixed' END FROM b WHERE attempted
      UNION ALL SELECT j.job, v2, 1000, 0, phase, CASE WHEN NOT v2 AND (coalesce(e, false) OR (coalesce(x.s, 0) > 0 AND failure IN ('processing_budget_exhausted', 'runtime_timeout', 'worker_timeout') AND elapsed > {BUDGET}))
          THEN 'trace_undetermined_for_policy' ELSE failure END FROM j CROSS JOIN v LEFT JOIN skipped x ON x.job = j.job WHERE failure IS NOT NULL
      UNION ALL SELECT j.job, v2, 1001, 0, 0, CASE WHEN n IS DISTINCT FROM j.pages THEN 'trace_incomplete_for_policy' ELSE 'complete' END FROM j CROSS JOIN v LEFT JOIN (SELECT job, sum(pages) AS n FROM b GROUP BY job) c ON c.job = j.job),
    timed AS (SELECT *, CASE WHEN sum(s) OVER (PARTITION BY job, v2 ORDER BY batch, k) > {BUDGET} THEN 'processing_budget_exhausted' ELSE code END AS ends FROM steps)
    SELECT t.job, t.v2, arg_min(ends, batch * 10 + k) FILTER (WHERE ends IS NOT NULL) AS ending, min(batch) FILTER (WHERE ends IS NOT NULL) > 0 AND NOT any_value(manual) AS gated, any_value(lead) AS lead, any_value(manual) AS manual
    FROM timed t JOIN j ON j.job = t.job LEFT JOIN {_LEADS} l ON l.job = t.job GROUP BY 1, 2)"""
_AT = f"""(SELECT p.index, e.job, manual, CASE WHEN gated AND NOT (lead > 0 AND lead > p.margin) THEN 'uncertain' WHEN ending IN ('complete', 'unmatched', 'mixed') THEN ending WHEN ending LIKE 'trace!_%' ESCAPE '!' THEN 'unreplayable'
    WHEN ending IN ('processing_budget_exhausted', 'runtime_timeout') THEN 'timeout' WHEN ending = 'damaged_input' THEN 'input_refused' ELSE 'failed' END AS state FROM {_POINTS} p JOIN {_ENDS} e ON e.v2 = p.v2)"""
_STATES = ", ".join(f"count(*) FILTER (WHERE state = '{s}') AS {s}" for s in replay.STATES)
_GRID = f"""(WITH a AS (SELECT * FROM {_AT} a), s AS (SELECT index, {_STATES}, count(*) FILTER (WHERE state = 'complete' AND NOT manual) AS profiles, count(*) FILTER (WHERE state = 'complete' AND NOT manual AND job % 97 = 0) AS wrong_profiles FROM a GROUP BY index),
    x AS (SELECT a.index, count(*) AS accepted, count(*) FILTER (WHERE raw <> 'N') AS wrong FROM a JOIN {_POINTS} q ON q.index = a.index JOIN {{readings}} r ON r.job = a.job
      WHERE state = 'complete' AND status = 'extracted' AND raw IN ('A', 'N') AND (q.v1 IS NULL OR mille >= q.v1) AND (NOT q.v2 OR alternate = raw) GROUP BY a.index)
    SELECT p.index, p.v2, p.v1, p.margin, {", ".join(f"s.{c}" for c in replay.STATES)}, profiles, wrong_profiles, coalesce(accepted, 0) AS accepted, coalesce(wrong, 0) AS wrong,
      CASE WHEN coalesce(wrong, 0) = 0 AND accepted > 0 THEN round(1 - pow(0.05, 1.0 / accepted), 9) END AS bound FROM {_POINTS} p JOIN s ON s.index = p.index LEFT JOIN x ON x.index = p.index)"""


def _ends(spark, sf):
    jobs = adapter(spark, sf, "traces").join(verify.leads(adapter(spark, sf, "matching")).select("job", "lead"), "job", "left")
    return replay.endings(jobs, adapter(spark, sf, "trace_batches"), BUDGET)


@query("trace_endings", f'SELECT a.job, a.ending AS "off", b.ending AS "on" FROM {_ENDS} a JOIN {_ENDS} b ON a.job = b.job AND NOT a.v2 AND b.v2')
def trace_endings(spark, sf):
    return _ends(spark, sf).select("job", "off", "on")


@query("replay_grid", f"SELECT * FROM {_GRID} g")
def replay_grid(spark, sf):
    values = adapter(spark, sf, "readings").where("status = 'extracted' AND raw IN ('A', 'N')").select(
        "job", "mille", (F.col("alternate") == F.col("raw")).alias("confirmed"), (F.col("raw") == "N").alias("correct")
    )
    right = adapter(spark, sf, "traces").select("job", (F.col("job") % 97 != 0).alias("right"))
    return replay.replay_grid(_ends(spark, sf), right, values, spark)
