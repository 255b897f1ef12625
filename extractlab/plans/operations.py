"""Scoring, corpus governance, timing, event flows and the store over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from extractlab.operators import corpus, flow, store, timing
from extractlab.plans.registry import query
from extractlab.sources.adapters import adapter, table

_COUNTS = """(SELECT case_id, script, category, quality, delivery_path, CAST(1 AS BIGINT) AS cases, CAST(d AND status = 'extracted' AS BIGINT) AS accepted, CAST(ok AS BIGINT) AS correct,
      CAST(d AND status = 'extracted' AND NOT ok AS BIGINT) AS incorrect, CAST(d AND status = 'missing' AND truth_status = 'extracted' AS BIGINT) AS false_missing, CAST(p AS BIGINT) AS readable_present,
      CAST(ok AND p AS BIGINT) AS recovered, CAST(NOT d AS BIGINT) AS not_completed FROM (SELECT *, execution_state = 'completed' AS d, truth_status = 'extracted' AND quality = 'readable' AS p,
        execution_state = 'completed' AND status = 'extracted' AND truth_status = 'extracted' AND value = truth_value AS ok FROM {cases} c) x)"""
_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in corpus.COUNTERS)
_RATES = "round(sum(incorrect) / nullif(sum(accepted), 0), 9) AS error_rate, round(sum(recovered) / nullif(sum(readable_present), 0), 9) AS completeness"


@query("score_counts", f"SELECT * FROM {_COUNTS} c")
def score_counts(spark, sf):
    return corpus.case_counts(adapter(spark, sf, "cases"))


@query("score_groups", " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, {label} AS label, {_SUMS}, {_RATES} FROM {_COUNTS} c GROUP BY 1, 2" for d, label in [("total", "'all'"), *((d, d) for d in corpus.DIMENSIONS)]))
def score_groups(spark, sf):
    return corpus.score_groups(corpus.case_counts(adapter(spark, sf, "cases")))


@query("denominators", """SELECT count(*) AS cases, count(*) FILTER (WHERE quality = 'readable') AS readable, count(*) FILTER (WHERE quality = 'readable' AND truth_status = 'extracted') AS present,
    count(*) FILTER (WHERE truth_status = 'extracted') AS known, count(*) FILTER (WHERE execution_state = 'completed') AS completed FROM {cases} c""")
def denominators(spark, sf):
    q, t = F.col("quality") == "readable", F.col("truth_status") == "extracted"
    return adapter(spark, sf, "cases").agg(
        F.count("*").alias("cases"), F.count_if(q).alias("readable"), F.count_if(q & t).alias("present"), F.count_if(t).alias("known"), F.count_if(F.col("execution_state") == "completed").alias("completed")
    )


@query("mismatches", """SELECT case_id, truth_value, CASE WHEN execution_state = 'completed' AND status = 'extracted' THEN value END AS actual FROM {cases} c
    WHERE truth_status = 'extracted' AND (CASE WHEN execution_state = 'completed' AND status = 'extracted' THEN value END) IS DISTINCT FROM truth_value""")
def mismatches(spark, sf):
    actual = F.when((F.col("execution_state") == "completed") & (F.col("status") == "extracted"), F.col("value"))
    rows = adapter(spark, sf, "cases").where("truth_status = 'extracted'").select("case_id", "truth_value", actual.alias("actual"))
    return rows.where(~F.col("truth_value").eqNullSafe(F.col("actual")))


@query("corpus_status", "SELECT quality, script, execution_state, count(*) AS n, min(case_id) AS first_case FROM {cases} c GROUP BY GROUPING SETS ((quality), (script), (execution_state))")
def corpus_status(spark, sf):
    by = ["quality", "script", "execution_state"]
    return adapter(spark, sf, "cases").groupingSets([[F.col(c)] for c in by], *(F.col(c) for c in by)).agg(F.count("*").alias("n"), F.min("case_id").alias("first_case"))


@query("split_contamination", """SELECT 'sha256' AS kind, sha256(text) AS value, count(*) AS members FROM {splits} s GROUP BY 2 HAVING bool_or(split = 'benchmark') AND bool_or(split <> 'benchmark')""")
def split_contamination(spark, sf):
    rows = adapter(spark, sf, "splits").select("split", F.lit("sha256").alias("kind"), F.sha2("text", 256).alias("value"))
    return corpus.contamination(rows)


@query("eligibility", """SELECT array_to_string(list_sort(list_filter([CASE WHEN count(*) < 20 THEN 'tuning_case_count_below_twenty' END, CASE WHEN count(DISTINCT script) < 5 OR count(DISTINCT quality) < 2 THEN 'diversity_incomplete' END,
    CASE WHEN bool_or(execution_state = 'timeout') THEN 'human_review_or_ground_truth_pending' END, CASE WHEN bool_or(delivery_path = 'fax') THEN 'wrong_split' END], lambda x: x IS NOT NULL)), ',') AS reasons FROM {cases} c""")
def eligibility(spark, sf):
    return corpus.reasons(adapter(spark, sf, "cases"), {
        "tuning_case_count_below_twenty": F.count("*") < 20, "diversity_incomplete": (F.count_distinct("script") < 5) | (F.count_distinct("quality") < 2),
        "human_review_or_ground_truth_pending": F.bool_or(F.col("execution_state") == "timeout"), "wrong_split": F.bool_or(F.col("delivery_path") == "fax"),
    })


@query("composition", """SELECT array_to_string(list_sort(list_filter([CASE WHEN count(*) FILTER (WHERE quality = 'readable') <> 40 OR count(*) FILTER (WHERE quality = 'difficult') <> 20 THEN 'quality_composition' END,
    CASE WHEN count(DISTINCT CASE WHEN quality = 'readable' THEN script END) < 4 THEN 'readable_script_coverage' END, CASE WHEN count(DISTINCT CASE WHEN quality = 'difficult' THEN category END) < 6 THEN 'difficult_category_coverage' END,
    CASE WHEN count(*) FILTER (WHERE quality = 'readable' AND delivery_path = 'photo') <> 8 THEN 'readable_delivery_split' END], lambda x: x IS NOT NULL)), ',') AS reasons FROM {cases} c""")
def composition(spark, sf):
    readable, difficult = F.col("quality") == "readable", F.col("quality") == "difficult"
    return corpus.reasons(adapter(spark, sf, "cases"), {
        "quality_composition": (F.count_if(readable) != 40) | (F.count_if(difficult) != 20), "readable_script_coverage": F.count_distinct(F.when(readable, F.col("script"))) < 4,
        "difficult_category_coverage": F.count_distinct(F.when(difficult, F.col("category"))) < 6, "readable_delivery_split": F.count_if(readable & (F.col("delivery_path") == "photo")) != 8,
    })


@query("inbox_diff", """SELECT 'missing' AS problem, doc_id FROM documents WHERE doc_id % 3 <> 0 AND doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL
    SELECT 'unexpected', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)""")
def inbox_diff(spark, sf):
    wanted = table(spark, sf, "documents").where("doc_id % 3 <> 0").select("doc_id").distinct()
    return corpus.inventory_difference(wanted, table(spark, sf, "labels").select("doc_id").distinct(), "doc_id")


@query("duplicate_capture", "SELECT doc_id, first FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first FROM documents) d WHERE doc_id <> first")
def duplicate_capture(spark, sf):
    return corpus.duplicates(table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha")), "sha", "doc_id")


# Every event is an entry of the ledger; few runs complete, and most of those that start are acknowledged.
_LEDGER = "SELECT user_id AS config, event_id % 5 AS run, CASE WHEN event_type = 'signup' AND event_id % 97 = 0 THEN 'completed' WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'acknowledged' ELSE 'started' END AS event FROM events"


@query("ledger_state", f"""SELECT config, CASE WHEN bool_or(c) THEN 'refused' WHEN count(*) FILTER (WHERE s AND NOT c AND NOT a) > 0 THEN 'pending' ELSE 'open' END AS state,
    count(*) FILTER (WHERE s AND NOT c AND NOT a) AS pending, count(*) AS runs FROM (SELECT config, run, bool_or(event = 'started') AS s, bool_or(event = 'completed') AS c, bool_or(event = 'acknowledged') AS a
      FROM ({_LEDGER}) l GROUP BY 1, 2) r GROUP BY config""")
def ledger_state(spark, sf):
    return corpus.ledger_state(spark.sql(_LEDGER.replace("FROM events", "FROM {events}"), events=table(spark, sf, "events")))


@query("review_apply", """SELECT truth_status, quality, count(*) AS n FROM (SELECT quality, CASE WHEN truth_status = 'extracted' AND case_id % 4 = 1 AND case_id % 2 = 1 THEN 'unreadable' ELSE truth_status END AS truth_status
    FROM {cases} c WHERE NOT (case_id % 2 = 1 AND case_id % 9 = 0)) r GROUP BY 1, 2""")
def review_apply(spark, sf):
    cases = adapter(spark, sf, "cases")
    decisions = cases.where("case_id % 2 = 1").selectExpr("case_id", "CASE WHEN case_id % 9 = 0 THEN 'reject' ELSE 'accept' END AS decision", "case_id % 4 <> 1 AS legible")
    return corpus.reviewed(cases, decisions).groupBy("truth_status", "quality").agg(F.count("*").alias("n"))


@query("case_digest", """SELECT category, sha256(string_agg(b || ':' || d, chr(10) ORDER BY b)) AS digest FROM (SELECT category, h[1:3] AS b, sha256(string_agg(h, chr(10) ORDER BY h)) AS d
    FROM (SELECT category, sha256(CAST(case_id AS VARCHAR) || ':' || quality) AS h FROM {cases} c) i GROUP BY 1, 2) g GROUP BY category""")
def case_digest(spark, sf):
    return corpus.set_digest(adapter(spark, sf, "cases"), ["category"], F.concat(F.col("case_id").cast("string"), F.lit(":"), F.col("quality")))


@query("artifact_hash", "SELECT page_id, sha256(html) AS sha256, octet_length(encode(html)) AS bytes FROM pages")
def artifact_hash(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha2("html", 256).alias("sha256"), F.octet_length("html").cast("long").alias("bytes"))


@query("distractors", """SELECT i.id, s.step, d.distractor FROM (SELECT p_partkey AS id, p_partkey % 8 AS position FROM part) i CROSS JOIN (SELECT 1 AS step UNION ALL SELECT 2) s
    JOIN (SELECT p_partkey % 8 AS position, min(p_partkey) AS distractor FROM part GROUP BY 1) d ON (i.position + s.step) % 8 = d.position""")
def distractors(spark, sf):
    return corpus.distractors(table(spark, sf, "part").selectExpr("p_partkey AS id", "p_partkey % 8 AS position"), 8, (1, 2))


@query("page_time_percentiles", "SELECT kind, count(centis) AS n, round(quantile_cont(centis, 0.05), 6) AS p5, round(quantile_cont(centis, 0.5), 6) AS p50, round(quantile_cont(centis, 0.95), 6) AS p95 FROM {calls} c GROUP BY kind")
def page_time_percentiles(spark, sf):
    return timing.percentiles(adapter(spark, sf, "calls"), ["kind"], "centis")


@query("case_timing", "SELECT case_id, page, round(sum(centis / pages), 4) AS centis FROM (SELECT *, unnest(range(1, pages + 1)) AS page FROM {calls} c WHERE kind <> 'token_count') p GROUP BY 1, 2")
def case_timing(spark, sf):
    return timing.page_seconds(adapter(spark, sf, "calls")).withColumn("page", F.col("page").cast("long"))


@query("call_seconds", "SELECT case_id, " + ", ".join(f"CAST(sum(CASE WHEN kind = '{k}' THEN centis ELSE 0 END) AS BIGINT) AS {k}" for k in ("extraction", "alternate", "matching", "token_count")) + ", count(*) FILTER (WHERE kind <> 'token_count') AS model_calls FROM {calls} c GROUP BY 1")
def call_seconds(spark, sf):
    return timing.seconds_by_kind(adapter(spark, sf, "calls"))


@query("budget_timeout", "SELECT case_id, min(call_id) AS call_id, arg_min(spent, call_id) AS spent FROM (SELECT *, CAST(sum(centis) OVER (PARTITION BY case_id ORDER BY call_id) AS BIGINT) AS spent FROM {calls} c) s WHERE spent > 100000 GROUP BY 1")
def budget_timeout(spark, sf):
    return timing.over_budget(adapter(spark, sf, "calls"), 100_000)


@query("timing_summary", """SELECT category, count(*) AS count, round(quantile_cont(wall, 0.5), 6) AS p50, round(quantile_cont(wall, 0.95), 6) AS p95, max(CASE WHEN n = 1 THEN wall END) AS first_case,
    round(quantile_cont(CASE WHEN n > 1 THEN wall END, 0.5), 6) AS later_p50, count(CASE WHEN n > 1 THEN 1 END) AS later_count
    FROM (SELECT category, wall, row_number() OVER (PARTITION BY category ORDER BY case_id) AS n FROM (SELECT category, case_id, case_id * 7919 % 9973 AS wall FROM {cases} c) r) s GROUP BY 1""")
def timing_summary(spark, sf):
    runs = adapter(spark, sf, "cases").selectExpr("category", "case_id", "case_id * 7919 % 9973 AS wall")
    return timing.first_and_later(runs, ["category"], "case_id", "wall")


@query("exclude_wait", "SELECT case_id, CAST(sum(greatest(0, centis - 100 * (call_id % 50))) AS BIGINT) AS charged FROM {calls} c GROUP BY 1")
def exclude_wait(spark, sf):
    return adapter(spark, sf, "calls").groupBy("case_id").agg(F.sum(F.greatest(F.lit(0), F.col("centis") - 100 * (F.col("call_id") % 50))).alias("charged"))


@query("event_dedupe", "SELECT owner, message_id, min(event_id) AS event_id, count(*) AS seen FROM {updates} u GROUP BY 1, 2")
def event_dedupe(spark, sf):
    return flow.first_of_each(adapter(spark, sf, "updates"), ["owner", "message_id"], "event_id")


@query("stale_updates", "SELECT owner, count(*) AS ignored, min(t) AS notice FROM {updates} u WHERE t < 1705000000 + owner * 1000 GROUP BY 1")
def stale_updates(spark, sf):
    return flow.stale(adapter(spark, sf, "updates"), "owner", "t", 1_705_000_000 + F.col("owner") * 1000)


@query("generation_fence", "SELECT kind, count(*) AS n FROM {updates} u WHERE generation = current_generation GROUP BY 1")
def generation_fence(spark, sf):
    return flow.current(adapter(spark, sf, "updates"), "generation", "current_generation").groupBy("kind").agg(F.count("*").alias("n"))


_SESSIONS = """SELECT {keys}, CAST(session AS BIGINT) AS session, min(t) AS start, max(t) AS "end", count(*) AS events FROM (SELECT *, sum(CASE WHEN g IS NULL OR g >= {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS session
    FROM (SELECT *, t - lag(t) OVER (PARTITION BY {keys} ORDER BY t, event_id) AS g FROM {{updates}} u {where}) a) b GROUP BY {keys}, session"""


@query("inactivity_sessions", _SESSIONS.format(keys="owner", gap=flow.INACTIVITY, where=""))
def inactivity_sessions(spark, sf):
    return flow.sessions(adapter(spark, sf, "updates"), "owner", "t", "event_id", flow.INACTIVITY)


@query("album_quiet", _SESSIONS.format(keys="owner, kind", gap=flow.ALBUM_QUIET, where="WHERE kind IN ('click', 'purchase')"))
def album_quiet(spark, sf):
    return flow.sessions(adapter(spark, sf, "updates").where("kind IN ('click', 'purchase')"), ["owner", "kind"], "t", "event_id", flow.ALBUM_QUIET)


@query("album_reorder", """SELECT p.owner, p.place, p.album, m.message_id FROM (SELECT owner, message_id % 4 AS album, event_id AS place, row_number() OVER (PARTITION BY owner, message_id % 4 ORDER BY event_id) AS n FROM {updates} u) p
    JOIN (SELECT owner, message_id % 4 AS album, message_id, row_number() OVER (PARTITION BY owner, message_id % 4 ORDER BY message_id, event_id) AS n FROM {updates} u) m ON p.owner = m.owner AND p.album = m.album AND p.n = m.n""")
def album_reorder(spark, sf):
    return flow.album_order(adapter(spark, sf, "updates").withColumn("album", F.col("message_id") % 4), "owner", "album", "event_id", "message_id")


@query("remembered_album", "SELECT DISTINCT u.owner, u.generation, u.event_id FROM {updates} u JOIN {updates} c ON c.kind = 'signup' AND u.kind = 'purchase' AND u.owner = c.owner AND u.generation = c.generation AND u.t > c.t AND u.t < c.t + 900")
def remembered_album(spark, sf):
    rows = adapter(spark, sf, "updates")
    return flow.remembered(rows.where("kind = 'purchase'"), rows.where("kind = 'signup'"), ["owner", "generation"], flow.INACTIVITY)


@query("ring_schedule", "SELECT owner, generation, event_id, row_number() OVER (PARTITION BY owner ORDER BY event_id) AS round FROM {updates} u WHERE kind = 'click'")
def ring_schedule(spark, sf):
    return flow.ring(adapter(spark, sf, "updates").where("kind = 'click'"), "owner", "generation", "event_id")


@query("health_transitions", "SELECT owner, event_id, ok FROM (SELECT owner, event_id, kind <> 'error' AS ok, coalesce(lag(kind <> 'error') OVER (PARTITION BY owner ORDER BY event_id), true) AS b FROM {updates} u) t WHERE ok <> b")
def health_transitions(spark, sf):
    return flow.transitions(adapter(spark, sf, "updates").withColumn("ok", F.col("kind") != "error"), "owner", "event_id", "ok")


@query("quota_running", "SELECT case_id, min(call_id) AS call_id, min(total) AS total FROM (SELECT *, CAST(sum(centis) OVER (PARTITION BY case_id ORDER BY call_id) AS BIGINT) AS total FROM {calls} c) s WHERE total > 50000 GROUP BY 1")
def quota_running(spark, sf):
    return flow.running_quota(adapter(spark, sf, "calls"), "case_id", "call_id", "centis", 50_000)


@query("admission_cost", """SELECT submission, CAST(sum(pages * CASE kind WHEN 'extraction' THEN 11 WHEN 'alternate' THEN 10 ELSE 9 END) + 30 AS BIGINT) AS cost, sum(pages * CASE kind WHEN 'extraction' THEN 11 WHEN 'alternate' THEN 10 ELSE 9 END) + 30 <= 60 AS admitted
    FROM (SELECT call_id // 7 AS submission, kind, CAST(pages AS BIGINT) AS pages FROM {calls} c WHERE kind <> 'token_count') f GROUP BY 1""")
def admission_cost(spark, sf):
    files = adapter(spark, sf, "calls").where("kind <> 'token_count'").selectExpr("call_id div 7 AS submission", "kind", "pages")
    times = spark.createDataFrame([("extraction", 11), ("alternate", 10), ("matching", 9)], "kind string, cost int")
    return flow.admitted(files, times, 60, 30)


@query("profile_list", "SELECT id, name, version FROM {profiles} p WHERE owner = 7")
def profile_list(spark, sf):
    return store.owned(adapter(spark, sf, "profiles"), 7).select("id", "name", "version")


@query("profile_cas", "SELECT r.id, r.owner, r.expected, CASE WHEN p.id IS NULL THEN 'not_found' WHEN p.version = r.expected THEN 'applied' ELSE 'conflict' END AS result FROM {requests} r LEFT JOIN {profiles} p ON p.id = r.id AND p.owner = r.owner")
def profile_cas(spark, sf):
    return store.outcomes(adapter(spark, sf, "profiles"), adapter(spark, sf, "requests"))


@query("profile_update", "SELECT p.id, p.owner, p.name, p.created, p.version + CASE WHEN EXISTS (SELECT 1 FROM {requests} r WHERE r.id = p.id AND r.owner = p.owner AND r.expected = p.version) THEN 1 ELSE 0 END AS version FROM {profiles} p")
def profile_update(spark, sf):
    return store.updated(adapter(spark, sf, "profiles"), adapter(spark, sf, "requests"))


@query("profile_delete", "SELECT p.* FROM {profiles} p WHERE NOT EXISTS (SELECT 1 FROM {requests} r WHERE r.id = p.id AND r.owner = p.owner AND r.expected = p.version)")
def profile_delete(spark, sf):
    return store.deleted(adapter(spark, sf, "profiles"), adapter(spark, sf, "requests"))


_DRAFTS = "SELECT id + CASE WHEN id % 3 = 0 THEN 1000000 ELSE 0 END AS id, id % 1000 AS batch, owner, CASE WHEN id % 7 = 0 THEN 'changed' ELSE name END AS name FROM {profiles} p"


@query("draft_save", f"""SELECT batch, CASE WHEN NOT bool_or(p.id IS NOT NULL) THEN 'inserted' WHEN bool_and(p.id IS NOT NULL AND p.name = d.name AND p.owner = d.owner) THEN 'unchanged' ELSE 'conflict' END AS result, count(*) AS drafts
    FROM ({_DRAFTS}) d LEFT JOIN {{profiles}} p ON p.id = d.id GROUP BY batch""")
def draft_save(spark, sf):
    profiles = adapter(spark, sf, "profiles")
    return store.saved(profiles, spark.sql(_DRAFTS, profiles=profiles))
