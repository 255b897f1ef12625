"""The smaller rules over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from extractlab.functions import scalar as fn
from extractlab.operators import contracts, rules
from extractlab.plans.registry import query
from extractlab.sources.adapters import adapter, table


def _broken(rows, checks):
    return contracts.violations(rows, checks).groupBy("rule").agg(F.count("*").alias("n"))


def _sql_rules(checks: dict[str, str], source: str) -> str:
    """SQL that counts the rows that break each rule."""
    return " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) AS n FROM {source} HAVING count(*) > 0" if c == "true" else f"SELECT '{k}' AS rule, count(*) AS n FROM {source} WHERE {c} HAVING count(*) > 0" for k, c in checks.items())


@query("recognition_violations", _sql_rules(
    {"outcome_disagrees": "outcome <> derived", "untraversed_claims": "NOT traversed AND (mf OR fl OR mc)"},
    "(SELECT *, CASE WHEN job % 3 = 0 THEN 'failed' WHEN job % 3 = 1 THEN 'complete' ELSE 'partial' END AS outcome, job % 4 <> 0 AS traversed, bool_or(status = 'missing') AS mf, job % 7 = 0 AS fl, job % 5 = 0 AS mc, "
    "CASE WHEN NOT bool_or(status = 'extracted') THEN 'failed' WHEN bool_and(status IN ('extracted', 'missing')) THEN 'complete' ELSE 'partial' END AS derived FROM (SELECT job, status FROM {readings} r) q GROUP BY job, status) s".replace("SELECT *, CASE WHEN job", "SELECT job, CASE WHEN job").replace("GROUP BY job, status", "GROUP BY job")))
def recognition_violations(spark, sf):
    s = F.col("status")
    rows = adapter(spark, sf, "readings").groupBy("job").agg(
        F.when(~F.bool_or(s == "extracted"), "failed").when(F.bool_and(s.isin("extracted", "missing")), "complete").otherwise("partial").alias("derived"), F.bool_or(s == "missing").alias("mf")
    ).withColumn("outcome", F.expr("CASE job % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'complete' ELSE 'partial' END"))
    return _broken(rows, rules.recognition_rules(F.col("outcome"), F.col("derived"), F.col("job") % 4 != 0, F.col("mf"), F.col("job") % 7 == 0, F.col("job") % 5 == 0))


_DECLARED = """(SELECT CASE p_partkey % 4 WHEN 0 THEN 'calendar_date' WHEN 1 THEN 'iso_code' WHEN 2 THEN 'luhn' ELSE 'iban' END AS kind,
    CASE WHEN p_size % 5 = 0 THEN ['%d/%m/%Y', '%d/%m/%Y'] WHEN p_size % 5 = 1 THEN ['%d.%m.%Y'] WHEN p_size % 5 = 2 THEN ['%d/%m'] ELSE [] END AS formats,
    CASE WHEN p_size % 3 = 0 THEN ['EUR', 'USD'] WHEN p_size % 7 = 0 THEN [' EUR'] WHEN p_size % 7 = 1 THEN ['EUR', 'EUR'] ELSE [] END AS codes FROM part)"""


@query("validator_violations", _sql_rules({
    "codes_required": "kind = 'iso_code' AND len(codes) = 0", "codes_forbidden": "kind <> 'iso_code' AND len(codes) > 0", "formats_forbidden": "kind <> 'calendar_date' AND len(formats) > 0",
    "formats_repeated": "len(list_distinct(formats)) < len(formats)", "formats_incomplete": "len(list_filter(formats, lambda f: list_sort(regexp_extract_all(f, '%.')) <> ['%Y', '%d', '%m'])) > 0",
    "codes_inexact": "len(list_filter(codes, lambda c: c = '' OR trim(c) <> c)) > 0", "codes_repeated": "len(list_distinct(codes)) < len(codes)"}, f"{_DECLARED} d"))
def validator_violations(spark, sf):
    sql = _DECLARED.replace("['%d/%m/%Y', '%d/%m/%Y']", "array('%d/%m/%Y', '%d/%m/%Y')").replace("['%d.%m.%Y']", "array('%d.%m.%Y')").replace("['%d/%m']", "array('%d/%m')")
    sql = sql.replace("['EUR', 'USD']", "array('EUR', 'USD')").replace("[' EUR']", "array(' EUR')").replace("['EUR', 'EUR']", "array('EUR', 'EUR')").replace("[]", "CAST(array() AS ARRAY<STRING>)").replace("FROM part", "FROM {part}")
    rows = spark.sql(f"SELECT * FROM {sql} d", part=table(spark, sf, "part"))
    return _broken(rows, rules.validator_rules(F.col("kind"), F.col("formats"), F.col("codes")))


_STAGE = "CASE WHEN call_id % 11 = 0 THEN 'matching' WHEN kind = 'token_count' THEN 'extraction' ELSE kind END AS stage, CASE WHEN call_id % 13 = 0 OR kind = 'matching' THEN NULL ELSE pages END AS batch"


@query("call_violations", _sql_rules({"call_stage_mismatch": "kind <> 'token_count' AND kind <> stage", "call_batch_mismatch": "(stage = 'matching') <> (batch IS NULL)"}, f"(SELECT kind, {_STAGE} FROM {{calls}} c) s"))
def call_violations(spark, sf):
    return _broken(adapter(spark, sf, "calls").selectExpr("kind", _STAGE.split(" AS stage, ")[0] + " AS stage", _STAGE.split(" AS stage, ")[1]), rules.call_rules(F.col("kind"), F.col("stage"), F.col("batch")))


@query("result_violations", _sql_rules({
    "not_requested": "l_orderkey % 50 = 0", "pages_unavailable": "l_linenumber > 6 AND l_orderkey % 3 <> 0", "pages_invalid": "l_suppkey % 17 = 0",
    "number_without_normal_form": "taken AND num AND raw = 'x1'", "normalization_unjustified": "taken AND norm IS NOT NULL AND norm IS DISTINCT FROM (CASE WHEN raw <> 'x1' THEN CAST(CAST(raw AS DECIMAL(20, 2)) AS BIGINT)::VARCHAR END)",
    "date_not_iso": "taken AND NOT num AND norm IS NOT NULL"},
    "(SELECT l_orderkey, l_linenumber, l_suppkey, l_orderkey % 9 <> 0 AS taken, l_linenumber % 2 = 0 AS num, CASE WHEN l_partkey % 23 = 0 THEN 'x1' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) || '.00' END AS raw, "
    "CASE WHEN l_partkey % 4 = 0 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR) WHEN l_partkey % 29 = 0 THEN '7.0' END AS norm FROM lineitem) s"))
def result_violations(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr(
        "IF(l_orderkey % 50 = 0, 'other', 'total') AS field", "IF(l_linenumber % 2 = 0, 'number', 'date') AS kind", "IF(l_orderkey % 9 <> 0, 'extracted', 'ambiguous') AS status",
        "CASE WHEN l_partkey % 23 = 0 THEN 'x1' ELSE CAST(CAST(l_quantity AS INT) AS STRING) || '.00' END AS raw", "CASE WHEN l_partkey % 4 = 0 THEN CAST(CAST(l_quantity AS INT) AS STRING) WHEN l_partkey % 29 = 0 THEN '7.0' END AS norm",
        "IF(l_suppkey % 17 = 0, array(l_linenumber, l_linenumber), array(l_linenumber)) AS pages", "IF(l_orderkey % 3 = 0, array(1, 2, 3, 4, 5, 6, 7), array(1, 2, 3, 4, 5, 6)) AS available",
    )
    return _broken(rows, rules.result_rules(F.col("field"), F.lit("total"), F.col("kind"), F.col("status"), F.col("raw"), F.col("norm"), fn.normal_number(F.col("raw")), F.col("pages"), F.col("available")))


@query("mixed_batches", "SELECT case_id, pages, bool_or(centis % 23 = 0) AS mixed FROM {calls} c GROUP BY 1, 2")
def mixed_batches(spark, sf):
    rows = adapter(spark, sf, "calls").selectExpr("case_id", "pages", "CASE WHEN centis % 23 = 0 THEN 'no' WHEN centis % 2 = 0 THEN 'yes' ELSE 'unclear' END AS membership")
    return rules.rejects(rows, ["case_id", "pages"])


@query("review_methods", "SELECT script, count(*) AS n, CASE WHEN script = 'en' THEN 'script_reading,glyph_sequence_comparison,published_transcription' ELSE 'script_reading,glyph_sequence_comparison' END AS methods FROM {cases} c GROUP BY script")
def review_methods(spark, sf):
    found = adapter(spark, sf, "cases").groupBy("script").agg(F.count("*").alias("n"))
    return found.withColumn("methods", F.array_join(rules.applicable_methods(F.when(F.col("script") == "en", "permitted_public").otherwise("synthetic")), ","))


@query("retirable_owners", """SELECT owner FROM (SELECT owner, max(t) AS last, (SELECT max(t) FROM {updates} v) AS now, bool_or(kind = 'purchase' AND event_id % 97 = 0) AS active FROM {updates} u GROUP BY owner) s
    WHERE owner % 3 <> 0 AND NOT active AND owner % 7 <> 0 AND now - last >= 3600 """)
def retirable_owners(spark, sf):
    events = adapter(spark, sf, "updates")
    now = events.agg(F.max("t").alias("now"))  # one row
    state = events.groupBy("owner").agg(F.max("t").alias("last"), F.bool_or((F.col("kind") == "purchase") & (F.col("event_id") % 97 == 0)).alias("active")).crossJoin(F.broadcast(now))
    off = F.lit(False)
    return state.where(rules.retirable(F.col("owner") % 3 == 0, off, F.col("active"), F.col("owner") % 7 == 0, F.lit(True), F.col("now"), F.col("last"))).select("owner")


@query("environment_mismatches", """SELECT p_partkey AS run, array_to_string(list_filter([CASE WHEN p_size % 5 = 0 THEN 'code_hash_mismatch' END, CASE WHEN p_size % 3 = 0 THEN 'prompt_mismatch' END,
    CASE WHEN p_partkey % 4 = 0 THEN 'core_settings_mismatch' END], lambda x: x IS NOT NULL), ',') AS codes FROM part""")
def environment_mismatches(spark, sf):
    same = {"code_sha256": F.col("p_size") % 5 != 0, "prompt": F.col("p_size") % 3 != 0, "core": F.col("p_partkey") % 4 != 0}
    return table(spark, sf, "part").select(F.col("p_partkey").alias("run"), F.array_join(rules.environment_mismatches(same), ",").alias("codes"))


@query("boundary_context", """SELECT job, batch, a, b FROM (SELECT job, (pos + 2) // 3 AS batch, a, b, continues_next, row_number() OVER (PARTITION BY job, (pos + 2) // 3 ORDER BY pos DESC) AS n FROM {list_rows} r) s WHERE n = 1 AND continues_next""")
def boundary_context(spark, sf):
    rows = adapter(spark, sf, "list_rows").withColumn("batch", F.expr("(pos + 2) div 3"))
    return rules.boundary_context(rows, ["job", "batch"], "pos", ["a", "b"])


@query("external_results", "SELECT job, batch, status, CASE WHEN status = 'extracted' THEN CASE WHEN mille % 3 = 0 THEN lower(raw) ELSE raw END END AS value FROM {readings} r")
def external_results(spark, sf):
    rows = adapter(spark, sf, "readings").withColumn("normalized", F.when(F.col("mille") % 3 == 0, F.lower("raw")))
    return rules.external(rows, ["job", "batch"])


_DECIDED = "SELECT job AS case_id, source_key AS field, pos AS row_key FROM {list_rows} r WHERE NOT (job % 8 = 0 AND pos = 2)"


@query("decision_problems", f"""WITH e AS (SELECT job AS case_id, source_key AS field, pos AS row_key FROM {{list_rows}} r WHERE NOT (job % 9 = 0 AND pos = 1)), g AS ({_DECIDED} UNION ALL {_DECIDED} AND job % 10 = 0 AND pos = 3),
    n AS (SELECT case_id, field, row_key, count(*) AS n FROM g GROUP BY ALL), p AS (SELECT coalesce(e.case_id, n.case_id) AS case_id, CASE WHEN n > 1 THEN 1 WHEN e.case_id IS NULL THEN 2 WHEN n IS NULL THEN 3 ELSE 4 END AS r
      FROM e FULL JOIN n ON e.case_id = n.case_id AND e.field = n.field AND e.row_key = n.row_key)
    SELECT case_id, ['review_decision_duplicate_value', 'review_decision_unknown_value', 'review_decisions_incomplete'][min(r)] AS problem FROM p GROUP BY case_id HAVING min(r) < 4""")
def decision_problems(spark, sf):
    rows = adapter(spark, sf, "list_rows").selectExpr("job AS case_id", "source_key AS field", "pos AS row_key")
    given = rows.where("NOT (case_id % 8 = 0 AND row_key = 2)")
    given = given.unionByName(given.where("case_id % 10 = 0 AND row_key = 3"))
    return rules.decision_problems(rows.where("NOT (case_id % 9 = 0 AND row_key = 1)"), given, ["field", "row_key"])


@query("artifact_problems", """SELECT id, problem FROM (SELECT coalesce(a.id, f.id) AS id, CASE WHEN f.id IS NULL THEN 'file_missing' WHEN a.id IS NULL THEN 'undeclared' WHEN a.h <> f.h THEN 'hash_mismatch' END AS problem
    FROM (SELECT page_id AS id, sha256(html || CASE WHEN page_id % 19 = 0 THEN ' ' ELSE '' END) AS h FROM pages WHERE page_id % 13 <> 0) a FULL JOIN (SELECT page_id AS id, sha256(html) AS h FROM pages WHERE page_id % 17 <> 0) f ON a.id = f.id) p WHERE problem IS NOT NULL""")
def artifact_problems(spark, sf):
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("id"), "html")
    declared = pages.where("id % 13 <> 0").select("id", F.sha2(F.concat("html", F.when(F.col("id") % 19 == 0, " ").otherwise("")), 256).alias("sha256"))
    return rules.artifact_problems(declared, pages.where("id % 17 <> 0").select("id", F.sha2("html", 256).alias("sha256")))


@query("prior_runs", "SELECT l_orderkey AS run FROM lineitem WHERE l_linenumber = 1 AND l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_linestatus = 'F' AND l_linenumber = 2)")
def prior_runs(spark, sf):
    lines = table(spark, sf, "lineitem")
    done = lines.where("l_linestatus = 'F' AND l_linenumber = 2").select("l_partkey")
    return lines.where("l_linenumber = 1").join(done, "l_partkey", "left_semi").select(F.col("l_orderkey").alias("run"))


@query("image_sizes", """SELECT p_partkey, CASE WHEN e BETWEEN 5 AND 8 THEN h ELSE w END AS width, CASE WHEN e BETWEEN 5 AND 8 THEN w ELSE h END AS height, w * h <= 89478485 AS allowed
    FROM (SELECT p_partkey, p_partkey % 9 AS e, CAST(p_size * 400 AS BIGINT) AS w, CAST(p_partkey % 50 * 173 AS BIGINT) AS h FROM part) p""")
def image_sizes(spark, sf):
    w, h = (F.col("p_size") * 400).cast("long"), (F.col("p_partkey") % 50 * 173).cast("long")
    return table(spark, sf, "part").select("p_partkey", rules.image_size(F.col("p_partkey") % 9, w, h, 89_478_485).alias("s")).select("p_partkey", "s.*")


# Lists of a job by their number; a row that continues lies on two pages.
_PAGED = "SELECT job, source_key AS list, CASE WHEN continues_next THEN array(pos, pos + 1) WHEN continues_previous THEN array(pos, pos) ELSE array(source_key + job % 3) END AS pages FROM {list_rows} r WHERE job % 7 < 5 OR pos < 3"


@query("list_spread", "WITH p AS (SELECT job, list, pages FROM (" + _PAGED.replace("array(", "list_value(") + """) q), u AS (SELECT job, list, unnest(pages) AS page FROM p)
    SELECT l.job, bool_or(l.pages > 1) AS crosses_pages, bool_or(r.split) AS record_split FROM (SELECT job, list, count(DISTINCT page) AS pages FROM u GROUP BY ALL) l
    JOIN (SELECT job, bool_or(len(pages) > 1) AS split FROM p GROUP BY job) r ON l.job = r.job GROUP BY l.job""")
def list_spread(spark, sf):
    rows = spark.sql(_PAGED, list_rows=adapter(spark, sf, "list_rows"))
    return rules.list_spread(rows, ["job"], "list", "pages")


@query("collected_files", "SELECT owner, count(*) AS files, CAST(sum(1 + message_id % 3) AS BIGINT) AS pages, 'Collected ' || CAST(count(*) AS VARCHAR) || ' files, ' || CAST(CAST(sum(1 + message_id % 3) AS BIGINT) AS VARCHAR) || ' pages' AS message FROM {updates} u WHERE kind = 'view' GROUP BY owner")
def collected_files(spark, sf):
    found = adapter(spark, sf, "updates").where("kind = 'view'").groupBy("owner").agg(F.count("*").alias("files"), F.sum(F.col("message_id") % 3 + 1).cast("long").alias("pages"))
    return found.withColumn("message", F.concat(F.lit("Collected "), F.col("files").cast("string"), F.lit(" files, "), F.col("pages").cast("string"), F.lit(" pages")))


@query("absent_results", "SELECT job, bool_and(status = 'missing') AS absent FROM {readings} r GROUP BY job")
def absent_results(spark, sf):
    return adapter(spark, sf, "readings").groupBy("job").agg(F.bool_and(F.col("status") == "missing").alias("absent"))


@query("library_checks", """SELECT n_name, count(DISTINCT c_mktsegment) AS owners, count(*) AS profiles, CASE WHEN count(DISTINCT c_mktsegment) > 1 THEN 'several_owners' WHEN count(*) <> 3 THEN 'not_three_profiles' ELSE 'ok' END AS result
    FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def library_checks(spark, sf):
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    found = rows.groupBy("n_name").agg(F.count_distinct("c_mktsegment").alias("owners"), F.count("*").alias("profiles"))
    return found.withColumn("result", F.when(F.col("owners") > 1, "several_owners").when(F.col("profiles") != 3, "not_three_profiles").otherwise("ok"))


# Whole texts, by UTF-16 units: a part ends before the character with which it would exceed the limit.
@query("preview_parts", """WITH RECURSIVE c AS MATERIALIZED (SELECT doc_id, text, array_slice(text, 1, 3900) AS head, length(text) AS n FROM documents),
    u AS (SELECT doc_id, text, n, CAST(0 AS BIGINT) AS place, CAST([] AS VARCHAR[]) AS parts FROM c
        UNION ALL SELECT doc_id, text, n, place + length(part), list_append(parts, part) FROM (
            SELECT *, CASE WHEN units <= 3900 THEN piece ELSE substr(piece, 1, list_max(list_filter(range(3900 - (units - length(piece)), 3901), lambda k: k + length(regexp_replace(substr(piece, 1, k), '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) <= 3900))) END AS part
            FROM (SELECT *, length(piece) + length(regexp_replace(piece, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS units FROM (SELECT *, substr(text, place + 1, 3900) AS piece FROM u WHERE place < n) x) y) z),
    d AS (SELECT doc_id, parts FROM u WHERE place >= n)
    SELECT doc_id, CAST(len(parts) AS INT) AS parts, sha256(CASE WHEN len(parts) <= 1 THEN array_to_string(parts, '')
        ELSE array_to_string(list_transform(parts, lambda p, i: 'Preview part ' || CAST(i AS VARCHAR) || '/' || CAST(len(parts) AS VARCHAR) || chr(10) || p), '') END) AS sha256 FROM d""")
def preview_parts(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", rules.preview_parts(F.coalesce("text", F.lit(""))).alias("parts"))
    return rows.select("doc_id", F.size("parts").alias("parts"), F.sha2(F.array_join("parts", ""), 256).alias("sha256"))


@query("credited_once", """SELECT job, source_key, pos, matches, matches AND row_number() OVER (PARTITION BY job, source_key ORDER BY CAST(NOT matches AS INT), pos) = 1 AS correct FROM (SELECT job, source_key, pos, a = 'N' AS matches FROM {list_rows} r) s""")
def credited_once(spark, sf):
    rows = adapter(spark, sf, "list_rows").select("job", "source_key", "pos", (F.col("a") == "N").alias("matches"))
    return rules.credited(rows, ["job", "source_key"], ["pos"])


@query("probability_maps", """SELECT job, count(*) AS pointers, count(*) FILTER (WHERE ok) AS usable, round(sum(CASE WHEN ok THEN s END), 6) AS total
    FROM (SELECT job, status, bool_and(mille <> 0) AS ok, sum(mille / 1000.0) AS s FROM {readings} r GROUP BY job, status) p GROUP BY job""")
def probability_maps(spark, sf):
    tokens = adapter(spark, sf, "readings").selectExpr("job", "batch", "status", "CASE WHEN mille = 0 THEN double('NaN') ELSE mille / 1000D END AS p")
    found = rules.probability_map(tokens, ["job"], "status", "batch", "p").withColumn("v", F.map_values("probabilities"))
    total = F.aggregate(F.flatten(F.array_compact("v")), F.lit(0.0), lambda a, x: a + x)
    kept = F.array_compact("v")
    return found.select("job", F.size("v").cast("long").alias("pointers"), F.size(kept).cast("long").alias("usable"), F.when(F.size(kept) > 0, F.round(total, 6)).alias("total"))


@query("undetermined_traces", """SELECT call_id, (centis % 40 = 0) OR (centis % 3 = 0 AND kind = 'alternate' AND centis > 2000) AS undetermined FROM {calls} c""")
def undetermined_traces(spark, sf):
    code = F.when(F.col("kind") == "alternate", "processing_budget_exhausted").otherwise("runtime_failure")
    return adapter(spark, sf, "calls").select("call_id", rules.undetermined(2000, F.when(F.col("centis") % 3 == 0, 1).otherwise(0), F.col("centis") % 40 == 0, code, F.col("centis")).alias("undetermined"))


@query("draft_problems", """SELECT owner, drafts, CASE WHEN drafts > 10 THEN 'too_many' WHEN given > different THEN 'index_repeated' WHEN most > coalesce(size, 0) OR least < 1 THEN 'index_out_of_range' END AS problem FROM
    (SELECT l_orderkey AS owner, count(*) AS drafts, count(x) AS given, count(DISTINCT x) AS different, max(x) AS most, min(x) AS least FROM (SELECT l_orderkey, CASE WHEN l_linenumber % 3 <> 0 THEN l_linenumber % (2 + l_orderkey % 4) + l_orderkey % 2 END AS x FROM lineitem) d GROUP BY 1) g
    LEFT JOIN (SELECT l_orderkey AS o, count(*) AS size FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1) s ON owner = o""")
def draft_problems(spark, sf):
    lines = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "owner")
    drafts = lines.selectExpr("owner", "CASE WHEN l_linenumber % 3 <> 0 THEN l_linenumber % (2 + owner % 4) + owner % 2 END AS source_index")
    return rules.draft_problems(drafts, lines.where("l_linenumber <= 3"), "owner")


@query("canonical_rows", """SELECT p_partkey, sha256('{"brand":"' || p_brand || '","key":' || CAST(p_partkey AS VARCHAR) || ',"size":' || CASE WHEN p_size % 5 = 0 THEN 'null' ELSE CAST(p_size AS VARCHAR) END || '}') AS sha256 FROM part""")
def canonical_rows(spark, sf):
    row = {"size": F.when(F.col("p_size") % 5 != 0, F.col("p_size")), "key": F.col("p_partkey"), "brand": F.col("p_brand")}
    return table(spark, sf, "part").select("p_partkey", F.sha2(rules.canonical_json(row), 256).alias("sha256"))


@query("duplicate_ids", "SELECT owner, message_id % 100 AS message, count(*) AS n FROM {updates} u GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_ids(spark, sf):
    return adapter(spark, sf, "updates").groupBy("owner", (F.col("message_id") % 100).alias("message")).agg(F.count("*").alias("n")).where("n > 1")


@query("profile_view", "SELECT owner, CAST(row_number() OVER (PARTITION BY owner ORDER BY created, id) AS INT) AS position, name FROM {profiles} p")
def profile_view(spark, sf):
    ordered = adapter(spark, sf, "profiles").groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("created", "id", "name"))).alias("p"))  # an owner's library
    return ordered.select("owner", F.posexplode("p").alias("i", "p")).select("owner", (F.col("i") + 1).alias("position"), "p.name")
