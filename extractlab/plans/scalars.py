"""Scalar functions and contract checks over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from extractlab.functions import scalar as fn
from extractlab.operators import contracts
from extractlab.plans.registry import query
from extractlab.sources.adapters import adapter, table

_NUMBER = """CASE l_partkey % 6 WHEN 0 THEN '00' || CAST(l_partkey AS VARCHAR) || '.500' WHEN 1 THEN '-0.00' WHEN 2 THEN '+' || CAST(l_suppkey AS VARCHAR)
    WHEN 3 THEN CAST(l_partkey AS VARCHAR) || '.' WHEN 4 THEN '-' || CAST(l_suppkey AS VARCHAR) || '.010' ELSE '1e' || CAST(l_linenumber AS VARCHAR) END"""


@query("norm_number", f"""
    SELECT raw, CASE WHEN regexp_matches(raw, '^[+-]?[0-9]+(\\.[0-9]+)?$') THEN
             CASE WHEN body = '0' THEN '0' ELSE CASE WHEN raw LIKE '-%' THEN '-' ELSE '' END || body END END AS normalized, count(*) AS n
    FROM (SELECT raw, CASE WHEN frac = '' THEN whole ELSE whole || '.' || frac END AS body FROM (
        SELECT raw, CASE WHEN ltrim(regexp_extract(raw, '^[+-]?([0-9]+)', 1), '0') = '' THEN '0' ELSE ltrim(regexp_extract(raw, '^[+-]?([0-9]+)', 1), '0') END AS whole,
               rtrim(regexp_extract(raw, '\\.([0-9]+)$', 1), '0') AS frac FROM (SELECT {_NUMBER} AS raw FROM lineitem) a) b) c GROUP BY 1, 2""")
def norm_number(spark, sf):
    raw = table(spark, sf, "lineitem").select(F.expr(_NUMBER.replace("VARCHAR", "STRING")).alias("raw"))
    return raw.groupBy("raw", fn.normal_number(F.col("raw")).alias("normalized")).agg(F.count("*").alias("n"))


_DATE = """CASE WHEN l_orderkey % 4 = 0 THEN strftime(l_shipdate, '%Y-%m-%d') WHEN l_orderkey % 4 = 1 THEN strftime(l_shipdate, '%d/%m/%Y')
    WHEN l_orderkey % 4 = 2 THEN '31/02/' || strftime(l_shipdate, '%Y') ELSE strftime(l_shipdate, '%d.%m.%Y') END"""


@query("norm_date", f"""
    SELECT raw, len(r) AS readings, CASE WHEN len(r) = 1 THEN r[1] WHEN len(r) = 0 THEN raw END AS normalized, n FROM (
      SELECT raw, n, list_distinct(list_filter([strftime(try_strptime(raw, '%Y-%m-%d'), '%Y-%m-%d'), strftime(try_strptime(raw, '%d/%m/%Y'), '%Y-%m-%d'),
             strftime(try_strptime(raw, '%m/%d/%Y'), '%Y-%m-%d')], lambda x: x IS NOT NULL)) AS r
      FROM (SELECT {_DATE} AS raw, count(*) AS n FROM lineitem GROUP BY 1) a) b""")
def norm_date(spark, sf):
    day = F.col("l_shipdate")
    raw = (
        F.when(F.col("l_orderkey") % 4 == 0, F.date_format(day, "yyyy-MM-dd")).when(F.col("l_orderkey") % 4 == 1, F.date_format(day, "dd/MM/yyyy"))
        .when(F.col("l_orderkey") % 4 == 2, F.concat(F.lit("31/02/"), F.date_format(day, "yyyy"))).otherwise(F.date_format(day, "dd.MM.yyyy"))
    )
    formats = ["%d/%m/%Y", "%m/%d/%Y"]
    rows = table(spark, sf, "lineitem").groupBy(raw.alias("raw")).agg(F.count("*").alias("n"))
    return rows.select(
        "raw", F.size(fn.date_readings(F.col("raw"), formats)).cast("long").alias("readings"), fn.normal_date(F.col("raw"), formats).alias("normalized"), "n"
    )


@query("luhn_runs", """
    SELECT doc_id, CAST(len(runs) AS BIGINT) AS runs, CAST(len(list_filter(runs, lambda r: list_sum([CASE WHEN (len(r) - i) % 2 = 1 THEN
             CASE WHEN CAST(r[i] AS INT) * 2 > 9 THEN CAST(r[i] AS INT) * 2 - 9 ELSE CAST(r[i] AS INT) * 2 END ELSE CAST(r[i] AS INT) END
             for i in range(1, len(r) + 1)]) % 10 = 0)) AS BIGINT) AS valid
    FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]{2,}') AS runs FROM documents) d""")
def luhn_runs(spark, sf):
    runs = F.regexp_extract_all("text", F.lit("[0-9]{2,}"), F.lit(0))
    return table(spark, sf, "documents").select("doc_id", runs.alias("r")).select(
        "doc_id", F.size("r").cast("long").alias("runs"), F.size(F.filter("r", fn.luhn)).cast("long").alias("valid")
    )


_IBAN = "'DE' || lpad(CAST(p_partkey % 98 AS VARCHAR), 2, '0') || ' ' || lpad(CAST(p_partkey * 7919 % 1000000000 AS VARCHAR), 14, '0')"


@query("iban_check", f"""
    SELECT p_partkey, value, CAST(substr(replace(value, ' ', ''), 5) || '1314' || substr(value, 3, 2) AS HUGEINT) % 97 = 1 AS valid
    FROM (SELECT p_partkey, {_IBAN} AS value FROM part) p""")
def iban_check(spark, sf):
    value = F.expr(_IBAN.replace("VARCHAR", "STRING"))
    return table(spark, sf, "part").select("p_partkey", value.alias("value")).withColumn("valid", fn.iban(F.col("value")))


@query("iso_code", "SELECT lang, count(*) AS n, lang IN ('de', 'en', 'fr') AS valid FROM documents GROUP BY lang")
def iso_code(spark, sf):
    allowed = F.array(*(F.lit(x) for x in ("de", "en", "fr")))
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n")).withColumn("valid", F.array_contains(allowed, F.col("lang")))


@query("utf16_len", "SELECT doc_id, CAST(length(text) + length(text) - length(regexp_replace(text, '[\\x{10000}-\\x{10FFFF}]', '', 'g')) AS BIGINT) AS units FROM documents")
def utf16_len(spark, sf):
    return table(spark, sf, "documents").select("doc_id", fn.utf16_length(F.col("text")).alias("units"))


@query("label_ellipsis", "SELECT doc_id, CASE WHEN length(text) <= 48 THEN text ELSE substr(text, 1, 47) || '…' END AS label FROM documents")
def label_ellipsis(spark, sf):
    return table(spark, sf, "documents").select("doc_id", fn.label(F.col("text")).alias("label"))


@query("html_escape", """SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS escaped_sha256 FROM pages""")
def html_escape(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha2(fn.html_escaped(F.col("html")), 256).alias("escaped_sha256"))


_PATH = "CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN 'a/' || CAST(page_id AS VARCHAR) || '.png' WHEN 2 THEN '/a/b' WHEN 3 THEN 'a/../b' ELSE 'a//b' END"


@query("safe_path", f"""
    SELECT page_id, path, NOT (contains(path, '\\') OR contains(path, ':') OR starts_with(path, '/') OR path IN ('', '.')
           OR list_has_any(string_split(path, '/'), ['..', '.', ''])) AS safe FROM (SELECT page_id, {_PATH} AS path FROM pages) p""")
def safe_path(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", F.expr(_PATH.replace("VARCHAR", "STRING")).alias("path"))
    return rows.withColumn("safe", fn.safe_path(F.col("path")))


# The bytes of a file: a signature before the page's whole text, or within it.
_CONTENT = """CASE WHEN page_id % 5 = 0 THEN unhex('89504E470D0A1A0A') || encode(html) WHEN page_id % 5 = 1 THEN unhex('FFD8FFE0') || encode(html) WHEN page_id % 5 = 2 THEN encode(left(html, page_id % 2000) || '%PDF-1.7')
    WHEN page_id % 5 = 3 THEN unhex('FFD8') || encode(html) ELSE encode(html) END"""


@query("magic_kind", f"""
    SELECT kind, count(*) AS n FROM (SELECT CASE WHEN left(h, 16) = '89504E470D0A1A0A' THEN 'png' WHEN left(h, 6) = 'FFD8FF' THEN 'jpeg' WHEN regexp_matches(left(h, 2048), '^(..)*255044462D') THEN 'pdf' END AS kind
      FROM (SELECT hex({_CONTENT}) AS h FROM pages) c) p GROUP BY kind""")
def magic_kind(spark, sf):
    sql = _CONTENT.replace("encode(html)", "encode(html, 'UTF-8')").replace("'%PDF-1.7')", "'%PDF-1.7', 'UTF-8')").replace("page_id % 2000", "CAST(page_id % 2000 AS INT)")
    return table(spark, sf, "pages").select(fn.media_kind(F.expr(sql)).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("iou", """
    SELECT p_partkey, round(CASE WHEN u > 0 THEN i / u ELSE 0 END, 9) AS iou FROM (SELECT p_partkey, i, 100.0 + 10.0 * p_size - i AS u FROM (
      SELECT p_partkey, p_size, greatest(0.0, least(10.0, p_partkey % 7 + p_size) - p_partkey % 7) * greatest(0.0, least(10.0, p_partkey % 5 + 10.0) - p_partkey % 5) AS i FROM part) a) b""")
def iou(spark, sf):
    def box(left, top, right, bottom):
        return F.struct(*(c.cast("double").alias(k) for k, c in zip(("left", "top", "right", "bottom"), (left, top, right, bottom), strict=True)))

    x, y = F.col("p_partkey") % 7, F.col("p_partkey") % 5
    a, b = box(F.lit(0), F.lit(0), F.lit(10), F.lit(10)), box(x, y, x + F.col("p_size"), y + 10)
    return table(spark, sf, "part").select("p_partkey", F.round(fn.iou(a, b), 9).alias("iou"))


@query("owner_id", """
    SELECT raw, CASE WHEN regexp_matches(raw, '^[0-9]+$') AND TRY_CAST(raw AS BIGINT) >= 1 THEN TRY_CAST(raw AS BIGINT) END AS owner, count(*) AS n
    FROM (SELECT CASE o_orderkey % 4 WHEN 0 THEN CAST(o_custkey AS VARCHAR) WHEN 1 THEN '-5' WHEN 2 THEN '9223372036854775808' ELSE '0' END AS raw FROM orders) o GROUP BY 1, 2""")
def owner_id(spark, sf):
    raw = F.expr("CASE o_orderkey % 4 WHEN 0 THEN CAST(o_custkey AS STRING) WHEN 1 THEN '-5' WHEN 2 THEN '9223372036854775808' ELSE '0' END")
    rows = table(spark, sf, "orders").select(raw.alias("raw"))
    return rows.groupBy("raw", fn.owner_id(F.col("raw")).alias("owner")).agg(F.count("*").alias("n"))


@query("zero_error_bound", """
    SELECT c_nationkey, n, errors, CASE WHEN errors = 0 AND n > 0 THEN round(1 - pow(0.05, 1.0 / n), 9) END AS bound FROM (
      SELECT c_nationkey, count(*) AS n, count(*) FILTER (WHERE c_acctbal < -999) AS errors FROM customer GROUP BY 1) c""")
def zero_error_bound(spark, sf):
    rows = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < -999).alias("errors"))
    return rows.withColumn("bound", F.round(fn.zero_error_bound(F.col("n"), F.col("errors")), 9))


@query("field_violations", """
    SELECT status, rule, count(*) AS n FROM (SELECT status, unnest(list_filter([
        CASE WHEN status = 'extracted' AND raw IS NULL THEN 'raw_required' END, CASE WHEN status NOT IN ('extracted', 'invalid') AND raw IS NOT NULL THEN 'raw_forbidden' END,
        CASE WHEN status <> 'extracted' AND normalized IS NOT NULL THEN 'normalized_forbidden' END, CASE WHEN raw IS NOT NULL AND pages = 0 THEN 'pages_required' END],
        lambda x: x IS NOT NULL)) AS rule
      FROM (SELECT status, CASE WHEN batch % 9 = 0 THEN NULL WHEN batch % 5 = 0 THEN 'Z' ELSE raw END AS raw, CASE WHEN mille % 7 = 0 THEN 'n' END AS normalized, mille % 4 AS pages FROM {readings}) r) v
    GROUP BY 1, 2""")
def field_violations(spark, sf):
    rows = adapter(spark, sf, "readings").select(
        "status", F.expr("CASE WHEN batch % 9 = 0 THEN NULL WHEN batch % 5 = 0 THEN 'Z' ELSE raw END").alias("raw"),
        F.expr("CASE WHEN mille % 7 = 0 THEN 'n' END").alias("normalized"), F.expr("mille % 4").alias("pages"),
    )
    broken = contracts.violations(rows, contracts.field_rules(F.col("status"), F.col("raw"), F.col("normalized"), F.col("pages")))
    return broken.groupBy("status", "rule").agg(F.count("*").alias("n"))


@query("list_violations", """
    SELECT rule, count(*) AS n FROM (SELECT unnest(list_filter([
        CASE WHEN status = 'complete' AND (NOT whole OR NOT resolved) THEN 'complete_needs_enumeration_and_cells' END, CASE WHEN status = 'partial' AND NOT accepted THEN 'partial_needs_accepted_cell' END,
        CASE WHEN status = 'unresolved' AND accepted THEN 'unresolved_has_accepted_cell' END, CASE WHEN status = 'unresolved' AND reason IS NULL THEN 'unresolved_needs_reason' END,
        CASE WHEN status <> 'unresolved' AND reason IS NOT NULL THEN 'reason_forbidden' END, CASE WHEN status = 'partial' AND whole AND resolved THEN 'partial_is_complete' END], lambda x: x IS NOT NULL)) AS rule
      FROM (SELECT CASE job % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'partial' ELSE 'unresolved' END AS status, job % 2 = 0 AS whole, CASE WHEN job % 5 = 0 THEN 'missing' END AS reason,
                   bool_or(a <> 'A') AS accepted, bool_and(b = 'O') AS resolved FROM {list_rows} GROUP BY job) l) v GROUP BY 1""")
def list_violations(spark, sf):
    rows = adapter(spark, sf, "list_rows").groupBy("job").agg(F.bool_or(F.col("a") != "A").alias("accepted"), F.bool_and(F.col("b") == "O").alias("resolved")).selectExpr(
        "CASE job % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'partial' ELSE 'unresolved' END AS status", "job % 2 = 0 AS whole", "CASE WHEN job % 5 = 0 THEN 'missing' END AS reason", "accepted", "resolved"
    )
    broken = contracts.violations(rows, contracts.list_rules(*(F.col(c) for c in ("status", "whole", "reason", "accepted", "resolved"))))
    return broken.groupBy("rule").agg(F.count("*").alias("n"))


@query("coverage_gaps", """
    SELECT coalesce(w.job, g.job) AS job, coalesce(w.id, g.id) AS id, CASE WHEN g.id IS NULL THEN 'missing' ELSE 'unexpected' END AS gap
    FROM (SELECT DISTINCT l_orderkey AS job, l_linenumber AS id FROM lineitem WHERE l_partkey % 5 <> 0) w
    FULL JOIN (SELECT DISTINCT l_orderkey AS job, l_linenumber AS id FROM lineitem WHERE l_suppkey % 5 <> 0) g ON w.job = g.job AND w.id = g.id WHERE w.id IS NULL OR g.id IS NULL""")
def coverage_gaps(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("id"), "l_partkey", "l_suppkey")
    return contracts.coverage_gaps(rows.where("l_partkey % 5 <> 0").select("job", "id"), rows.where("l_suppkey % 5 <> 0").select("job", "id"), ["job", "id"])


_CAPTURES = """SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'PNG' ELSE 'JPEG' END AS format, page_id * 7919 % 100000000 AS pixels, page_id % 11 = 0 AS gps,
    CASE WHEN page_id % 5 < 3 THEN 'telegram' ELSE 'camera' END AS source, CASE WHEN page_id % 5 < 3 THEN CASE WHEN page_id % 2 = 0 THEN 'hd' ELSE 'standard' END END AS sent,
    page_id * 37 % 3000 AS side, page_id * 104729 % 30000000 AS bytes FROM {pages}"""


@query("capture_reasons", "SELECT page_id, array_to_string(CASE WHEN format <> 'JPEG' THEN ['not_jpeg'] WHEN pixels > 89478485 THEN ['pixel_limit'] ELSE list_filter([CASE WHEN gps THEN 'location_metadata_present' END, "
    "CASE WHEN sent = 'standard' AND side > 1280 THEN 'telegram_standard_size_mismatch' WHEN sent = 'hd' AND side NOT BETWEEN 1281 AND 2560 THEN 'telegram_hd_size_mismatch' END, "
    "CASE WHEN source = 'camera' AND side < 2561 THEN 'camera_original_too_small' END, CASE WHEN source = 'camera' AND bytes > 20971520 THEN 'exceeds_bot_api_file_limit' END], lambda x: x IS NOT NULL) END, ',') AS reasons "
    "FROM (" + _CAPTURES.replace("{pages}", "pages") + ") p")
def capture_reasons(spark, sf):
    rows = spark.sql(_CAPTURES, pages=table(spark, sf, "pages"))
    columns = (F.col(c) for c in ("format", "pixels", "gps", "source", "sent", "side", "bytes"))
    return rows.select("page_id", F.array_join(contracts.capture_reasons(*columns), ",").alias("reasons"))


@query("failure_state", """
    SELECT code, CASE WHEN code IN ('processing_budget_exhausted', 'runtime_timeout') THEN 'timeout' WHEN code IN ('unsupported_format', 'damaged_input', 'encrypted_pdf', 'pixel_limit') THEN 'input_refused' ELSE 'failed' END AS state, count(*) AS n
    FROM (SELECT CASE o_orderkey % 5 WHEN 0 THEN 'runtime_timeout' WHEN 1 THEN 'encrypted_pdf' WHEN 2 THEN 'pixel_limit' WHEN 3 THEN 'processing_budget_exhausted' ELSE 'worker_crash' END AS code FROM orders) o GROUP BY 1, 2""")
def failure_state(spark, sf):
    code = F.expr("CASE o_orderkey % 5 WHEN 0 THEN 'runtime_timeout' WHEN 1 THEN 'encrypted_pdf' WHEN 2 THEN 'pixel_limit' WHEN 3 THEN 'processing_budget_exhausted' ELSE 'worker_crash' END")
    rows = table(spark, sf, "orders").select(code.alias("code"))
    return rows.groupBy("code", contracts.failure_state(F.col("code")).alias("state")).agg(F.count("*").alias("n"))


@query("log_allowlist", "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('error', 'signup') AND regexp_matches(props, '[0-9]') GROUP BY 1")
def log_allowlist(spark, sf):
    return contracts.allowed_log(table(spark, sf, "events"), F.col("event_type"), F.col("props"), ["error", "signup"], "[0-9]").groupBy("event_type").agg(F.count("*").alias("n"))


@query("accepted_values", """SELECT status, accepted, count(*) AS n FROM (SELECT status, CASE WHEN status = 'extracted' THEN CASE WHEN raw = 'N' AND mille % 2 = 0 THEN 'no' ELSE raw END END AS accepted FROM {readings} r) a GROUP BY 1, 2""")
def accepted_values(spark, sf):
    normal = F.when((F.col("raw") == "N") & (F.col("mille") % 2 == 0), "no")
    accepted = contracts.accepted_value(F.col("status"), normal, F.col("raw"))
    return adapter(spark, sf, "readings").groupBy("status", accepted.alias("accepted")).agg(F.count("*").alias("n"))
