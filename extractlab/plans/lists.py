"""Lists merged in order, references resolved, and texts rendered, over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from extractlab.functions import scalar as fn
from extractlab.operators import lists
from extractlab.plans.registry import query
from extractlab.sources.adapters import LINES, adapter, shares, table


# A list row for each line, in batches of three; the batch after every fifth line of an order has no rows.
_BATCHES = """(SELECT job, CAST((pos + 2) // 3 AS INT) AS batch, CAST((pos + 2) % 3 + 1 AS INT) AS row, 'k' || CAST(source_key AS VARCHAR) || ':' || CAST(pos % 4 AS VARCHAR) AS source_key,
      CAST((pos + 2) // 3 AS VARCHAR) AS pages, continues_previous AND (pos + 2) % 3 = 0 AS continues_previous, continues_next AND (pos + 2) % 3 = 2 AS continues_next,
      job % 11 <> 0 AS enumerated, 'complete' AS status, CAST(NULL AS VARCHAR) AS reason, job % 7 <> 0 AS traversed,
      CASE WHEN (job + pos) % 9 = 0 THEN 'missing' WHEN (job + pos) % 31 = 0 THEN 'invalid' ELSE 'extracted' END AS a_status, CASE WHEN (job + pos) % 9 <> 0 THEN a END AS a, 'extracted' AS b_status, b FROM {list_rows} r
    UNION ALL SELECT job, 9, NULL, NULL, NULL, false, false, true, CASE WHEN job % 2 = 0 THEN 'complete' ELSE 'unresolved' END, CASE WHEN job % 4 = 1 THEN 'missing' WHEN job % 4 = 3 THEN 'unreadable' END,
      job % 7 <> 0, NULL, NULL, NULL, NULL FROM {list_rows} r WHERE pos = 1 AND job % 5 = 0
    UNION ALL SELECT job, 10, 1, 'k1:1', '1', false, false, true, 'complete', NULL, job % 7 <> 0, 'extracted', CASE WHEN job % 3 = 0 THEN a ELSE 'Q' END, 'extracted', b FROM {list_rows} r WHERE pos = 1 AND job % 6 = 0)"""
_CELL = """CASE WHEN open THEN 1 WHEN min({c}) FILTER (WHERE {c}_status IN ('extracted', 'invalid')) <> max({c}) FILTER (WHERE {c}_status IN ('extracted', 'invalid')) THEN 1
      ELSE min(list_position(['ambiguous', 'extracted', 'invalid', 'unreadable', 'missing'], {c}_status)) END AS {c}"""
_MERGED_LISTS = f"""(WITH r AS (SELECT *, row IS NOT NULL AS is_row FROM {_BATCHES} b),
    o AS (SELECT *, is_row AND row_number() OVER own > 1 AS again, first_value(struct_pack(p := continues_previous, n := continues_next, s := a_status, v := a, t := b_status, w := b)) OVER own AS first FROM r
      WINDOW own AS (PARTITION BY job, source_key, pages ORDER BY batch, row)),
    k AS (SELECT * FROM o WHERE NOT again OR first IS DISTINCT FROM struct_pack(p := continues_previous, n := continues_next, s := a_status, v := a, t := b_status, w := b)),
    l AS (SELECT *, NOT again AND is_row AND continues_previous AND coalesce(last_value(CASE WHEN NOT again THEN continues_next AND is_row END IGNORE NULLS) OVER (PARTITION BY job ORDER BY batch, row NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS joined FROM k),
    n AS (SELECT *, sum(CASE WHEN again OR joined THEN 0 ELSE 1 END) OVER (PARTITION BY job ORDER BY batch, row NULLS FIRST ROWS UNBOUNDED PRECEDING) AS run FROM l),
    f AS (SELECT *, first_value(run) OVER (PARTITION BY job, source_key, pages ORDER BY batch, row) AS place FROM n),
    g AS (SELECT *, coalesce(arg_min(continues_previous, (batch, row)) FILTER (WHERE is_row AND NOT again) OVER w OR arg_max(continues_next, (batch, row)) FILTER (WHERE is_row AND NOT again) OVER w, false) AS open,
            coalesce(arg_min(continues_previous, (batch, row)) FILTER (WHERE is_row AND NOT again) OVER w, false) AS headless FROM f WINDOW w AS (PARTITION BY job, place)),
    c AS (SELECT job, place, open, headless, count(*) FILTER (WHERE is_row AND NOT again) AS parts, bool_or(again) AS differs, bool_and(traversed) AS traversed, bool_and(enumerated) AS enumerated,
        bool_and(is_row OR status = 'complete' OR coalesce(reason = 'missing', false)) AS told, bool_and(status = 'complete') AS complete, list(DISTINCT reason) FILTER (WHERE reason IS NOT NULL) AS reasons,
        {_CELL.replace('{c}', 'a')}, {_CELL.replace('{c}', 'b')} FROM g GROUP BY job, place, open, headless),
    d AS (SELECT * REPLACE (CASE WHEN parts = 0 THEN NULL WHEN a = 5 AND NOT traversed THEN 4 ELSE a END AS a, CASE WHEN parts = 0 THEN NULL WHEN b = 5 AND NOT traversed THEN 4 ELSE b END AS b) FROM c),
    e AS (SELECT job, bool_and(enumerated AND traversed AND told AND NOT differs AND NOT open AND NOT (parts > 1 AND coalesce(a = 1 OR b = 1, false))) AS enumerated,
        CAST(sum(CASE WHEN headless THEN parts WHEN parts > 0 THEN 1 ELSE 0 END) AS BIGINT) AS rows, CAST(coalesce(sum(CAST(coalesce(a = 2, false) AS INT) + CAST(coalesce(b = 2, false) AS INT)), 0) AS BIGINT) AS accepted,
        bool_or(coalesce(a IN (1, 3, 4) OR b IN (1, 3, 4), false)) AS unsettled, bool_and(complete) AS complete,
        CASE WHEN bool_or(coalesce(a = 1 OR b = 1, false) OR coalesce(list_contains(reasons, 'ambiguous'), false)) THEN 'ambiguous' WHEN bool_or(coalesce(a = 3 OR b = 3, false) OR coalesce(list_contains(reasons, 'invalid'), false)) THEN 'invalid'
          WHEN bool_or(coalesce(a = 4 OR b = 4, false) OR coalesce(list_contains(reasons, 'unreadable'), false)) THEN 'unreadable' WHEN bool_or(coalesce(a = 5 OR b = 5, false) OR coalesce(list_contains(reasons, 'missing'), false)) THEN 'missing' ELSE 'unreadable' END AS worst FROM d GROUP BY job),
    s AS (SELECT *, CASE WHEN enumerated AND NOT unsettled AND (rows > 0 OR complete) THEN 'complete' WHEN accepted > 0 THEN 'partial' ELSE 'unresolved' END AS status FROM e)
    SELECT job, status, CASE WHEN status = 'unresolved' THEN CASE WHEN worst = 'missing' AND NOT enumerated THEN 'unreadable' ELSE worst END END AS reason, rows, accepted, enumerated FROM s)"""


def _merged_lists(spark, sf):
    sql = _BATCHES.replace("//", "div").replace("VARCHAR", "STRING").replace("{list_rows}", "{rows}")
    rows = spark.sql(f"SELECT * FROM {sql} b", rows=adapter(spark, sf, "list_rows"))
    return lists.merge_lists(rows, ["a", "b"], shares(table(spark, sf, "lineitem"), LINES))


@query("merge_lists", f"SELECT * FROM {_MERGED_LISTS} m")
def merge_lists(spark, sf):
    return _merged_lists(spark, sf)


@query("resolve_matching", """SELECT o.o_orderkey AS call_id, o.ix, p.p_name, CASE WHEN o.ix IS NULL THEN 'not_matched' WHEN p.p_name IS NULL THEN 'out_of_range' ELSE 'matched' END AS result
    FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN 1 + o_custkey % 12 END AS ix FROM orders) o LEFT JOIN (SELECT p_name, row_number() OVER (ORDER BY p_partkey) AS ix FROM part WHERE p_partkey <= 10) p ON p.ix = o.ix""")
def resolve_matching(spark, sf):
    # A library of ten profiles: its order is part of the request, and its size is fixed.
    names = table(spark, sf, "part").where("p_partkey <= 10").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))).alias("library"))
    library = names.select(F.posexplode("library").alias("place", "p")).select((F.col("place") + 1).alias("at"), "p.p_name")
    calls = table(spark, sf, "orders").selectExpr("o_orderkey AS call_id", "CASE WHEN o_orderkey % 4 <> 0 THEN 1 + o_custkey % 12 END AS ix")
    found = calls.join(F.broadcast(library), F.col("ix") == F.col("at"), "left")
    result = F.when(F.col("ix").isNull(), "not_matched").when(F.col("p_name").isNull(), "out_of_range").otherwise("matched")
    return found.select("call_id", "ix", "p_name", result.alias("result"))


@query("stale_buttons", """SELECT count(*) AS n, split_part(token, ':', 1) AS prefix, split_part(token, ':', 2) <> nonce AS stale
    FROM (SELECT event_type || ':' || CAST(event_id % 3 AS VARCHAR) || ':' || CAST(event_id AS VARCHAR) AS token, CAST(user_id % 3 AS VARCHAR) AS nonce FROM events) e GROUP BY 2, 3""")
def stale_buttons(spark, sf):
    rows = table(spark, sf, "events").selectExpr("concat(event_type, ':', event_id % 3, ':', event_id) AS token", "CAST(user_id % 3 AS STRING) AS nonce")
    part = F.split("token", ":")
    return rows.groupBy(part[0].alias("prefix"), (part[1] != F.col("nonce")).alias("stale")).agg(F.count("*").alias("n"))


@query("render_reservation", """SELECT conv_id, CAST(least(count(*) * 900, sum(octet_length(encode(text)))) + max(octet_length(encode(text))) AS BIGINT) AS bytes FROM conversations GROUP BY 1""")
def render_reservation(spark, sf):
    size = F.octet_length("text").cast("long")
    return table(spark, sf, "conversations").groupBy("conv_id").agg((F.least(F.count("*") * 900, F.sum(size)) + F.max(size)).alias("bytes"))


@query("value_text", """SELECT status, raw, count(*) AS n, CASE status WHEN 'extracted' THEN raw WHEN 'missing' THEN 'Missing' WHEN 'unreadable' THEN 'Unreadable' WHEN 'ambiguous' THEN 'Ambiguous'
    WHEN 'invalid' THEN 'Unreadable (did not pass the format check)' END AS shown FROM {readings} r GROUP BY status, raw""")
def value_text(spark, sf):
    return adapter(spark, sf, "readings").groupBy("status", "raw").agg(F.count("*").alias("n")).withColumn("shown", lists.shown_value(F.col("status"), F.col("raw")))


@query("list_text", f"""SELECT status, reason, count(*) AS n, CASE WHEN status <> 'unresolved' THEN upper(status[1]) || status[2:] WHEN reason = 'invalid' THEN 'Unreadable (did not pass the format check)'
    ELSE upper(reason[1]) || reason[2:] END AS shown FROM {_MERGED_LISTS} m GROUP BY status, reason""")
def list_text(spark, sf):
    found = _merged_lists(spark, sf).groupBy("status", "reason").agg(F.count("*").alias("n"))
    return found.withColumn("shown", lists.shown_list(F.col("status"), F.col("reason")))


_FIELDS = """(SELECT p_partkey AS id, p_name AS name, p_type AS description, 'Extract ' || p_name AS instruction, CASE WHEN p_size % 3 = 0 THEN 'Keep case' ELSE '' END AS guidance, n AS place, 'Field ' || CAST(n AS VARCHAR) AS label,
      CASE WHEN n = 1 THEN 'date' ELSE 'text' END AS type, CASE WHEN n = 1 THEN 'calendar_date' WHEN p_size % 4 = 1 THEN 'iban' WHEN p_size % 4 = 2 THEN 'luhn' WHEN p_size % 4 = 3 THEN 'iso_code' END AS kind
    FROM part CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2) f)"""


@query("profile_text", f"""SELECT id, sha256(name || chr(10) || 'Applies to: ' || description || chr(10) || 'Original instruction: ' || instruction || chr(10) || 'Fields:' || chr(10)
    || string_agg('- ' || label || ': ' || description || ' (' || type || ')' || CASE WHEN kind IS NULL THEN '' ELSE chr(10) || '  Format check: ' || CASE kind WHEN 'calendar_date' THEN 'Calendar date in DD/MM/YYYY' WHEN 'iso_code' THEN 'Allowed codes: EUR, USD'
      WHEN 'iban' THEN 'IBAN checksum' ELSE 'Luhn checksum' END END, chr(10) ORDER BY place) || chr(10) || 'Additional instructions: ' || CASE WHEN guidance = '' THEN 'None' ELSE guidance END) AS text_sha256
    FROM {_FIELDS} f GROUP BY id, name, description, instruction, guidance""")
def profile_text(spark, sf):
    fields = spark.sql(f"SELECT * FROM {_FIELDS.replace('VARCHAR', 'STRING').replace('FROM part', 'FROM {part}')} f", part=table(spark, sf, "part"))
    given = fields.withColumn("date_formats", F.array(F.lit("%d/%m/%Y"))).withColumn("codes", F.array(F.lit("EUR"), F.lit("USD")))
    return lists.profile_texts(given).select("id", F.sha2("text", 256).alias("text_sha256"))


@query("label_lengths", "SELECT lang, CAST(max(length(CASE WHEN length(text) <= 20 THEN text ELSE substr(text, 1, 19) || '…' END)) AS BIGINT) AS longest, count(*) AS n FROM documents GROUP BY lang")
def label_lengths(spark, sf):
    short = fn.label(F.col("text"), 20)
    return table(spark, sf, "documents").groupBy("lang").agg(F.max(F.length(short)).cast("long").alias("longest"), F.count("*").alias("n"))
