"""Replies of two profiles of different shape, assembled in one pass; the SQL reads the same texts with JSON functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from extractlab.operators import replies
from extractlab.plans.registry import query
from extractlab.sources.adapters import over

_EXTRACTED = "WHEN k % 97 = 0 THEN 'found' ELSE 'extracted' END"
_TOTAL = f"""concat('{{"s":"', CASE k % 10 WHEN 0 THEN 'missing' WHEN 1 THEN 'unreadable' ELSE CASE {_EXTRACTED} END, '","v":',
    CASE WHEN k % 10 IN (0, 1) THEN CASE WHEN k % 53 = 0 THEN '"x"' ELSE 'null' END WHEN k % 59 = 0 THEN '12' WHEN k % 7 = 0 THEN '"1,5"' ELSE concat('"+0', c, '.50"') END, ',"p":[',
    CASE WHEN k % 10 IN (0, 1) OR k % 61 = 0 THEN '' WHEN k % 67 = 0 THEN concat(p, ',', p) WHEN k % 71 = 0 THEN '9' WHEN k % 73 = 0 THEN '1.0' ELSE p END, ']}}')"""
_DAY = """concat('{"s":"extracted","v":"', CASE k % 4 WHEN 0 THEN '2024-02-30' WHEN 1 THEN '03/04/2024' WHEN 2 THEN '25/12/2024' ELSE '2024-1-5' END, '","p":[', p, ']}')"""
_PAID = """concat('{"s":"extracted","v":', CASE k % 6 WHEN 0 THEN '"yes"' WHEN 1 THEN 'false' WHEN 2 THEN 'null' ELSE 'true' END, ',"p":[', p, ']}')"""


def _row(i: int) -> str:
    missing = f"(k + {i}) % 13 = 0"
    qty = f"""concat('{{"s":"', CASE WHEN {missing} THEN 'missing' ELSE 'extracted' END, '","v":', CASE WHEN {missing} THEN 'null' WHEN (k + {i}) % 11 = 0 THEN '"many"' ELSE concat('"', (k + {i}) % 50, '"') END, ',"p":[', CASE WHEN {missing} THEN '' ELSE p END, ']}}')"""
    flag = f"CASE WHEN k % 3 = 0 AND k % 4 = {i} OR k % 89 = 0 AND {i} = 1 THEN 'true' ELSE 'false' END"
    pages = "CASE WHEN k % 79 = 0 THEN '' WHEN k % 101 = 0 THEN p + 1 ELSE p END".replace("p + 1", "CAST(CAST(p AS INT) + 1 AS STRING)")
    return f"""concat('{{"cells":{{"code":{{"s":"extracted","v":"C', k * {i}, '","p":[', p, ']}},"qty":', {qty}, '}},"pages":[', {pages}, '],"continues_previous":false,"continues_next":', {flag}, '}}')"""


_ITEMS = f"""concat('{{"status":"', CASE WHEN k % 83 = 0 THEN 'unresolved' WHEN k % 5 = 0 THEN 'partial' ELSE 'complete' END, '","enumeration_complete":', CASE WHEN k % 5 = 0 THEN 'false' ELSE 'true' END, ',"reason":null,"rows":[',
    CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN {_row(1)} WHEN 2 THEN concat({_row(1)}, ',', {_row(2)}) ELSE concat({_row(1)}, ',', {_row(2)}, ',', {_row(3)}) END, ']}}')"""
_NOTE = """concat('"note":{"s":"extracted","v":"N', c, '","p":[', p, ']}')"""
_EMPTY = """concat('"a":{"status":"unresolved","enumeration_complete":false,"reason":', CASE WHEN k % 19 = 0 THEN '"lost"' WHEN k % 23 = 0 THEN 'null' ELSE '"missing"' END, ',"rows":[]}')"""
#: One text for both engines: replies with the number of their profile and first page, and faults by remainders.
_REPLIES = f"""SELECT k AS reply, profile, CAST(p AS INT) AS page, concat('{{"fields":{{', CASE profile WHEN 0 THEN concat('"total":', {_TOTAL}, ',"day":', {_DAY}, ',"paid":', {_PAID}) ELSE {_NOTE} END,
        '}},"lists":{{', CASE profile WHEN 0 THEN concat('"items":', {_ITEMS}) ELSE {_EMPTY} END, '}},"membership":{{"', p, '":"yes","', CAST(CAST(p AS INT) + 1 AS STRING), '":"', CASE WHEN k % 113 = 0 THEN 'perhaps' WHEN k % 2 = 0 THEN 'unclear' ELSE 'no' END, '"}}',
        CASE WHEN k % 103 = 0 THEN ',"x":1' ELSE '' END, CASE WHEN k % 107 = 0 THEN '}} {{}}' WHEN k % 109 = 0 THEN '' WHEN k % 127 = 0 THEN ',"fields":1}}' ELSE '}}' END) AS text
    FROM (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 9 % 2 AS profile, CAST(1 + o_custkey % 3 AS STRING) AS p FROM {{orders}}) o"""
_DECLARED = [
    (0, None, "total", "number", []), (0, None, "day", "date", ["%d/%m/%Y", "%m/%d/%Y"]), (0, None, "paid", "boolean", []), (0, "items", "code", "text", []), (0, "items", "qty", "number", []),
    (1, None, "note", "text", []), (1, "a", "x", "text", []),
]

# The SQL: cells with their parts, results, lists, and the first code of each reply.
_ORACLE = f"""WITH t AS MATERIALIZED (SELECT *, CASE WHEN reply % 107 = 0 THEN 'trailing_content' WHEN reply % 109 = 0 THEN 'incomplete_json' WHEN reply % 127 = 0 THEN 'duplicate_key' END AS strict FROM ({_REPLIES.replace("{orders}", "orders")}) q),
    ok AS MATERIALIZED (SELECT reply, profile, page, CAST(text AS JSON) AS j FROM t WHERE strict IS NULL),
    declared(profile, list_id, field_id, kind) AS (VALUES {", ".join(f"({p}, {repr(x) if x else 'NULL'}, {f!r}, {k!r})" for p, x, f, k, _ in _DECLARED)}),
    lists AS MATERIALIZED (SELECT reply, page, list_id, json_extract(j, '$.lists.' || list_id) AS l FROM ok JOIN (SELECT DISTINCT profile, list_id FROM declared WHERE list_id IS NOT NULL) d USING (profile)),
    rows AS MATERIALIZED (SELECT reply, page, list_id, i, json_array_length(l, '$.rows') AS n, json_extract(l, '$.rows[' || i || ']') AS r FROM (SELECT *, unnest(range(CAST(json_array_length(l, '$.rows') AS BIGINT))) AS i FROM lists) x),
    raw AS MATERIALIZED (
        SELECT reply, page, CAST(NULL AS VARCHAR) AS list_id, CAST(NULL AS BIGINT) AS i, field_id, kind, json_extract(j, '$.fields.' || field_id) AS c, [page, page + 1] AS within, 'pages_unavailable' AS outside FROM ok JOIN declared USING (profile) WHERE list_id IS NULL
        UNION ALL SELECT reply, page, r.list_id, i, field_id, kind, json_extract(r, '$.cells.' || field_id), CAST(json_extract(r, '$.pages') AS INT[]), 'cell_pages_outside_row' FROM rows r JOIN declared d ON d.list_id = r.list_id),
    parts AS MATERIALIZED (SELECT *, c->>'$.s' AS s, json_type(c, '$.v') AS type, c->>'$.v' AS v, c->'$.p' AS p, list_transform(CAST(c->'$.p' AS DOUBLE[]), lambda x: CAST(x AS INT)) AS pages, CAST(c->'$.p' AS VARCHAR) LIKE '%.%' AS odd,
        CASE kind WHEN 'boolean' THEN CASE WHEN json_type(c, '$.v') = 'BOOLEAN' THEN c->>'$.v' END WHEN 'text' THEN CASE WHEN json_type(c, '$.v') = 'VARCHAR' THEN c->>'$.v' END
            WHEN 'number' THEN CASE WHEN json_type(c, '$.v') = 'VARCHAR' AND regexp_full_match(c->>'$.v', '[+-]?[0-9]+(\\.[0-9]+)?') THEN CAST(CAST(c->>'$.v' AS DOUBLE) AS VARCHAR) END
            ELSE CASE c->>'$.v' WHEN '2024-02-30' THEN '2024-02-30' WHEN '25/12/2024' THEN '2024-12-25' WHEN '2024-1-5' THEN '2024-01-05' END END AS normal FROM raw),
    cells AS MATERIALIZED (SELECT *, CASE WHEN s = 'extracted' AND normal IS NULL THEN 'invalid' ELSE s END AS status, CASE WHEN type <> 'NULL' THEN v END AS held FROM parts),
    results AS MATERIALIZED (SELECT *, CASE WHEN status = 'extracted' AND (kind = 'number' OR normal <> held) THEN CASE WHEN kind = 'number' THEN regexp_replace(normal, '\\.0$', '') ELSE normal END END AS normalized,
        CASE WHEN list_id IS NULL THEN status ELSE s END AS judged FROM cells),
    found AS MATERIALIZED (
        SELECT reply, list_id, c.status AS was, l->>'$.reason' AS reason, CAST(l->>'$.enumeration_complete' AS BOOLEAN) AS whole, CAST(json_array_length(l, '$.rows') AS BIGINT) AS n, a0, r0, a1, r1, changed,
            CASE WHEN changed AND NOT r1 THEN CASE WHEN a1 THEN 'partial' ELSE 'unresolved' END ELSE c.status END AS status, CASE WHEN changed AND NOT r1 THEN CASE WHEN NOT a1 THEN 'invalid' END ELSE l->>'$.reason' END AS new_reason
        FROM (SELECT *, l->>'$.status' AS status FROM lists) c LEFT JOIN (SELECT reply AS r, bool_or(s = 'extracted') AS a0, bool_and(s IN ('extracted', 'missing')) AS r0, bool_or(status = 'extracted') AS a1, bool_and(status IN ('extracted', 'missing')) AS r1,
            bool_or(s <> status OR normalized IS NOT NULL) AS changed FROM results WHERE list_id IS NOT NULL GROUP BY reply) g ON g.r = c.reply),
    judged AS (SELECT *, coalesce(a0, false) AS x0, coalesce(r0, true) AS y0, coalesce(a1, false) AS x1, coalesce(r1, true) AS y1 FROM found),
    twice AS (SELECT reply, list_id, was AS status, reason, whole, x0 AS a, y0 AS r FROM judged UNION ALL SELECT reply, list_id, CASE WHEN coalesce(changed, false) THEN status ELSE was END, CASE WHEN coalesce(changed, false) THEN new_reason ELSE reason END, whole, x1, y1 FROM judged),
    codes AS (
        SELECT reply, 'wire_object_keys' AS code FROM ok WHERE list_sort(json_keys(j)) <> ['fields', 'lists', 'membership']
        UNION ALL SELECT reply, 'wire_value_type' FROM ok WHERE j->>('$.membership.' || (page + 1)) NOT IN ('yes', 'no', 'unclear')
        UNION ALL SELECT reply, unnest([CASE WHEN s NOT IN ('extracted', 'missing', 'unreadable', 'ambiguous', 'invalid') OR type NOT IN ('VARCHAR', 'BOOLEAN', 'NULL') OR odd THEN 'wire_value_type' END,
            CASE WHEN len(list_distinct(pages)) < len(pages) AND NOT odd THEN 'pages_invalid' END, CASE WHEN list_id IS NOT NULL AND s = 'extracted' AND held IS NULL THEN 'raw_required' END,
            CASE WHEN judged NOT IN ('extracted', 'invalid') AND held IS NOT NULL THEN 'raw_forbidden' END, CASE WHEN held IS NOT NULL AND len(pages) = 0 AND NOT odd THEN 'pages_required' END,
            CASE WHEN NOT list_has_all(within, pages) AND NOT odd THEN outside END]) FROM results
        UNION ALL SELECT reply, unnest([CASE WHEN json_array_length(r, '$.pages') = 0 THEN 'pages_required' END, CASE WHEN NOT list_has_all([page, page + 1], CAST(json_extract(r, '$.pages') AS INT[])) THEN 'pages_unavailable' END,
            CASE WHEN CAST(r->>'$.continues_previous' AS BOOLEAN) AND i > 0 OR CAST(r->>'$.continues_next' AS BOOLEAN) AND i < n - 1 THEN 'boundary_flags' END]) FROM rows
        UNION ALL SELECT reply, 'wire_value_type' FROM lists WHERE l->>'$.reason' = 'lost'
        UNION ALL SELECT reply, unnest([CASE WHEN status = 'complete' AND NOT (whole AND r) THEN 'complete_needs_enumeration_and_cells' END, CASE WHEN status = 'partial' AND NOT a THEN 'partial_needs_accepted_cell' END,
            CASE WHEN status = 'unresolved' AND a THEN 'unresolved_has_accepted_cell' END, CASE WHEN status = 'unresolved' AND reason IS NULL THEN 'unresolved_needs_reason' END,
            CASE WHEN status <> 'unresolved' AND reason IS NOT NULL THEN 'reason_forbidden' END, CASE WHEN status = 'partial' AND whole AND r THEN 'partial_is_complete' END]) FROM twice),
    worst AS (SELECT reply, min(list_position({list(replies.CODES)}, code)) AS spot FROM codes WHERE code IS NOT NULL GROUP BY reply),
    told AS MATERIALIZED (SELECT t.reply, coalesce(strict, {list(replies.CODES)}[spot]) AS problem, page FROM t LEFT JOIN worst USING (reply))"""


def _parsed(spark, sf):
    rows = over(spark, sf, _REPLIES, "orders", keys=("o_orderkey",)).withColumn("pages", F.array("page", F.col("page") + 1))
    declared = [(*d, i) for i, d in enumerate(_DECLARED)]
    shapes = replies.profile_shapes(spark.createDataFrame(declared, "profile int, list_id string, field_id string, kind string, formats array<string>, place int"))
    return replies.parsed_batches(rows, shapes, "reply")


@query("parsed_replies", f"{_ORACLE} SELECT reply, problem FROM told")
def parsed_replies(spark, sf):
    return _parsed(spark, sf).select("reply", "problem")


@query("parsed_cells", f"""{_ORACLE} SELECT reply, list_id, CAST(i AS INT) AS row, field_id, status, held AS raw, normalized, array_to_string(pages, ',') AS pages FROM results JOIN told USING (reply) WHERE problem IS NULL""")
def parsed_cells(spark, sf):
    # Values and cells go through one array, and filters stand behind explode_outer: each reply is read once.
    at = lambda x, i, c: F.struct(x.cast("string").alias("list_id"), i.cast("int").alias("row"), c.alias("c"))
    own = F.transform("fields", lambda c: at(F.lit(None), F.lit(None), c))
    rows = F.flatten(F.transform("lists", lambda x: F.flatten(F.transform(x["rows"], lambda r, i: F.transform(r["cells"], lambda c: at(x["field_id"], i, c))))))
    cells = _parsed(spark, sf).select("reply", F.explode_outer(F.concat(own, rows)).alias("x")).where("x IS NOT NULL").select("reply", "x.list_id", "x.row", "x.c")
    return cells.select("reply", "list_id", "row", "c.field_id", "c.status", "c.raw", "c.normalized", F.array_join("c.pages", ",").alias("pages"))


@query("parsed_lists", f"""{_ORACLE} SELECT reply, list_id AS field_id, CASE WHEN coalesce(changed, false) THEN status ELSE was END AS status, CASE WHEN coalesce(changed, false) THEN new_reason ELSE reason END AS reason, whole AS enumeration_complete,
    array_to_string(list_transform(range(n), lambda k: 'batch:' || page || ':row:' || k), ',') AS rows FROM found JOIN told USING (reply) WHERE problem IS NULL""")
def parsed_lists(spark, sf):
    lists = _parsed(spark, sf).select("reply", F.explode_outer("lists").alias("l")).where("l IS NOT NULL")
    return lists.select("reply", "l.field_id", "l.status", "l.reason", "l.enumeration_complete", F.array_join(F.col("l.rows")["source_key"], ",").alias("rows"))


@query("parsed_membership", f"""{_ORACLE}, p AS (SELECT reply, j, unnest([page, page + 1]) AS page FROM ok) SELECT p.reply, p.page, j->>('$.membership.' || p.page) AS status FROM p JOIN told USING (reply) WHERE problem IS NULL""")
def parsed_membership(spark, sf):
    return _parsed(spark, sf).select("reply", F.explode_outer("membership").alias("m")).where("m IS NOT NULL").select("reply", "m.page", "m.status")


_MATCHINGS = """SELECT k AS reply, concat('{"status":', CASE WHEN k % 43 = 0 THEN '1' ELSE concat('"', status, '"') END,
        CASE WHEN k % 7 = 0 AND status <> 'matched' THEN '' ELSE concat(',"profile_index":', CASE WHEN k % 47 = 0 THEN '1.0' WHEN status = 'matched' AND k % 31 <> 0 OR k % 37 = 0 THEN CAST(k % 6 AS STRING) ELSE 'null' END) END,
        ',"type_description":', CASE WHEN k % 11 = 0 THEN '" "' WHEN k % 3 = 0 THEN '"an invoice"' ELSE 'null' END, CASE WHEN k % 41 = 0 THEN ',"note":0' ELSE '' END, CASE WHEN k % 53 = 0 THEN '' ELSE '}' END) AS text
    FROM (SELECT o_orderkey AS k, CASE o_orderkey % 8 WHEN 0 THEN 'no_profile' WHEN 1 THEN 'uncertain' WHEN 2 THEN 'mixed' WHEN 3 THEN 'other' WHEN 4 THEN 'no_profile' ELSE 'matched' END AS status FROM {orders}) o"""


@query("parsed_matching", """WITH r AS (SELECT reply, CASE WHEN reply % 53 <> 0 THEN CAST(text AS JSON) END AS j FROM (""" + _MATCHINGS.replace("{orders}", "orders") + """) q),
    p AS (SELECT reply, j, j->>'$.status' AS status, json_type(j, '$.profile_index') AS type, TRY_CAST(j->>'$.profile_index' AS BIGINT) AS index, trim(coalesce(j->>'$.type_description', '')) AS said FROM r),
    c AS (SELECT reply, status, index, CASE WHEN j IS NULL THEN 'incomplete_json' WHEN NOT list_has_all(['status', 'profile_index', 'type_description'], json_keys(j)) THEN 'wire_object_keys'
        WHEN json_type(j, '$.status') <> 'VARCHAR' OR status = 'other' OR type NOT IN ('NULL', 'UBIGINT') THEN 'wire_value_type' WHEN status = 'matched' AND NOT coalesce(index >= 1, false) THEN 'profile_index_required'
        WHEN status <> 'matched' AND index IS NOT NULL THEN 'profile_index_forbidden' WHEN status = 'no_profile' AND said = '' THEN 'type_description_required' WHEN status = 'matched' AND index > 4 THEN 'profile_index_outside_snapshots' END AS problem FROM p)
    SELECT reply, problem, CASE WHEN problem IS NULL THEN status END AS status, CASE WHEN problem IS NULL THEN reply * 10 + index END AS profile FROM c""")
def parsed_matching(spark, sf):
    rows = over(spark, sf, _MATCHINGS, "orders", keys=("o_orderkey",))
    return replies.parsed_matching(rows.withColumn("snapshots", F.array(*(F.col("reply") * 10 + i for i in range(1, 5)))), "reply")


_FIELD = """concat('{"type":"', CASE WHEN k % 17 = 0 THEN 'money' ELSE 'date' END, '","id":"f', CASE WHEN k % 19 = 0 THEN '","label":""' ELSE '","label":"L"' END, ',"description":"d","validator":',
    CASE k % 4 WHEN 0 THEN 'null' WHEN 1 THEN concat('{"kind":"calendar_date","date_formats":["%d.%m.', CASE WHEN k % 5 = 0 THEN '%y' ELSE '%Y' END, '"]}') WHEN 2 THEN concat('{"kind":"iso_code","allowlist":[', CASE WHEN k % 3 = 0 THEN '' ELSE '"EUR","USD"' END, ']}') ELSE '{"kind":"luhn"}' END, '}')"""
_DRAFTS = f"""SELECT k AS reply, CASE WHEN k % 9 = 0 THEN concat('{{"status":"questions","drafts":[],"questions":["', CASE WHEN k % 2 = 0 THEN ' ' ELSE 'Which one?' END, '"]}}')
        ELSE concat('{{"status":"drafts","drafts":[{{"name":"', b, '","description":"d","scalar_fields":[', CASE WHEN k % 7 = 0 THEN '' ELSE {_FIELD} END, '],"lists":[', CASE WHEN k % 14 = 0 THEN '' WHEN k % 7 = 0 THEN concat('{{"type":"list","id":"l","label":"L","description":"d","columns":[', {_FIELD}, ']}}') ELSE '' END,
            '],"source_index":', CASE k % 5 WHEN 0 THEN 'null' WHEN 1 THEN '0' ELSE CAST(k % 5 AS STRING) END, '}}],"questions":[', CASE WHEN k % 23 = 0 THEN '"?"' ELSE '' END, ']}}') END AS text
    FROM (SELECT p_partkey AS k, p_brand AS b FROM {{part}}) p"""


@query("draft_replies", """SELECT k AS reply, status, CASE WHEN status = 'drafts' THEN b END AS name, CASE WHEN status = 'drafts' AND k % 5 > 0 THEN k % 5 END AS source_index, CASE WHEN status = 'drafts' THEN CAST(k % 7 > 0 AS INT) END AS scalars,
    CASE WHEN status = 'drafts' THEN CAST(k % 7 = 0 AS INT) END AS lists, CASE WHEN status = 'questions' THEN 'Which one?' END AS questions
    FROM (SELECT p_partkey AS k, p_brand AS b, CASE WHEN p_partkey % 9 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'refused' ELSE 'questions' END
        WHEN p_partkey % 17 = 0 AND p_partkey % 14 <> 0 OR p_partkey % 19 = 0 AND p_partkey % 14 <> 0 OR p_partkey % 14 = 0 OR p_partkey % 5 = 1 OR p_partkey % 23 = 0 OR (p_partkey % 20 = 5) OR (p_partkey % 12 = 6) THEN 'refused' ELSE 'drafts' END AS status FROM part) p""")
def draft_replies(spark, sf):
    found = replies.draft_replies(over(spark, sf, _DRAFTS, "part", keys=("p_partkey",)), "reply").withColumn("d", F.try_element_at("drafts", F.lit(1)))
    return found.select("reply", "status", "d.name", "d.source_index", "d.scalars", "d.lists", F.nullif(F.array_join("questions", "|"), F.lit("")).alias("questions"))
