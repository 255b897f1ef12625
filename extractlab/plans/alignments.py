"""Whole lists against their truth: aligned rows, and the report with every counter fed by them.

The SQL takes the weight of every pair of rows of a list, fills the table of best sums row by row and walks through it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from extractlab.operators import alignment, report, structure
from extractlab.plans.registry import query
from extractlab.plans.reports import _ALL, _FLAGS, _RATES, _SUMS, _dialect
from extractlab.sources.adapters import LINES, shares, table

_FIELDS = "(SELECT 'flag' AS field_id UNION ALL SELECT 'status' UNION ALL SELECT 'qty')"
_LINES = "SELECT l_orderkey AS o, l_linenumber AS l, l_returnflag AS flag, l_linestatus AS status, CAST(CAST(l_quantity AS INT) AS STRING) AS qty, l_orderkey + l_linenumber AS k, l_partkey * 100000 + l_suppkey AS u FROM lineitem"
_CELL = "CASE field_id WHEN 'flag' THEN flag WHEN 'status' THEN status ELSE qty END"
#: The truth's lists (every 31st case has none), and what was read: cells that are wrong, missing or ambiguous, blank rows, cells left out, a line read twice.
_EXPECTED = f"""(SELECT case_id, 'items' AS list_id, ix, field_id, truth_status, CASE WHEN truth_status = 'extracted' THEN CASE WHEN case_id % 13 = 0 THEN ARRAY_OF(v, 'X') ELSE ARRAY_OF(v) END END AS truth_values,
        truth_row_pages AS truth_pages, truth_row_pages, truth_status = 'extracted' AS present
    FROM (SELECT o AS case_id, ix, field_id, {_CELL} AS v, CASE WHEN field_id = 'qty' AND k % 6 = 0 OR field_id = 'flag' AND k % 16 = 0 THEN 'missing' ELSE 'extracted' END AS truth_status, CASE WHEN o % 29 = 0 THEN ARRAY_OF(1) ELSE ARRAY_OF(1, 2) END AS truth_row_pages
        FROM (SELECT *, CAST(row_number() OVER (PARTITION BY o ORDER BY l, u, qty) - 1 AS INT) AS ix FROM ({_LINES}) x WHERE l % 5 <> 4 AND o % 31 <> 0 AND o % 47 <> 0) n CROSS JOIN {_FIELDS} f) c)"""
_ACTUAL = f"""(SELECT case_id, 'items' AS list_id, pos, field_id, status, CASE WHEN status = 'extracted' THEN v END AS value, row_pages AS pages, row_pages
    FROM (SELECT o AS case_id, pos, field_id, CASE WHEN field_id = 'flag' AND k % 9 = 0 THEN 'X' ELSE {_CELL} END AS v,
            CASE WHEN k % 8 = 0 THEN CASE field_id WHEN 'status' THEN 'unreadable' ELSE 'missing' END WHEN field_id = 'qty' AND k % 6 = 0 OR field_id = 'flag' AND k % 6 = 1 THEN 'missing' WHEN field_id = 'qty' AND k % 11 = 0 THEN 'ambiguous' ELSE 'extracted' END AS status,
            CASE WHEN k % 5 = 0 THEN ARRAY_OF(2) ELSE ARRAY_OF(1) END AS row_pages
        FROM (SELECT *, CAST(row_number() OVER (PARTITION BY o ORDER BY l + again, u, qty) - 1 AS INT) AS pos FROM (
            SELECT x.*, again FROM ({_LINES}) x CROSS JOIN (SELECT 0 AS again UNION ALL SELECT 50) a WHERE l % 7 <> 3 AND (again = 0 OR o % 10 = 0 AND l = 1)) y WHERE o % 43 <> 0) n CROSS JOIN {_FIELDS} f
        WHERE NOT (field_id = 'qty' AND k % 41 = 0)) c)"""
_CASES = """(SELECT o_orderkey AS case_id, o_orderstatus AS script, o_orderstatus || substr(o_orderpriority, 1, 1) AS language, o_orderpriority AS category, CASE WHEN o_custkey % 3 < 2 THEN 'readable' ELSE 'difficult' END AS quality,
      CASE WHEN o_orderkey % 3 = 0 THEN 'pdf' ELSE 'photo' END AS delivery_path, CASE WHEN o_orderkey % 17 = 0 THEN 'timeout' WHEN o_orderkey % 41 = 0 THEN 'failed' WHEN o_orderkey % 53 = 0 THEN 'input_refused' ELSE 'completed' END AS execution_state,
      CASE WHEN o_orderkey % 10 < 9 THEN 'matched' ELSE 'no_profile' END AS expected_matching, CASE WHEN o_orderkey % 11 < 10 THEN 'matched' ELSE 'uncertain' END AS actual_matching, o_custkey % 3 AS expected_profile,
      CASE WHEN o_orderkey % 37 = 0 THEN 7 ELSE o_custkey % 3 END AS selected_profile, o_orderkey % 6 <> 5 AS automatic, o_orderkey % 39 <> 0 AS consistent, CASE WHEN o_orderkey % 4 = 0 THEN 'partial' ELSE 'complete' END AS expected_outcome,
      CASE WHEN o_orderkey % 5 = 0 THEN 'partial' ELSE 'complete' END AS actual_outcome, o_orderkey % 23 <> 0 AS recognised FROM orders)"""
_SCALARS = """(SELECT o_orderkey AS case_id, 'scalar' AS kind, 'total' AS identity, 0 AS pos, CASE WHEN o_orderkey % 7 = 0 THEN 'missing' ELSE 'extracted' END AS status, CASE WHEN o_orderkey % 7 <> 0 THEN CASE WHEN o_orderkey % 12 = 0 THEN 'x' ELSE o_orderpriority END END AS value, ARRAY_OF(1) AS pages,
      'extracted' AS truth_status, o_orderpriority AS truth_value, ARRAY_OF(o_orderpriority) AS allowed, ARRAY_OF(1) AS truth_pages, true AS present FROM orders)"""
_LISTS = """(SELECT o_orderkey AS case_id, 'items' AS list_id, CASE WHEN o_orderkey % 4 = 1 THEN 'partial' ELSE 'complete' END AS status, o_orderkey % 31 <> 0 AS wanted, CASE WHEN o_orderkey % 31 <> 0 THEN CASE WHEN o_orderkey % 33 = 0 THEN 'partial' ELSE 'complete' END END AS expected_status FROM orders)"""
_OF_CASE = """(SELECT o_orderkey AS case_id, ARRAY_OF('total') AS wanted, CASE WHEN o_orderkey % 59 = 0 THEN ARRAY_OF('total', 'total') ELSE ARRAY_OF('total') END AS given, false AS row FROM orders
    UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 31 <> 0 THEN ARRAY_OF('items') ELSE ARRAY_OF('other') END, ARRAY_OF('items'), false FROM orders)"""
_INSIDE = "len(list_filter({}, lambda p: NOT list_contains({}, p))) = 0"
_PAIRED = f"""expected AS MATERIALIZED (SELECT * FROM {_dialect(_EXPECTED, False)} e), actual AS MATERIALIZED (SELECT * FROM {_dialect(_ACTUAL, False)} a),
    scores AS (SELECT a.case_id, pos, ix, count(*) FILTER (WHERE status = 'extracted' AND truth_status = 'extracted' AND list_contains(truth_values, value) AND {_INSIDE.format('pages', 'truth_pages')}) AS c, count(*) FILTER (WHERE status = 'missing' AND truth_status = 'missing') AS m
        FROM actual a JOIN expected e ON a.case_id = e.case_id AND a.field_id = e.field_id WHERE {_INSIDE.format('row_pages', 'truth_row_pages')} GROUP BY ALL),
    held AS (SELECT case_id, pos, bool_or(status = 'extracted') AS taken FROM actual GROUP BY ALL),
    weights AS (SELECT case_id, pos, ix, c * 10000 + m * 100 + 1 AS w FROM scores JOIN held USING (case_id, pos) WHERE c > 0 OR m > 0 AND NOT taken),
    sizes AS (SELECT * FROM (SELECT case_id, max(pos) + 1 AS n FROM actual GROUP BY 1) x JOIN (SELECT case_id, max(ix) + 1 AS m FROM expected GROUP BY 1) y USING (case_id)),
    grid AS (SELECT case_id, n, m, pos, list(w ORDER BY ix) AS w FROM (SELECT s.case_id, s.n, s.m, s.pos, s.ix, weights.w FROM (SELECT *, unnest(range(m)) AS ix FROM (SELECT *, unnest(range(n)) AS pos FROM sizes) p) s
        LEFT JOIN weights ON weights.case_id = s.case_id AND weights.pos = s.pos AND weights.ix = s.ix) z GROUP BY ALL),
    tables AS MATERIALIZED (SELECT case_id, n, m, list(w ORDER BY pos) AS w FROM grid GROUP BY ALL),
    best AS (SELECT case_id, n, m, w, CAST(n AS BIGINT) AS i, [list_transform(range(m + 1), lambda j: CAST(0 AS BIGINT))] AS b FROM tables
        UNION ALL SELECT case_id, n, m, w, i - 1, list_prepend(list_append(list_transform(range(1, m + 1), lambda j: list_max(c[j:])), 0), b)
        FROM (SELECT *, list_transform(range(1, m + 1), lambda j: greatest(b[1][j], coalesce(w[i][j] + b[1][j + 1], 0))) AS c FROM best WHERE i > 0) t),
    walk AS (SELECT case_id, n, m, b, w, CAST(1 AS BIGINT) AS i, CAST(1 AS BIGINT) AS j, CAST(NULL AS BIGINT) AS pos, CAST(NULL AS BIGINT) AS ix FROM best WHERE i = 0
        UNION ALL SELECT case_id, n, m, b, w, CASE WHEN pair OR up THEN i + 1 ELSE i END, CASE WHEN pair OR NOT up THEN j + 1 ELSE j END, CASE WHEN pair THEN i - 1 END, CASE WHEN pair THEN j - 1 END
        FROM (SELECT *, coalesce(b[i][j] = w[i][j] + b[i + 1][j + 1], false) AS pair, b[i][j] = b[i + 1][j] AS up FROM walk WHERE i <= n AND j <= m) s),
    pairs AS MATERIALIZED (SELECT case_id, pos, ix FROM walk WHERE pos IS NOT NULL)"""


def _read(spark, sf):
    """What reads a text over lines and orders, and how many tasks these are dealt out over by order: nothing that has the case among its keys is shuffled after that."""
    lines = table(spark, sf, "lineitem")
    tasks = shares(lines, LINES)
    tables = {"orders": table(spark, sf, "orders").repartition(tasks, "o_orderkey"), "lineitem": lines.repartition(tasks, "l_orderkey")}

    def read(sql: str):
        sql = _dialect(sql, True)
        for t in tables:
            sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
        # The case gets a name without a table's: unions keep how their parts are dealt out only by such.
        return spark.sql(f"SELECT * FROM {sql} x", **tables).withColumnRenamed("case_id", "_case").withColumnRenamed("_case", "case_id")

    return read, tasks


def _weights(actual, expected):
    return alignment.weighed(alignment.actual_rows(actual), alignment.expected_rows(expected))


@query("align_rows", f"WITH RECURSIVE {_PAIRED} SELECT case_id, 'items' AS list_id, CAST(pos AS INT) AS actual, CAST(ix AS INT) AS expected FROM pairs")
def align_rows(spark, sf):
    read, _ = _read(spark, sf)
    return alignment.align_rows(_weights(read(_ACTUAL), read(_EXPECTED)), list(alignment.LIST))


def _counts(spark, sf):
    read, tasks = _read(spark, sf)
    return _counted(*(read(t) for t in (_CASES, _SCALARS, _OF_CASE, _LISTS, _ACTUAL, _EXPECTED)), tasks, ("flag", "qty", "status"))


def _counted(cases, scalars, shapes, lists, actual, expected, tasks, fields):
    """All counters of each case, of tables that are dealt out by case over so many tasks; a row of a list has these fields."""
    under = cases.withColumns(report.context_columns()).select("case_id", "known", "context")
    # Without the right profile nothing is aligned.
    weights = _weights(actual, expected).join(under.where("context").select("case_id"), "case_id")
    pairs = alignment.align_rows(weights, list(alignment.LIST)).repartition(tasks, "case_id")
    counts = report.cell_counts(F.array(*(F.lit(c) for c in fields)))
    by_list = alignment.matched_rows(actual, expected, pairs).select(*alignment.LIST, *(c.alias(k) for k, c in counts.items())).groupBy(*alignment.LIST).agg(*(F.sum(k).alias(k) for k in counts))
    # Lists with the numbers of their rows; of a list that was not given, the cells count all the same.
    told = lists.withColumn("_told", F.lit(True)).unionByName(by_list, allowMissingColumns=True)
    whole = told.groupBy(*alignment.LIST).agg(*(F.max(c).alias(c) for c in ("_told", "status", "wanted", "expected_status", *counts)))
    whole = whole.withColumn("expected_rows", F.when(F.col("wanted"), F.coalesce("_expected", F.lit(0)))).join(under, "case_id")
    judged = {k: F.when(F.col("_told"), c).otherwise(0) for k, c in structure.judgement().items()}
    of_cases = whole.groupBy("case_id").agg(*(F.sum(c).alias(k) for k, c in judged.items()), *(F.sum(c).alias(c) for c in report.CELL_SUMS))
    return report.counted(cases, scalars, shapes, of_cases)


_OWN = {k: x for k, x in _SUMS.items() if k not in ("readable_present_values", "known_readable_values") and "known_values" not in k.replace("known_values_recovered", "") and not k.endswith("readable_present_values")}
_TRUE = {k: x for k, x in _SUMS.items() if k not in _OWN}
_LISTED = f"""{_PAIRED}, c AS MATERIALIZED (SELECT *, execution_state = 'completed' AND automatic AND actual_matching = 'matched' AS auto, execution_state = 'completed' AND recognised AS known,
        execution_state = 'completed' AND (NOT automatic OR actual_matching = 'matched') AND consistent AND expected_matching = 'matched' AND selected_profile = expected_profile AS ctx, quality = 'readable' AS readable FROM {_dialect(_CASES, False)} x),
    p AS MATERIALIZED (SELECT pairs.* FROM pairs JOIN c USING (case_id) WHERE ctx),
    own AS (SELECT case_id, kind, status, value, pages, truth_status, allowed, truth_pages, present FROM {_dialect(_SCALARS, False)} s
        UNION ALL SELECT a.case_id, 'list_cell', status, value, pages, truth_status, truth_values, truth_pages, coalesce(present, false) FROM actual a LEFT JOIN p ON p.case_id = a.case_id AND p.pos = a.pos LEFT JOIN expected e ON e.case_id = a.case_id AND e.ix = p.ix AND e.field_id = a.field_id),
    f AS (SELECT own.*, known, ctx, readable, known AND status = 'extracted' AS taken, coalesce(known AND ctx AND status = 'extracted' AND truth_status = 'extracted' AND list_contains(allowed, value) AND {_INSIDE.format('pages', 'truth_pages')}, false) AS ok FROM own JOIN c USING (case_id)),
    s AS (SELECT case_id, {", ".join(f"count(*) FILTER (WHERE {x}) AS {k}" for k, x in _OWN.items())} FROM f GROUP BY case_id),
    g AS (SELECT t.*, readable FROM (SELECT case_id, kind, truth_status, present FROM {_dialect(_SCALARS, False)} s UNION ALL SELECT case_id, 'list_cell', truth_status, present FROM expected) t JOIN c USING (case_id)),
    d AS (SELECT case_id, {", ".join(f"count(*) FILTER (WHERE {x}) AS {k}" for k, x in _TRUE.items())} FROM g GROUP BY case_id),
    r AS MATERIALIZED (SELECT a.case_id, a.pos, bool_or(status = 'extracted') AS taken, any_value(row_pages) AS pages, list(field_id) AS ids, list(field_id) FILTER (WHERE status = 'missing') AS absent, any_value(p.ix) AS ix FROM actual a LEFT JOIN p ON p.case_id = a.case_id AND p.pos = a.pos GROUP BY ALL),
    blank AS (SELECT *, lo + row_number() OVER (PARTITION BY case_id, lo ORDER BY pos) AS spot FROM (SELECT r.case_id, r.pos, r.pages, r.absent, coalesce(max(q.ix) FILTER (WHERE q.pos < r.pos), -1) AS lo, min(q.ix) FILTER (WHERE q.pos > r.pos) AS hi
        FROM r LEFT JOIN p q ON q.case_id = r.case_id WHERE r.ix IS NULL AND NOT r.taken GROUP BY ALL) u),
    claims AS (SELECT b.case_id, count(*) AS n FROM blank b JOIN expected e ON e.case_id = b.case_id AND e.ix = b.spot WHERE (hi IS NULL OR spot < hi) AND list_contains(absent, e.field_id) AND e.present AND {_INSIDE.format('b.pages', 'e.truth_row_pages')} GROUP BY b.case_id),
    n AS (SELECT case_id, count(*) AS n, count(*) FILTER (WHERE ix IS NULL) AS extra, count(*) FILTER (WHERE ix IS NULL AND taken) AS bad, count(*) FILTER (WHERE len(ids) < 3) AS short FROM r GROUP BY case_id),
    t AS (SELECT l.case_id, CASE WHEN NOT wanted OR coalesce(bad, 0) > 0 OR status = 'complete' AND NOT (coalesce(extra, 0) = 0 AND coalesce(n.n, 0) = coalesce(e.n, 0) AND expected_status = 'complete') THEN 1 ELSE 0 END AS wrong,
            CASE WHEN wanted AND coalesce(e.n, 0) = 0 AND expected_status = 'complete' AND status = 'complete' AND coalesce(n.n, 0) = 0 THEN 1 ELSE 0 END AS empty, coalesce(short, 0) + CASE WHEN l.case_id % 59 = 0 THEN 1 ELSE 0 END + CASE WHEN wanted THEN 0 ELSE 1 END AS odd
        FROM {_dialect(_LISTS, False)} l LEFT JOIN n ON n.case_id = l.case_id LEFT JOIN (SELECT case_id, count(DISTINCT ix) AS n FROM expected GROUP BY case_id) e ON e.case_id = l.case_id),
    counts AS MATERIALIZED (SELECT c.case_id, script, language, category, quality, delivery_path, {", ".join(f"CAST({x} AS BIGINT) AS {k}" for k, x in _FLAGS.items())},
        {", ".join(f"coalesce({k}, 0) AS {k}" if k != "false_missing_values" else "coalesce(false_missing_values, 0) + CASE WHEN known AND ctx THEN coalesce(claims.n, 0) ELSE 0 END AS false_missing_values" for k in _SUMS)},
        CASE WHEN known THEN odd ELSE 0 END AS schema_errors, CASE WHEN known THEN wrong ELSE 0 END AS list_structure_errors, CASE WHEN known AND ctx THEN empty ELSE 0 END AS confirmed_empty_lists
        FROM c LEFT JOIN s USING (case_id) LEFT JOIN d USING (case_id) LEFT JOIN t USING (case_id) LEFT JOIN claims USING (case_id))"""


@query("list_counts", f"WITH RECURSIVE {_LISTED} SELECT * FROM counts")
def list_counts(spark, sf):
    return _counts(spark, sf)


@query("list_report", f"WITH RECURSIVE {_LISTED} " + " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, {label} AS label, {_ALL}, {_RATES} FROM counts GROUP BY 1, 2" for d, label in [("total", "'all'"), *((d, d) for d in report.DIMENSIONS)]))
def list_report(spark, sf):
    return report.report(_counts(spark, sf))
