"""Typed documents derived from the tables: canonical bytes of nested values, and review decisions held against their shape."""

from __future__ import annotations

from pyspark.sql import functions as F

from extractlab.functions.canonical import canonical_json
from extractlab.plans.registry import query
from extractlab.sources import typed
from extractlab.sources.adapters import over

_FLAG = "CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END"
_NESTED = f"""SELECT k, concat('{{ "z" : [', c, ', {{"b":"é', s, '\\u0041", "a":', c * 3, '.50}}], ', CASE WHEN k % 11 = 0 THEN '"a":1, ' WHEN k % 13 = 0 THEN '"n":NaN, ' ELSE '' END, '"a" : {{"y":null,"x":', {_FLAG}, '}}', CASE WHEN k % 17 = 0 THEN '' ELSE '}}' END) AS text
    FROM (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s FROM {{orders}}) o"""


@query("canonical_values", f"""SELECT k, CASE WHEN k % 17 = 0 AND k % 13 <> 0 AND k % 11 <> 0 THEN 'invalid_json' WHEN k % 17 = 0 THEN CASE WHEN k % 11 = 0 THEN 'invalid_json' ELSE 'non_finite_number' END
        WHEN k % 11 = 0 THEN 'duplicate_key' WHEN k % 13 = 0 THEN 'non_finite_number' END AS problem,
        CASE WHEN k % 11 <> 0 AND k % 13 <> 0 AND k % 17 <> 0 THEN sha256('{{"a":{{"x":' || {_FLAG} || ',"y":null}},"z":[' || c || ',{{"a":' || (c * 3) || '.5,"b":"é' || s || 'A"}}]}}') END AS sha256
    FROM (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s FROM orders) o""")
def canonical_values(spark, sf):
    rows = over(spark, sf, _NESTED, "orders", keys=("o_orderkey",)).select("k", canonical_json(F.col("text")).alias("c"))
    return rows.select("k", "c.problem", F.sha2("c.text", 256).alias("sha256"))


# A decision file of each order: one or two cases, and faults by remainders.
_VALUE = """concat('{"field_id":"f', CASE WHEN k % 3 = 0 THEN '","row_key":"r1"' ELSE '"' END, CASE WHEN k % 3 = 0 AND k % 19 <> 0 THEN ',"column_id":"c"' ELSE '' END, ',"visibility":"', CASE WHEN k % 23 = 0 THEN 'seen' WHEN k % 2 = 0 THEN 'legible' ELSE 'not_legible' END, '"}')"""
_DECISION = f"""concat('{{"case_id":"', CASE WHEN k % 29 = 0 THEN '' ELSE CAST(k AS STRING) END, '","decision":"', CASE WHEN k % 5 = 0 THEN 'rejected' ELSE 'verified' END, '","method":', CASE WHEN k % 5 = 0 THEN 'null' ELSE '"script_reading"' END, ',"values":[', CASE WHEN k % 4 = 0 THEN '' ELSE {_VALUE} END, ']}}')"""
_FILES = f"""SELECT k, concat('{{"schema_version":', CASE WHEN k % 31 = 0 THEN '2' ELSE '1' END, ',"manifest_sha256":"', CASE WHEN k % 37 = 0 THEN 'abc' ELSE sha2(CAST(k AS STRING), 256) END, '","reviewer":"r","reviewer_attests_human_inspection":', CASE WHEN k % 41 = 0 THEN '1' ELSE 'true' END,
        ',"reviewed_at":"2024-05-06T07:08:09', CASE WHEN k % 43 = 0 THEN '' ELSE 'Z' END, '","cases":[', {_DECISION}, CASE WHEN k % 7 = 0 THEN concat(',', {_DECISION}) ELSE '' END, ']', CASE WHEN k % 47 = 0 THEN ',"x":0}}' ELSE '}}' END) AS text FROM (SELECT o_orderkey AS k FROM {{orders}}) o"""
_BAD = "k % 31 = 0 OR k % 37 = 0 OR k % 41 = 0 OR k % 43 = 0 OR k % 47 = 0 OR k % 29 = 0 OR k % 4 <> 0 AND (k % 23 = 0 OR k % 57 = 0)"


def _decisions(spark, sf):
    return typed.typed(over(spark, sf, _FILES, "orders", keys=("o_orderkey",)), "text", typed.DECISIONS)


@query("decision_files", f"SELECT k, CASE WHEN {_BAD} THEN 'other_shape' END AS problem FROM (SELECT o_orderkey AS k FROM orders) o")
def decision_files(spark, sf):
    return _decisions(spark, sf).select("k", "problem")


@query("decided_values", f"""SELECT CAST(k AS VARCHAR) AS case_id, CASE WHEN k % 5 = 0 THEN 'rejected' ELSE 'verified' END AS decision, CASE WHEN k % 5 <> 0 THEN 'script_reading' END AS method, CASE WHEN k % 4 <> 0 THEN 'f' END AS field_id,
    CASE WHEN k % 4 <> 0 AND k % 3 = 0 THEN 'r1' END AS row_key, CASE WHEN k % 4 <> 0 AND k % 3 = 0 THEN 'c' END AS column_id, CASE WHEN k % 4 <> 0 THEN CASE WHEN k % 2 = 0 THEN 'legible' ELSE 'not_legible' END END AS visibility
    FROM (SELECT o_orderkey AS k FROM orders) o JOIN (SELECT 0 AS n UNION ALL SELECT 1) c ON n = 0 OR k % 7 = 0 WHERE NOT ({_BAD})""")
def decided_values(spark, sf):
    return typed.decided_values(_decisions(spark, sf))
