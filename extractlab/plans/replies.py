"""Model replies: strict JSON with positions, tokens and their log-probabilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from extractlab.functions import strict
from extractlab.plans.registry import query
from extractlab.sources.adapters import table

# A reply by document: {"id":7,"kind":"é…","pages":[1,22],"of":{"lang":"en"}}, and some that are not strict JSON.
_PARTS = ("'{\"id\":'", "CAST(doc_id AS STRING)", "',\"kind\":'", "concat('\"é', source, '\"')", "',\"pages\":'", "concat('[', CAST(doc_id % 7 AS STRING), ', 22]')", "',\"of\":'", "concat('{\"lang\":\"', lang, '\"}')", "'}'")
_BROKEN = {1: "',\"id\":1}'", 2: "'} {}'", 3: "',\"x\":NaN}'", 4: "',\"x\":[1,]}'", 5: "''"}


@query("reply_spans", """WITH r AS (SELECT doc_id, doc_id % 9 AS k, strlen(CAST(doc_id AS VARCHAR)) AS n, strlen(source) + 4 AS s, strlen(lang) AS l FROM documents),
    p AS (SELECT *, 6 AS a, 14 + n AS b, 14 + n + s + 9 AS c FROM r WHERE k NOT IN (1, 2, 3, 4, 5)), q AS (SELECT *, c + 13 AS d FROM p)
    SELECT doc_id, CASE k WHEN 1 THEN 'duplicate_key' WHEN 2 THEN 'trailing_content' WHEN 5 THEN 'incomplete_json' ELSE 'invalid_json' END AS problem, NULL AS pointer, NULL AS "left", NULL AS "right" FROM r WHERE k IN (1, 2, 3, 4, 5)
    UNION ALL SELECT doc_id, NULL, '/id', a, a + n FROM q UNION ALL SELECT doc_id, NULL, '/kind', b, b + s FROM q
    UNION ALL SELECT doc_id, NULL, '/pages', c, c + 7 FROM q UNION ALL SELECT doc_id, NULL, '/pages/0', c + 1, c + 2 FROM q UNION ALL SELECT doc_id, NULL, '/pages/1', c + 4, c + 6 FROM q
    UNION ALL SELECT doc_id, NULL, '/of', d, d + l + 11 FROM q UNION ALL SELECT doc_id, NULL, '/of/lang', d + 8, d + l + 10 FROM q UNION ALL SELECT doc_id, NULL, '', 0, d + l + 12 FROM q""")
def reply_spans(spark, sf):
    ending = F.expr("CASE doc_id % 9 " + " ".join(f"WHEN {k} THEN {e}" for k, e in _BROKEN.items()) + " ELSE '}' END")
    reply = F.concat(*(F.expr(p) for p in _PARTS[:-1]), ending)
    read = table(spark, sf, "documents").select("doc_id", strict.strict_json(reply).alias("r")).select("doc_id", "r.problem", F.explode_outer("r.spans").alias("s"))
    return read.select("doc_id", "problem", "s.pointer", "s.left", "s.right")


# What a JSON string must escape, the backslash first.
_ESCAPES = [(92, "\\\\"), (34, '\\"'), *((c, f"\\u{c:04x}") for c in range(1, 32))]


def _quoted() -> str:
    sql = "text"
    for code, escaped in _ESCAPES:
        sql = f"replace({sql}, chr({code}), '{escaped}')"
    return sql


@query("strict_texts", f"SELECT doc_id, CASE WHEN text IS NULL THEN 'no_text' END AS problem, 2 + strlen({_quoted()}) AS bytes FROM documents")
def strict_texts(spark, sf):
    """Whole texts as JSON strings."""
    quoted = F.col("text")
    for code, escaped in _ESCAPES:
        quoted = F.replace(quoted, F.lit(chr(code)), F.lit(escaped))
    read = table(spark, sf, "documents").select("doc_id", strict.strict_json(F.concat(F.lit('"'), quoted, F.lit('"'))).alias("r"))
    return read.select("doc_id", "r.problem", F.try_element_at("r.spans", F.lit(1))["right"].alias("bytes"))


@query("token_bytes", """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN lower(hex(chr(CAST(65 + doc_id % 26 AS INT)) || 'z')) ELSE lower(hex(lang || 'é')) END AS bytes FROM documents""")
def token_bytes(spark, sf):
    # Listed bytes; of other tokens none, or some that are no bytes.
    data = F.expr("CASE WHEN doc_id % 4 = 0 THEN array(CAST(65 + doc_id % 26 AS INT), 122) WHEN doc_id % 4 = 1 THEN array(256) WHEN doc_id % 4 = 2 THEN array(CAST(NULL AS INT)) END")
    return table(spark, sf, "documents").select("doc_id", F.lower(F.hex(strict.token_bytes(F.concat("lang", F.lit("é")), data))).alias("bytes"))


@query("log_probabilities", "SELECT event_id, CASE WHEN event_id % 5 <> 0 AND event_id % 7 <> 0 AND value <= 0 THEN value END AS logprob FROM (SELECT event_id, 60 - value AS value FROM events) e")
def log_probabilities(spark, sf):
    value = F.expr("CASE WHEN event_id % 5 = 0 THEN double('NaN') WHEN event_id % 7 = 0 THEN double('-Infinity') ELSE 60 - value END")
    return table(spark, sf, "events").select("event_id", strict.log_probability(value).alias("logprob"))


@query("exact_keys", "SELECT doc_id, doc_id % 4 = 0 AS fits FROM documents")
def exact_keys(spark, sf):
    reply = F.expr("""CASE doc_id % 4 WHEN 0 THEN '{"v":1,"s":"extracted","p":[1]}' WHEN 1 THEN '{"v":1,"s":"missing"}' WHEN 2 THEN '{"v":1,"s":"missing","p":[],"x":0}' ELSE '[1]' END""")
    return table(spark, sf, "documents").select("doc_id", strict.exact_keys(F.json_object_keys(reply), ["s", "v", "p"]).alias("fits"))
