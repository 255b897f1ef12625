"""Ordered folds, limits and replay over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from extractlab.functions.scalar import utf16_length
from extractlab.operators import flow, ordered, rules
from extractlab.plans.registry import query
from extractlab.sources.adapters import adapter, table

_PACKED = """WITH RECURSIVE p AS ({rows}), r AS (SELECT job, pos, cost, CASE WHEN cost <= {cap} THEN cost END AS used, 1 AS pack FROM p WHERE pos = 1 UNION ALL
    SELECT p.job, p.pos, p.cost, CASE WHEN r.used + {joint} + p.cost <= {cap} THEN r.used + {joint} + p.cost WHEN p.cost <= {cap} THEN p.cost END, CASE WHEN r.used + {joint} + p.cost <= {cap} THEN r.pack ELSE r.pack + 1 END
    FROM r JOIN p ON p.job = r.job AND p.pos = r.pos + 1) SELECT job, pos, pack, CAST(used AS BIGINT) AS used FROM r"""


@query("pack_pages", _PACKED.replace("{rows}", "SELECT job, batch AS pos, 1 + mille % 13 AS cost FROM {readings} t").replace("{cap}", "12").replace("{joint}", "0"))
def pack_pages(spark, sf):
    pages = adapter(spark, sf, "readings").selectExpr("job", "batch AS pos", "1 + mille % 13 AS cost")
    return ordered.pack_greedily(pages, "job", "pos", "cost", 12)


@query("pack_messages", _PACKED.replace("{rows}", "SELECT conv_id AS job, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS pos, CAST(length(text) AS BIGINT) AS cost FROM conversations").replace("{cap}", "4000").replace("{joint}", "1"))
def pack_messages(spark, sf):
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    units = table(spark, sf, "conversations").select(F.col("conv_id").alias("job"), pos.alias("pos"), utf16_length(F.col("text")).alias("cost"))
    return ordered.pack_greedily(units, "job", "pos", "cost", 4000, 1)


@query("throttled_reminders", """WITH RECURSIVE e AS (SELECT owner, t, event_id FROM {updates} u WHERE kind = 'view'),
    r AS (SELECT owner, min(t) AS t FROM e GROUP BY owner UNION ALL SELECT r.owner, (SELECT min(t) FROM e WHERE e.owner = r.owner AND e.t >= r.t + 86400) FROM r WHERE (SELECT min(t) FROM e WHERE e.owner = r.owner AND e.t >= r.t + 86400) IS NOT NULL)
    SELECT e.owner, e.t, min(e.event_id) AS event_id FROM e JOIN r ON e.owner = r.owner AND e.t = r.t GROUP BY 1, 2""")
def throttled_reminders(spark, sf):
    return ordered.throttled(adapter(spark, sf, "updates").where("kind = 'view'"), "owner", "t", "event_id", 86_400)


@query("global_surge", "SELECT t, n, CAST(sum(n) OVER (ORDER BY t RANGE BETWEEN 899 PRECEDING AND CURRENT ROW) AS BIGINT) AS recent FROM (SELECT t, count(*) AS n FROM {updates} u WHERE kind = 'error' GROUP BY t) c")
def global_surge(spark, sf):
    return flow.busy_seconds(adapter(spark, sf, "updates").where("kind = 'error'"), "t", flow.LOCK_WINDOW)


@query("seen_retention", "SELECT owner, event_id FROM (SELECT owner, event_id, count(*) OVER (PARTITION BY owner) AS s, row_number() OVER (PARTITION BY owner ORDER BY event_id DESC) AS r FROM {updates} u) x WHERE s <= 60 OR r <= 30")
def seen_retention(spark, sf):
    return flow.retained(adapter(spark, sf, "updates").select("owner", "event_id"), "owner", "event_id", 60, 30)


@query("replay_states", """SELECT case_id, budget, CASE WHEN late IS NOT NULL AND (mixed IS NULL OR late <= mixed) THEN 'timeout' WHEN mixed IS NOT NULL THEN 'mixed' ELSE 'complete' END AS state FROM (
    SELECT case_id, budget, min(CASE WHEN spent > budget THEN call_id END) AS late, min(CASE WHEN call_id % 83 = 0 THEN call_id END) AS mixed
    FROM (SELECT *, sum(centis) OVER (PARTITION BY case_id ORDER BY call_id) AS spent FROM {calls} c) s CROSS JOIN (SELECT unnest([20000, 100000, 100000000]) AS budget) b GROUP BY 1, 2) g""")
def replay_states(spark, sf):
    budgets = spark.createDataFrame([(20_000,), (100_000,), (100_000_000,)], "budget int")
    return flow.replayed(adapter(spark, sf, "calls"), budgets, "case_id", "call_id", "centis", F.col("call_id") % 83 == 0)


@query("page_numbers", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS page FROM conversations")
def page_numbers(spark, sf):
    page = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long")
    return table(spark, sf, "conversations").select("conv_id", "turn", page.alias("page"))


@query("largest_photo", "SELECT p_brand, arg_max(p_partkey, p_size * 1000000 + p_partkey) AS p_partkey, max(p_size) AS area FROM part GROUP BY 1")
def largest_photo(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand").agg(F.max_by("p_partkey", F.struct("p_size", "p_partkey")).alias("p_partkey"), F.max("p_size").alias("area"))


@query("file_order", "SELECT owner, event_id, row_number() OVER (PARTITION BY owner ORDER BY CASE WHEN generation = 0 THEN message_id ELSE event_id END, event_id) AS place FROM {updates} u")
def file_order(spark, sf):
    key = F.when(F.col("generation") == 0, F.col("message_id")).otherwise(F.col("event_id"))
    place = F.row_number().over(Window.partitionBy("owner").orderBy(key, "event_id")).cast("long")
    return adapter(spark, sf, "updates").select("owner", "event_id", place.alias("place"))


@query("value_independence", "SELECT doc_id FROM documents WHERE doc_id % 5 = 0 AND length(text) >= 40 AND text IN (SELECT text FROM documents WHERE doc_id % 5 <> 0)")
def value_independence(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.length("text").alias("size"), F.sha2("text", 256).alias("sha"))
    return docs.where("doc_id % 5 = 0 AND size >= 40").join(docs.where("doc_id % 5 <> 0").select("sha"), "sha", "left_semi").select("doc_id")


# A job's log: most steps go on by one state of the usual course, some jump.
_COURSE = ("collecting", "admission", "queued", "awaiting_choice", "awaiting_instruction", "compiling", "awaiting_confirmation", "saving", "delivering", "finishing")
_LOG = f"""(SELECT owner, event_id, CASE (n + CASE WHEN event_id % 7 = 0 THEN 2 ELSE 0 END) % 10 {" ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(_COURSE))} END AS state
    FROM (SELECT owner, event_id, row_number() OVER (PARTITION BY owner ORDER BY event_id) - 1 AS n FROM {{updates}} u) t)"""


@query("job_transitions", f"""SELECT owner, event_id, a, b FROM (SELECT owner, event_id, lag(state) OVER (PARTITION BY owner ORDER BY event_id) AS a, state AS b FROM {_LOG} l) t
    WHERE CASE WHEN a IS NULL THEN b <> 'collecting' ELSE (a, b) NOT IN ({", ".join(f"('{a}', '{b}')" for a, b in rules.transitions())}) END""")
def job_transitions(spark, sf):
    log = spark.sql(f"SELECT * FROM {_LOG.replace('{updates}', '{events}')} l", events=adapter(spark, sf, "updates"))
    return rules.illegal_transitions(log, "owner", "event_id", "state")



_ACTIONS = "CASE WHEN event_id % 4 = 0 THEN 'stage' WHEN event_id % 11 = 0 THEN 'cancel' WHEN event_id % 3 = 0 THEN 'confirm' ELSE 'show' END"
# Six days of silence end a preview here; the SQL walks through an owner's events.
_TTL = 6 * 86_400


@query("preview_outcomes", f"""WITH RECURSIVE e AS (SELECT owner, event_id, t, {_ACTIONS} AS a, row_number() OVER (PARTITION BY owner ORDER BY t, event_id) AS n FROM {{updates}} u),
    w AS (SELECT owner, event_id, n, t, a = 'stage' AS live, false AS saved, CASE WHEN a = 'stage' THEN 'staged' ELSE 'expired' END AS outcome FROM e WHERE n = 1
      UNION ALL SELECT e.owner, e.event_id, e.n, e.t, CASE WHEN e.a = 'stage' THEN true WHEN e.a = 'cancel' THEN false ELSE w.live AND e.t - w.t < {_TTL} END,
        e.a <> 'stage' AND w.live AND e.t - w.t < {_TTL} AND (w.saved OR e.a = 'confirm'),
        CASE WHEN e.a = 'stage' THEN 'staged' WHEN NOT (w.live AND e.t - w.t < {_TTL}) THEN 'expired' WHEN e.a = 'cancel' THEN 'cancelled' WHEN e.a = 'show' THEN 'shown' WHEN w.saved THEN 'repeated' ELSE 'saved' END
      FROM w JOIN e ON e.owner = w.owner AND e.n = w.n + 1)
    SELECT owner, event_id, outcome FROM w""")
def preview_outcomes(spark, sf):
    rows = adapter(spark, sf, "updates").withColumn("action", F.expr(_ACTIONS))
    return flow.previews(rows, "owner", "t", "event_id", "action", _TTL)


@query("late_fragments", """WITH RECURSIVE e AS (SELECT owner, generation AS album, event_id, t, row_number() OVER (PARTITION BY owner, generation ORDER BY t, event_id) AS n FROM {updates} u),
    w AS (SELECT owner, album, event_id, n, t, 'received' AS effect, 1 AS g FROM e WHERE n = 1
      UNION ALL SELECT e.owner, e.album, e.event_id, e.n, e.t, CASE WHEN w.effect = 'refused' OR e.t - w.t >= 1000000 THEN 'refused' WHEN e.t - w.t >= 200000 THEN 'restart' ELSE 'received' END,
        w.g + CASE WHEN w.effect <> 'refused' AND e.t - w.t >= 200000 AND e.t - w.t < 1000000 THEN 1 ELSE 0 END FROM w JOIN e ON e.owner = w.owner AND e.album = w.album AND e.n = w.n + 1)
    SELECT owner, album, event_id, effect, CAST(g AS BIGINT) AS album_generation FROM w""")
def late_fragments(spark, sf):
    rows = adapter(spark, sf, "updates").withColumnRenamed("generation", "album")
    return flow.late_fragments(rows, ["owner", "album"], "t", "event_id", 200_000, 800_000)
