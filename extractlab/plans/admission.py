"""Decisions that depend on earlier ones, held against SQL that walks through the rows one after another."""

from __future__ import annotations

from pyspark.sql import functions as F

from extractlab.operators import admission as ad
from extractlab.operators import flow
from extractlab.plans.registry import query
from extractlab.sources.adapters import adapter

# Twenty services; jobs run from a minute to over a day.
_REQUESTS = "SELECT owner % 20 AS service, owner, event_id AS id, t, t + 60 + event_id * 7919 % 100000 AS e FROM {updates} u"


@query("admission", f"""
    WITH RECURSIVE r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY service ORDER BY t, id) AS n FROM ({_REQUESTS}) q),
    s AS (
        SELECT DISTINCT service, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, CAST([] AS STRUCT(e BIGINT, o BIGINT)[]) AS live,
            CAST([] AS STRUCT(e BIGINT, o BIGINT)[]) AS found, CAST(0 AS BIGINT) AS own FROM r
        UNION ALL
        SELECT service, n, id, CASE WHEN own = 0 AND len(found) < 8 THEN list_append(found, {{'e': e, 'o': owner}}) ELSE found END, found, own
        FROM (SELECT *, len(list_filter(found, lambda x: x.o = owner)) AS own
              FROM (SELECT r.*, list_filter(s.live, lambda x: x.e > r.t) AS found FROM s JOIN r ON r.service = s.service AND r.n = s.n + 1) a) b)
    SELECT id, CAST(len(found) AS INT) AS active, CAST(own AS INT) AS own,
        CASE WHEN own > 0 THEN 'active_document' WHEN len(found) >= 8 THEN 'busy' ELSE 'admitted' END AS decision
    FROM s WHERE n > 0""")
def admission(spark, sf):
    rows = spark.sql(_REQUESTS, updates=adapter(spark, sf, "updates"))
    return ad.admission(rows, "service", "owner", "t", "e")


# The stand-in has few attempts a day, so the window is five days.
_WINDOW = 432_000
_TRIED = "SELECT owner, t, event_id, kind = 'signup' AND event_id % 3 = 0 AS correct FROM {updates} u WHERE kind IN ('error', 'signup')"
_WALK = f"""r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY t, event_id) AS n FROM ({_TRIED}) q),
    s AS (
        SELECT DISTINCT owner, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS t, CAST(0 AS BIGINT) AS event_id, false AS correct, CAST([] AS BIGINT[]) AS held, CAST([] AS BIGINT[]) AS after FROM r
        UNION ALL
        SELECT owner, n, t, event_id, correct, found, CASE WHEN len(found) >= 5 THEN found WHEN correct THEN [] ELSE list_append(found, t) END
        FROM (SELECT r.*, list_filter(s.after, lambda x: x > r.t - {_WINDOW}) AS found FROM s JOIN r ON r.owner = s.owner AND r.n = s.n + 1) a),
    told AS (SELECT owner, t, event_id, CASE WHEN len(held) >= 5 THEN 'locked' WHEN correct THEN 'accepted' WHEN len(after) >= 5 THEN 'locked' ELSE 'refused' END AS result,
        CASE WHEN len(held) >= 5 OR NOT correct AND len(after) >= 5 THEN after[1] + {_WINDOW} - t END AS retry_after, len(held) < 5 AND NOT correct AS recorded FROM s WHERE n > 0)"""


def _tried(spark, sf):
    return ad.lockouts(spark.sql(_TRIED, updates=adapter(spark, sf, "updates")), window=_WINDOW)


@query("lockout", f"WITH RECURSIVE {_WALK} SELECT * FROM told")
def lockout(spark, sf):
    return _tried(spark, sf)


_ALERT = 21_600


@query("surge_alerts", f"""WITH RECURSIVE {_WALK},
    f AS MATERIALIZED (SELECT t, event_id, row_number() OVER (ORDER BY t, event_id) AS n FROM told WHERE recorded),
    c AS MATERIALIZED (SELECT f.t, f.event_id, row_number() OVER (ORDER BY f.t, f.event_id) AS k FROM f
        WHERE (SELECT count(*) FROM f g WHERE g.n <= f.n AND g.t > f.t - {_ALERT}) >= 30),
    a AS (SELECT t, event_id, k FROM c WHERE k = 1
        UNION ALL SELECT c.t, c.event_id, c.k FROM a JOIN c ON c.k = (SELECT min(d.k) FROM c d WHERE d.k > a.k AND d.t >= a.t + {_ALERT}))
    SELECT t, event_id FROM a""")
def surge_alerts(spark, sf):
    return ad.alerts(_tried(spark, sf).where("recorded"), "t", "event_id", window=_ALERT)


# Parts of messages: a refusal with a pause is tried again, whatever else happens goes on to the next part.
_LOG = """SELECT delivery, part, row_number() OVER (PARTITION BY delivery, part ORDER BY event_id) AS attempt, t, t + event_id % 9 AS ended, outcome, event_id % 25 AS retry_after,
        CASE WHEN delivery % 11 = 0 THEN 25 END AS cancelled, max(part) OVER (PARTITION BY delivery) + CASE WHEN delivery % 5 = 0 THEN 1 ELSE 0 END AS parts
    FROM (SELECT delivery, event_id, outcome, 10 * row_number() OVER (PARTITION BY delivery ORDER BY event_id) + event_id % 7 AS t,
            1 + coalesce(sum(CASE WHEN outcome <> 'retry_after' THEN 1 ELSE 0 END) OVER (PARTITION BY delivery ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part
        FROM (SELECT owner * 1000 + message_id % 40 AS delivery, event_id, CASE WHEN event_id % 2 = 0 THEN 'confirmed' WHEN event_id % 3 = 0 THEN 'retry_after'
            WHEN event_id % 5 = 0 THEN 'forbidden' WHEN event_id % 7 = 0 THEN 'skipped' WHEN event_id % 11 = 0 THEN 'api_error' WHEN event_id % 13 = 0 THEN 'timed_out' ELSE 'confirmed' END AS outcome FROM {updates} u) k) p"""


@query("delivery_outcome", f"""
    WITH RECURSIVE g AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY delivery ORDER BY part, attempt) AS BIGINT) AS n, min(t) OVER (PARTITION BY delivery) + 40 AS deadline FROM ({_LOG}) l),
    w AS (
        SELECT delivery, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS done, CAST(NULL AS VARCHAR) AS said, CAST(NULL AS BIGINT) AS part, max(parts) AS parts FROM g GROUP BY delivery
        UNION ALL
        SELECT g.delivery, g.n, w.done + CASE WHEN g.outcome = 'confirmed' THEN 1 ELSE 0 END,
            CASE WHEN cancelled <= t THEN 'cancelled' WHEN deadline - t <= 0 THEN 'failed' WHEN outcome = 'skipped' THEN 'cancelled' WHEN outcome = 'timed_out' THEN 'uncertain'
                WHEN outcome = 'retry_after' AND (attempt + 1 > 3 OR ended + retry_after >= deadline) THEN 'failed' WHEN outcome = 'forbidden' THEN 'blocked' WHEN outcome = 'api_error' THEN 'failed' END,
            g.part, g.parts
        FROM w JOIN g ON g.delivery = w.delivery AND g.n = w.n + 1 WHERE w.said IS NULL)
    SELECT delivery, coalesce(said, CASE WHEN done >= parts THEN 'complete' ELSE 'unfinished' END) AS outcome, CASE WHEN said IS NOT NULL THEN part END AS part
    FROM (SELECT *, row_number() OVER (PARTITION BY delivery ORDER BY n DESC) AS back FROM w) v WHERE back = 1""")
def delivery_outcome(spark, sf):
    return flow.delivered(spark.sql(_LOG, updates=adapter(spark, sf, "updates")), "delivery", "parts", 40, 3)
