"""Merging, verification and calibration over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from extractlab.functions import scalar as fn
from extractlab.operators import merge, verify
from extractlab.plans.lists import _MERGED_LISTS, _merged_lists
from extractlab.plans.registry import query
from extractlab.sources.adapters import adapter, table

_MERGED = """(SELECT job, CASE WHEN amb OR k > 1 THEN 'ambiguous' WHEN ext > 0 THEN 'extracted' WHEN inv > 0 THEN 'invalid' WHEN unr > 0 THEN 'unreadable' ELSE 'missing' END AS status,
      CASE WHEN amb OR k > 1 THEN NULL WHEN ext > 0 THEN first_ext WHEN inv > 0 THEN first_inv END AS raw, batches FROM (
        SELECT job, bool_or(status = 'ambiguous') AS amb, count(DISTINCT CASE WHEN status IN ('extracted', 'invalid') THEN raw END) AS k,
               count(*) FILTER (WHERE status = 'extracted') AS ext, count(*) FILTER (WHERE status = 'invalid') AS inv, count(*) FILTER (WHERE status = 'unreadable') AS unr,
               arg_min(raw, batch) FILTER (WHERE status = 'extracted') AS first_ext, arg_min(raw, batch) FILTER (WHERE status = 'invalid') AS first_inv, count(*) AS batches
        FROM {readings} r GROUP BY job) g)"""


@query("scalar_merge", f"SELECT * FROM {_MERGED} m")
def scalar_merge(spark, sf):
    return merge.merge_scalars(adapter(spark, sf, "readings"), ["job"])


_NUMBERS = """(SELECT l_orderkey AS job, CAST(seq AS INT) AS batch, CASE WHEN l_linenumber = 5 AND l_orderkey % 4 = 0 THEN 'invalid' WHEN l_linenumber = 6 THEN 'missing' ELSE 'extracted' END AS status,
      CASE WHEN l_linenumber <> 6 THEN CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE '+0' END || CAST(l_orderkey % 90 + CASE WHEN l_linenumber = 3 AND l_orderkey % 5 = 0 THEN 1 ELSE 0 END AS VARCHAR)
        || CASE WHEN l_linenumber % 3 = 0 THEN '.00' WHEN l_linenumber % 3 = 1 THEN '.0' ELSE '' END END AS raw, [l_linenumber % 2 + 1, CAST(seq AS INT)] AS pages
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS seq FROM lineitem) t)"""


@query("number_merge", f"""SELECT job, status, CASE WHEN status = 'extracted' THEN ext WHEN status = 'invalid' THEN inv END AS raw, CASE WHEN status = 'extracted' THEN CAST(CAST(ext AS DECIMAL(20, 2)) AS BIGINT)::VARCHAR END AS normalized, pages, batches
    FROM (SELECT *, CASE WHEN k > 1 THEN 'ambiguous' WHEN ext IS NOT NULL THEN 'extracted' WHEN inv IS NOT NULL THEN 'invalid' ELSE 'missing' END AS status FROM (
      SELECT job, count(DISTINCT CAST(raw AS DECIMAL(20, 2))) AS k, arg_min(raw, batch) FILTER (WHERE status = 'extracted') AS ext, arg_min(raw, batch) FILTER (WHERE status = 'invalid') AS inv, count(*) AS batches,
        array_to_string(list_transform(list_sort(list_distinct(flatten(list(pages)))), lambda x: CAST(x AS VARCHAR)), ',') AS pages FROM {_NUMBERS} n GROUP BY job) g) s""")
def number_merge(spark, sf):
    sql = _NUMBERS.replace("VARCHAR", "STRING").replace("[l_linenumber % 2 + 1, CAST(seq AS INT)]", "array(l_linenumber % 2 + 1, CAST(seq AS INT))").replace("FROM lineitem", "FROM {lines}")
    rows = spark.sql(f"SELECT * FROM {sql} n", lines=table(spark, sf, "lineitem"))
    merged = merge.merge_scalars(rows, ["job"], normal=fn.normal_number(F.col("raw")))
    return merged.withColumn("pages", F.array_join(F.array_sort("pages"), ","))


@query("job_outcome", f"""SELECT o_custkey, CASE WHEN NOT bool_or(has) THEN 'failed' WHEN bool_and(settled) AND o_custkey % 6 <> 0 THEN 'complete' ELSE 'partial' END AS outcome, CAST(sum(field) AS BIGINT) AS fields, count(*) AS results
    FROM (SELECT o_custkey, status = 'extracted' AS has, status IN ('extracted', 'missing') AS settled, 1 AS field FROM {_MERGED} m JOIN orders ON job = o_orderkey
      UNION ALL SELECT o_custkey, accepted > 0 OR (status = 'complete' AND rows = 0), status = 'complete', 0 FROM {_MERGED_LISTS} m JOIN orders ON job = o_orderkey) p GROUP BY o_custkey""")
def job_outcome(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    fields = merge.merge_scalars(adapter(spark, sf, "readings"), ["job"]).join(orders, F.col("job") == F.col("o_orderkey"))
    found = _merged_lists(spark, sf).join(orders, F.col("job") == F.col("o_orderkey"))
    return merge.outcome(fields, found, ["o_custkey"], F.col("o_custkey") % 6 != 0)


@query("list_status", """SELECT job, status, CASE WHEN status = 'unresolved' THEN CASE WHEN a THEN 'ambiguous' WHEN i THEN 'invalid' WHEN u THEN 'unreadable' WHEN m THEN CASE WHEN whole THEN 'missing' ELSE 'unreadable' END ELSE 'ambiguous' END END AS reason
    FROM (SELECT job, bool_or(status = 'ambiguous') AS a, bool_or(status = 'invalid') OR job % 9 = 4 AS i, bool_or(status = 'unreadable') AS u, bool_or(status = 'missing') AS m, job % 2 = 0 AS whole,
       CASE WHEN job % 2 = 0 AND job % 3 <> 0 AND bool_and(status IN ('extracted', 'missing')) THEN 'complete' WHEN bool_or(status = 'extracted') THEN 'partial' ELSE 'unresolved' END AS status FROM {readings} r GROUP BY job) g""")
def list_status(spark, sf):
    return merge.list_status(adapter(spark, sf, "readings"), ["job"], F.col("job") % 2 == 0, F.col("job") % 3 != 0, F.when(F.col("job") % 9 == 4, "invalid"))


@query("replay_dedupe", """SELECT job, source_key, count(*) AS replays, CASE WHEN count(DISTINCT a) = 1 THEN min(a) END AS a, CASE WHEN count(DISTINCT b) = 1 THEN min(b) END AS b,
    CASE WHEN count(DISTINCT a) > 1 THEN 'ambiguous' ELSE 'extracted' END AS a_status, CASE WHEN count(DISTINCT b) > 1 THEN 'ambiguous' ELSE 'extracted' END AS b_status,
    count(DISTINCT a) = 1 AND count(DISTINCT b) = 1 AS enumerated FROM {list_rows} r GROUP BY job, source_key""")
def replay_dedupe(spark, sf):
    return merge.drop_replays(adapter(spark, sf, "list_rows"), ["job", "source_key"], "pos", ["a", "b"])


@query("continuation_stitch", """WITH f AS (SELECT *, coalesce(lag(continues_next) OVER w, false) AND continues_previous AS joined, coalesce(lead(continues_previous) OVER w, false) AS follows
      FROM {list_rows} r WINDOW w AS (PARTITION BY job ORDER BY pos)),
    g AS (SELECT *, (continues_previous AND NOT joined) OR (continues_next AND NOT follows) AS one, CAST(sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY job ORDER BY pos) AS BIGINT) AS island FROM f)
    SELECT job, island, count(*) AS parts, bool_or(one) AS lone, CASE WHEN bool_or(one) OR count(DISTINCT a) > 1 THEN 'ambiguous' ELSE 'extracted' END AS a_status,
      CASE WHEN bool_or(one) OR count(DISTINCT b) > 1 THEN 'ambiguous' ELSE 'extracted' END AS b_status,
      CASE WHEN NOT bool_or(one) AND count(DISTINCT a) = 1 THEN min(a) END AS a, CASE WHEN NOT bool_or(one) AND count(DISTINCT b) = 1 THEN min(b) END AS b FROM g GROUP BY job, island""")
def continuation_stitch(spark, sf):
    return merge.stitch(adapter(spark, sf, "list_rows"), "job", "pos", ["a", "b"])


_SPANS = "SELECT job, pos, CASE WHEN job % 3 = 0 THEN pos * 2 - 1 ELSE pos * 2 - 1 + CASE WHEN pos = 4 THEN job % 3 - 1 - pos % 2 ELSE 0 END END AS first, pos * 2 AS last FROM {list_rows} r"


@query("contiguous_prefix", f"""SELECT job, min(pos) AS position, arg_min(CASE WHEN first < want THEN 'overlap' ELSE 'gap' END, pos) AS problem
    FROM (SELECT *, coalesce(lag(last) OVER (PARTITION BY job ORDER BY pos) + 1, 1) AS want FROM ({_SPANS.replace('ELSE 0 END END', 'ELSE 0 END - CASE WHEN pos = 6 AND job % 7 = 0 THEN 1 ELSE 0 END END')}) s) t WHERE first <> want GROUP BY job""")
def contiguous_prefix(spark, sf):
    rows = adapter(spark, sf, "list_rows").selectExpr(
        "job", "pos", "CASE WHEN job % 3 = 0 THEN pos * 2 - 1 ELSE pos * 2 - 1 + CASE WHEN pos = 4 THEN job % 3 - 1 - pos % 2 ELSE 0 END - CASE WHEN pos = 6 AND job % 7 = 0 THEN 1 ELSE 0 END END AS first", "pos * 2 AS last"
    )
    return merge.contiguous(rows, "job", "pos")


@query("boundary_flags", """SELECT job, count(*) FILTER (WHERE continues_previous AND pos > 1) AS previous_misplaced, count(*) FILTER (WHERE continues_next AND pos < m) AS next_misplaced
    FROM (SELECT *, max(pos) OVER (PARTITION BY job) AS m FROM {list_rows} r) t GROUP BY job""")
def boundary_flags(spark, sf):
    return merge.misplaced_flags(adapter(spark, sf, "list_rows"), "job", "pos")


@query("weakest_token", "SELECT job, min(mille) AS weakest, CASE WHEN min(mille) < 700 THEN 'ambiguous' ELSE 'extracted' END AS status FROM {readings} r GROUP BY job")
def weakest_token(spark, sf):
    rows = adapter(spark, sf, "readings").groupBy("job").agg(F.min("mille").alias("weakest"))
    return rows.withColumn("status", verify.ladder(F.lit("extracted"), F.lit(""), F.lit(True), F.col("weakest"), 700, None))


@query("matching_margin", """SELECT job, own, own - other AS lead, own > other AND own - other > 300 AS certain FROM (
    SELECT job, max(CASE WHEN ix = selected THEN mille END) AS own, max(CASE WHEN ix <> selected THEN mille END) AS other FROM {matching} m GROUP BY job) g""")
def matching_margin(spark, sf):
    return verify.leads(adapter(spark, sf, "matching")).withColumn("certain", verify.certain(F.col("lead"), 300))


@query("verify_ladder", """SELECT status, verified, count(*) AS n FROM (SELECT status, CASE WHEN status <> 'extracted' THEN status WHEN raw NOT IN ('A', 'N') THEN 'invalid' WHEN mille < 700 THEN 'ambiguous'
    WHEN alternate <> raw OR mille % 29 = 0 THEN 'ambiguous' ELSE status END AS verified FROM {readings} r) v GROUP BY 1, 2""")
def verify_ladder(spark, sf):
    rows = adapter(spark, sf, "readings")
    # Numbers of one value in two spellings, as an alternate view may give them.
    spelled = F.when(F.col("alternate") == "N", F.lit("10.00")).otherwise(F.col("alternate"))
    own = F.when(F.col("raw") == "N", F.lit("10")).otherwise(F.col("raw"))
    seen = F.when(F.col("mille") % 29 == 0, "unreadable").otherwise("extracted")

    def normal(x):
        return F.coalesce(fn.normal_number(x), x)

    checked = verify.ladder(F.col("status"), own, F.col("raw").isin("A", "N"), F.col("mille"), 700, spelled, seen, normal)
    return rows.groupBy("status", checked.alias("verified")).agg(F.count("*").alias("n"))


@query("alternate_aligned", """SELECT coalesce(p.job, q.job) AS job, bool_and(p.job IS NOT NULL AND q.job IS NOT NULL AND p.continues_next = q.continues_next) AS aligned, count(*) AS rows
    FROM {list_rows} p FULL JOIN (SELECT job, pos, CASE WHEN job % 7 = 0 THEN NOT continues_next ELSE continues_next END AS continues_next FROM {list_rows} r WHERE NOT (job % 5 = 0 AND pos = 2)) q ON p.job = q.job AND p.pos = q.pos GROUP BY 1""")
def alternate_aligned(spark, sf):
    rows = adapter(spark, sf, "list_rows")
    other = rows.where("NOT (job % 5 = 0 AND pos = 2)").withColumn("continues_next", F.expr("CASE WHEN job % 7 = 0 THEN NOT continues_next ELSE continues_next END"))
    return verify.aligned(rows, other, "job", "pos", ["continues_next"])


@query("token_span_overlap", """SELECT job, s."left", s."right", count(*) AS tokens, min(mille) AS weakest, bool_or(e - size <= s."left" AND e >= s."right") AS contained
    FROM (SELECT job, size, mille, CAST(sum(size) OVER (PARTITION BY job ORDER BY batch) AS BIGINT) AS e FROM (SELECT job, batch, mille, 1 + mille % 9 AS size FROM {readings} r) a) t
    CROSS JOIN (SELECT 3 AS "left", 6 AS "right" UNION ALL SELECT 10, 22) s WHERE e - size < s."right" AND e > s."left" GROUP BY 1, 2, 3""")
def token_span_overlap(spark, sf):
    tokens = adapter(spark, sf, "readings").selectExpr("job", "batch", "mille", "1 + mille % 9 AS size")
    spans = tokens.select("job").distinct().select("job", F.explode(F.array(F.struct(F.lit(3).alias("left"), F.lit(6).alias("right")), F.struct(F.lit(10).alias("left"), F.lit(22).alias("right")))).alias("s")).select("job", "s.left", "s.right")
    return verify.token_evidence(tokens, spans, "job", "batch")


_POINTS = """(SELECT CAST(row_number() OVER (ORDER BY v2, o1, margin) - 1 AS INT) AS index, v2, v1, margin FROM (SELECT unnest([false, true]) AS v2) a
    CROSS JOIN (SELECT unnest([NULL, 300, 500, 700, 800, 850, 900, 950, 970, 990, 995, 999]) AS v1, unnest(range(12)) AS o1) b CROSS JOIN (SELECT unnest([0, 50, 100, 200, 300, 500, 700, 900]) AS margin) c)"""
_RISK = f"""(SELECT p.index, p.v2, p.v1, p.margin, coalesce(accepted, 0) AS accepted, coalesce(wrong, 0) AS wrong, coalesce(profiles, 0) AS profiles, coalesce(wrong_profiles, 0) AS wrong_profiles,
      CASE WHEN coalesce(wrong, 0) = 0 AND accepted > 0 THEN round(1 - pow(0.05, 1.0 / accepted), 9) END AS bound FROM {_POINTS} p
    LEFT JOIN (SELECT index, count(*) AS accepted, count(*) FILTER (WHERE raw <> 'N') AS wrong FROM {_POINTS} p JOIN (SELECT r.*, lead FROM {{readings}} r JOIN
        (SELECT job, max(CASE WHEN ix = selected THEN mille END) - max(CASE WHEN ix <> selected THEN mille END) AS lead FROM {{matching}} m GROUP BY job) l ON r.job = l.job WHERE status = 'extracted' AND raw IN ('A', 'N')) v
      ON (p.v1 IS NULL OR v.mille >= p.v1) AND (NOT p.v2 OR alternate = raw) AND lead > 0 AND lead > p.margin GROUP BY index) x ON x.index = p.index
    LEFT JOIN (SELECT index, count(*) AS profiles, count(*) FILTER (WHERE job % 97 = 0) AS wrong_profiles FROM {_POINTS} p JOIN
        (SELECT job, max(CASE WHEN ix = selected THEN mille END) - max(CASE WHEN ix <> selected THEN mille END) AS lead FROM {{matching}} m GROUP BY job) l ON lead > 0 AND lead > p.margin GROUP BY index) y ON y.index = p.index)"""


def _risk(spark, sf, correct="raw = 'N'", right="job % 97 <> 0"):
    values = adapter(spark, sf, "readings").where("status = 'extracted' AND raw IN ('A', 'N')").select(
        "job", "mille", (F.col("alternate") == F.col("raw")).alias("confirmed"), F.expr(correct).alias("correct")
    )
    jobs = verify.leads(adapter(spark, sf, "matching")).select("job", "lead", F.expr(right).alias("right"))
    return verify.risk_coverage(values, jobs, spark)


@query("risk_coverage", f"SELECT * FROM {_RISK} r")
def risk_coverage(spark, sf):
    return _risk(spark, sf)


@query("signal_curves", f"SELECT index, v1, accepted, wrong FROM {_RISK} r WHERE NOT v2 AND margin = 0")
def signal_curves(spark, sf):
    return _risk(spark, sf).where("NOT v2 AND margin = 0").select("index", "v1", "accepted", "wrong")


# Facts with error-free points: values are wrong only under a probability of 0.85, profiles only up to a lead of 0.3.
_LESS_RISK = _RISK.replace("raw <> 'N'", "raw <> 'N' AND mille < 850").replace("job % 97 = 0", "job % 97 = 0 AND lead <= 300")


@query("select_point", f"""SELECT index, v2, v1, margin, accepted, completeness FROM (SELECT *, round(accepted / (SELECT count(*) FROM {{readings}} r WHERE status = 'extracted' AND raw IN ('A', 'N')), 9) AS completeness FROM {_LESS_RISK} r) s
    WHERE wrong = 0 AND wrong_profiles = 0 ORDER BY completeness DESC, v2, coalesce(v1, -1) DESC, margin DESC, index LIMIT 1""")
def select_point(spark, sf):
    points = _risk(spark, sf, "raw = 'N' OR mille >= 850", "job % 97 <> 0 OR lead > 300")
    total = adapter(spark, sf, "readings").where("status = 'extracted' AND raw IN ('A', 'N')").agg(F.count("*").alias("total"))
    scored = points.crossJoin(F.broadcast(total)).withColumn("completeness", F.round(F.try_divide("accepted", "total"), 9))  # one row
    return verify.select_point(scored).select("index", "v2", "v1", "margin", "accepted", "completeness")


@query("freeze_gate", f"""SELECT index, CASE WHEN wrong > 0 OR wrong_profiles > 0 THEN 'calibration_point_has_errors' WHEN accepted IS NULL OR accepted < 0.04 * (SELECT count(*) FROM {{readings}} r WHERE status = 'extracted' AND raw IN ('A', 'N'))
    THEN 'calibration_completeness_below_target' ELSE 'selectable' END AS gate FROM {_LESS_RISK} r""")
def freeze_gate(spark, sf):
    points = _risk(spark, sf, "raw = 'N' OR mille >= 850", "job % 97 <> 0 OR lead > 300")
    total = adapter(spark, sf, "readings").where("status = 'extracted' AND raw IN ('A', 'N')").agg(F.count("*").alias("total"))
    scored = points.crossJoin(F.broadcast(total)).withColumn("completeness", F.try_divide("accepted", "total"))  # one row
    return scored.select("index", verify.freeze_gate(F.col("wrong"), F.col("wrong_profiles"), F.col("completeness"), 0.04).alias("gate"))
