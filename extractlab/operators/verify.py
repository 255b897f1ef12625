"""Verification that only downgrades, and the calibration grid over its thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from extractlab.functions.scalar import zero_error_bound

#: The grids of the least token probability (none: off) and of the matching margin, in thousandths.
V1_GRID = (None, 300, 500, 700, 800, 850, 900, 950, 970, 990, 995, 999)
MARGIN_GRID = (0, 50, 100, 200, 300, 500, 700, 900)


def ladder(
    status: Column, raw: Column, format_ok: Column, mille: Column, least: int | None, alternate: Column | None,
    alternate_status: Column | None = None, normal=None,
) -> Column:
    """The status after format, weakest-token and alternate-view checks, in this order; never upgraded.
    The alternate view confirms if it was extracted and has the same normal form (``normal``: raw to normal form,
    null where there is none; not given: the raw text)."""
    steps = F.when(status != "extracted", status).when(~format_ok, "invalid")
    if least is not None:
        steps = steps.when(mille.isNull() | (mille < least), "ambiguous")
    if alternate is not None:
        seen = alternate.isNotNull() if alternate_status is None else F.coalesce(alternate_status == "extracted", F.lit(False)) & alternate.isNotNull()
        same = alternate == raw if normal is None else normal(alternate) == normal(raw)
        steps = steps.when(~(seen & F.coalesce(same, F.lit(False))), "ambiguous")
    return steps.otherwise(status)


def leads(candidates: DataFrame) -> DataFrame:
    """The selected candidate's lead over the best other one (none: 0), by job."""
    own = F.max(F.when(F.col("ix") == F.col("selected"), F.col("mille")))
    other = F.coalesce(F.max(F.when(F.col("ix") != F.col("selected"), F.col("mille"))), F.lit(0))
    return candidates.groupBy("job").agg(own.alias("own"), (own - other).alias("lead"))


def certain(lead: Column, margin: Column | int) -> Column:
    """Strictly ahead, and by more than the margin."""
    return (lead > 0) & (lead > margin)


def aligned(primary: DataFrame, alternate: DataFrame, key: str, pos: str, flags: list[str]) -> DataFrame:
    """Whether an alternate list may confirm a primary one: as many rows, and equal flags in every row."""
    left = primary.select(key, pos, *flags)
    right = alternate.select(key, pos, *(F.col(f).alias(f"_{f}") for f in flags)).withColumn("_there", F.lit(True))
    same = F.col("_there").isNotNull()
    for f in flags:
        same = same & F.col(f).eqNullSafe(F.col(f"_{f}"))
    rows = left.withColumn("_here", F.lit(True)).join(right, [key, pos], "full")
    return rows.groupBy(key).agg(F.bool_and(F.coalesce(same & F.col("_here").isNotNull(), F.lit(False))).alias("aligned"), F.count("*").alias("rows"))


def token_evidence(tokens: DataFrame, spans: DataFrame, key: str, order: str) -> DataFrame:
    """Tokens (key, order, size, mille) that overlap each span (key, left, right) of byte offsets: their
    number, the weakest, and whether one token holds the whole span. An equi-join on the key with a range
    condition; offsets are running sums."""
    from pyspark.sql import Window

    end = F.sum("size").over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    placed = tokens.withColumn("_end", end).withColumn("_start", F.col("_end") - F.col("size"))
    hit = spans.join(placed, key).where((F.col("_start") < F.col("right")) & (F.col("_end") > F.col("left")))
    return hit.groupBy(key, "left", "right").agg(
        F.count("*").alias("tokens"), F.min("mille").alias("weakest"), F.bool_or((F.col("_start") <= F.col("left")) & (F.col("_end") >= F.col("right"))).alias("contained")
    )


def grid(spark: SparkSession, alternates: bool = True) -> DataFrame:
    """The calibration points in index order: alternate view, then token threshold, then margin."""
    points = [(v2, v1, m) for v2 in ((False, True) if alternates else (False,)) for v1 in V1_GRID for m in MARGIN_GRID]
    return spark.createDataFrame([(i, v2, v1, m) for i, (v2, v1, m) in enumerate(points)], "index int, v2 boolean, v1 int, margin int")


def risk_coverage(values: DataFrame, jobs: DataFrame, spark: SparkSession) -> DataFrame:
    """Accepted values and selected profiles, right and wrong, at every point.

    ``values``: job, mille, confirmed, correct (extracted and well-formed only); ``jobs``: job, lead, right.
    Every test is monotone, so facts are first counted by how many thresholds they pass; only these few
    hundred counts (at most 12 x 2 x 9) meet the points, however many values there are."""
    def passed(x: Column, levels: tuple, strict: bool) -> Column:
        return sum((F.when(x > t if strict else x >= t, 1).otherwise(0) for t in levels), F.lit(0))

    v1 = passed(F.col("mille"), V1_GRID[1:], False)
    margin = F.when(F.col("lead") > 0, passed(F.col("lead"), MARGIN_GRID, True)).otherwise(0)
    cells = values.join(jobs.select("job", "lead"), "job").groupBy(v1.alias("c1"), F.col("confirmed").alias("c2"), margin.alias("c3")).agg(
        F.count("*").alias("n"), F.count_if(~F.col("correct")).alias("wrong")
    )
    picks = jobs.groupBy(margin.alias("c3")).agg(F.count("*").alias("n"), F.count_if(~F.col("right")).alias("wrong"))
    points = grid(spark).withColumn("p1", sum((F.when(F.col("v1") >= t, 1).otherwise(0) for t in V1_GRID[1:]), F.lit(0))).withColumn(
        "p3", sum((F.when(F.col("margin") >= t, 1).otherwise(0) for t in MARGIN_GRID), F.lit(0))
    ).withColumn("p1", F.coalesce("p1", F.lit(0)))
    counted = points.join(F.broadcast(cells), (F.col("c1") >= F.col("p1")) & (F.col("c2") | ~F.col("v2")) & (F.col("c3") >= F.col("p3"))).groupBy("index").agg(
        F.sum("n").alias("accepted"), F.sum("wrong").alias("wrong")
    )
    chosen = points.join(F.broadcast(picks), F.col("c3") >= F.col("p3")).groupBy("index").agg(F.sum("n").alias("profiles"), F.sum("wrong").alias("wrong_profiles"))
    out = points.join(counted, "index", "left").join(chosen, "index", "left").na.fill(0, ["accepted", "wrong", "profiles", "wrong_profiles"])
    return out.select(
        "index", "v2", "v1", "margin", "accepted", "wrong", "profiles", "wrong_profiles",
        F.round(zero_error_bound(F.col("accepted"), F.col("wrong")), 9).alias("bound"),
    )


def select_point(points: DataFrame) -> DataFrame:
    """The point to freeze: no error and nothing unreplayable, most complete, then without alternate view,
    the higher token threshold, the higher margin, the first."""
    free = points.where("wrong = 0 AND wrong_profiles = 0")
    if "unreplayable" in points.columns:
        free = free.where("unreplayable = 0")
    return free.orderBy(F.coalesce("completeness", F.lit(0.0)).desc(), F.col("v2"), F.coalesce("v1", F.lit(-1)).desc(), F.col("margin").desc(), "index").limit(1)


def freeze_gate(wrong: Column, wrong_profiles: Column, completeness: Column, target: float) -> Column:
    """Whether a calibration point may be frozen, or why not."""
    return (
        F.when((wrong > 0) | (wrong_profiles > 0), "calibration_point_has_errors")
        .when(completeness.isNull() | (completeness < target), "calibration_completeness_below_target").otherwise("selectable")
    )
