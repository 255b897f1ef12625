"""Seconds and budgets: apportionment over pages, percentiles, cumulative limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 1024


def percentiles(rows: DataFrame, keys: list[str], value: str, at: tuple[float, ...] = (0.05, 0.5, 0.95)) -> DataFrame:
    """Exact percentiles with linear interpolation of each key's values; keys without any have n 0."""
    counted = rows.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(value).alias("_n"))
    return counted_percentiles(counted, keys, at)


def counted_percentiles(counted: DataFrame, keys: list[str], at: tuple[float, ...]) -> DataFrame:
    """Of values ``_v`` and how often each comes up, ``_n``. A value that never comes up (or null) only names its key; keys aren't null.

    A key's range is cut into ``BINS`` equal bins, which are counted with partial sums; only the values of the bins that hold
    a wanted rank are then ranked, each bin by itself, so no task sees all values of a key."""
    some = counted.where("_v IS NOT NULL AND _n > 0")
    about = some.groupBy(*keys).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.sum("_n").alias("n"))
    width = F.col("_high") - F.col("_low")
    bin_ = F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_low")) * BINS / width), F.lit(BINS - 1))).otherwise(0)
    binned = some.join(about, keys).withColumn("_bin", bin_)
    order = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = binned.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_in"), F.max("n").alias("_all")).withColumn("_before", F.coalesce(F.sum("_in").over(order), F.lit(0)))

    def ranks(q: float, top: Column) -> tuple[Column, Column, Column]:
        place = (top - 1) * F.lit(q)
        return place, F.floor(place), F.ceil(place)

    held = F.lit(False)
    for q in at:
        for rank in ranks(q, F.col("_all"))[1:]:
            held = held | ((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_in")))
    values = binned.groupBy(*keys, "_bin", "_v").agg(F.sum("_n").alias("_n"), F.max("n").alias("n")).join(bins.where(held).select(*keys, "_bin", "_before"), [*keys, "_bin"])
    within = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = values.withColumn("_last", F.col("_before") + F.sum("_n").over(within) - 1)
    parts = []
    for q in at:
        place, low, high = ranks(q, F.col("n"))
        at_rank = [F.max(F.when((F.col("_last") - F.col("_n") < r) & (r <= F.col("_last")), F.col("_v"))) for r in (low, high)]
        parts.append(F.round(at_rank[0] + (at_rank[1] - at_rank[0]) * F.max(place - low), 6).alias(f"p{round(100 * q)}"))
    found = ranked.groupBy(*keys).agg(F.max("n").alias("n"), *parts)
    return counted.select(*keys).distinct().join(found, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def page_seconds(calls: DataFrame) -> DataFrame:
    """Each call's time divided evenly over its pages, summed by case and page; token counts are no calls."""
    each = calls.where("kind <> 'token_count'").withColumn("page", F.explode(F.sequence(F.lit(1), F.col("pages"))))
    return each.groupBy("case_id", "page").agg(F.round(F.sum(F.col("centis") / F.col("pages")), 4).alias("centis"))


def seconds_by_kind(calls: DataFrame) -> DataFrame:
    kinds = ("extraction", "alternate", "matching", "token_count")
    sums = [F.sum(F.when(F.col("kind") == k, F.col("centis")).otherwise(0)).alias(k) for k in kinds]
    return calls.groupBy("case_id").agg(*sums, F.count_if(F.col("kind") != "token_count").alias("model_calls"))


def over_budget(calls: DataFrame, budget: int) -> DataFrame:
    """The first call of each case with which the running total exceeds the budget."""
    running = F.sum("centis").over(Window.partitionBy("case_id").orderBy("call_id").rowsBetween(Window.unboundedPreceding, 0))
    spent = calls.withColumn("spent", running).where(F.col("spent") > budget)
    return spent.groupBy("case_id").agg(F.min("call_id").alias("call_id"), F.min_by("spent", "call_id").alias("spent"))


def first_and_later(runs: DataFrame, keys: list[str], order: str, wall: str) -> DataFrame:
    """Of the runs of each key: their number, median and 95th percentile, the first one's time (a cold start), and the
    median and number of the others. A run that ties with the first in ``order`` is one of the others."""
    first = runs.groupBy(*keys).agg(F.min_by(wall, order).alias("first_case"))
    whole = percentiles(runs, keys, wall, (0.5, 0.95)).withColumnRenamed("n", "count")
    # What is left without the first run: its value counts once less.
    counted = runs.groupBy(*keys, wall).agg(F.count("*").alias("_n"))
    others = counted.join(first, keys).withColumn("_n", F.col("_n") - (F.col(wall) == F.col("first_case")).cast("int")).where("_n > 0")
    rest = counted_percentiles(others.select(*keys, F.col(wall).alias("_v"), "_n"), keys, (0.5,)).select(*keys, F.col("n").alias("later_count"), F.col("p50").alias("later_p50"))
    return whole.join(first, keys).join(rest, keys, "left").withColumn("later_count", F.coalesce("later_count", F.lit(0)))
