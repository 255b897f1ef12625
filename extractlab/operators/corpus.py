"""Scoring against truth, and governance of corpora: contamination, eligibility, review, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The groups of a score report.
DIMENSIONS = ("script", "category", "quality", "delivery_path")
COUNTERS = ("cases", "accepted", "correct", "incorrect", "false_missing", "readable_present", "recovered", "not_completed")


def case_counts(cases: DataFrame) -> DataFrame:
    """Counters of each case. Only completed executions deliver, but every case stays in the denominators."""
    delivered = F.col("execution_state") == "completed"
    accepted = delivered & (F.col("status") == "extracted")
    right = accepted & (F.col("truth_status") == "extracted") & (F.col("value") == F.col("truth_value"))
    present = (F.col("truth_status") == "extracted") & (F.col("quality") == "readable")
    flags = {
        "cases": F.lit(True), "accepted": accepted, "correct": right, "incorrect": accepted & ~right,
        "false_missing": delivered & (F.col("status") == "missing") & (F.col("truth_status") == "extracted"),
        "readable_present": present, "recovered": right & present, "not_completed": ~delivered,
    }
    return cases.select("case_id", *DIMENSIONS, *(F.when(c, 1).otherwise(0).cast("long").alias(k) for k, c in flags.items()))


def rates(counts: DataFrame) -> DataFrame:
    """Null where the denominator is 0."""
    return counts.withColumn("error_rate", F.round(F.try_divide("incorrect", "accepted"), 9)).withColumn("completeness", F.round(F.try_divide("recovered", "readable_present"), 9))


def score_groups(counts: DataFrame) -> DataFrame:
    """Sums over all cases and over each label of each dimension: five grouping sets, one pass."""
    sets = [[], *([F.col(d)] for d in DIMENSIONS)]
    sums = [F.sum(c).alias(c) for c in COUNTERS]
    out = counts.groupingSets(sets, *(F.col(d) for d in DIMENSIONS)).agg(*sums, F.grouping_id().alias("_g"))
    masks = {sum(1 << (len(DIMENSIONS) - 1 - j) for j in range(len(DIMENSIONS)) if j != i): d for i, d in enumerate(DIMENSIONS)}
    dimension, label = F.lit("total"), F.lit("all")
    for mask, d in masks.items():
        dimension = F.when(F.col("_g") == mask, d).otherwise(dimension)
        label = F.when(F.col("_g") == mask, F.col(d)).otherwise(label)
    return rates(out.select(dimension.alias("dimension"), label.alias("label"), *COUNTERS))


def contamination(members: DataFrame) -> DataFrame:
    """Identities (kind, value) that a benchmark shares with development or tuning, of rows (split, kind, value)."""
    found = members.groupBy("kind", "value").agg(F.bool_or(F.col("split") == "benchmark").alias("held"), F.bool_or(F.col("split") != "benchmark").alias("seen"), F.count("*").alias("members"))
    return found.where("held AND seen").select("kind", "value", "members")


def reasons(rows: DataFrame, rules: dict[str, Column], *keys: str) -> DataFrame:
    """By key (none: one row) the sorted names of the rules (aggregates) that hold."""
    return rows.groupBy(*keys).agg(F.array_join(F.array_sort(F.array_compact(F.array(*(F.when(c, k) for k, c in rules.items())))), ",").alias("reasons"))


def inventory_difference(wanted: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """What is missing and what is unexpected, by two anti joins."""
    return wanted.join(found, name, "left_anti").select(F.lit("missing").alias("problem"), name).unionByName(
        found.join(wanted, name, "left_anti").select(F.lit("unexpected").alias("problem"), name)
    )


def duplicates(rows: DataFrame, digest: str, order: str) -> DataFrame:
    """Rows whose content came up before, with the first row that has it. The first ones come from partial
    aggregates, and a hot digest is split by the join."""
    first = rows.groupBy(digest).agg(F.min(order).alias("first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return rows.join(first, digest).where(F.col(order) != F.col("first")).select(order, "first")


def ledger_state(entries: DataFrame) -> DataFrame:
    """By configuration: refused once a run completed, pending while a run is started but neither completed
    nor acknowledged, else open."""
    runs = entries.groupBy("config", "run").agg(*(F.bool_or(F.col("event") == e).alias(e) for e in ("started", "completed", "acknowledged")))
    pending = F.col("started") & ~F.col("completed") & ~F.col("acknowledged")
    out = runs.groupBy("config").agg(F.bool_or("completed").alias("done"), F.count_if(pending).alias("pending"), F.count("*").alias("runs"))
    return out.select("config", F.when(F.col("done"), "refused").when(F.col("pending") > 0, "pending").otherwise("open").alias("state"), "pending", "runs")


def reviewed(values: DataFrame, decisions: DataFrame) -> DataFrame:
    """Values after human decisions: of rejected cases none, extracted but not legible ones unreadable."""
    rows = values.join(decisions, "case_id", "left")
    kept = rows.where(F.coalesce(F.col("decision") != "reject", F.lit(True)))
    return kept.withColumn("truth_status", F.when((F.col("truth_status") == "extracted") & ~F.coalesce("legible", F.lit(True)), "unreadable").otherwise(F.col("truth_status")))


#: Buckets of a group's items, by the first digits of their hashes.
DIGEST_DIGITS = 3


def set_digest(rows: DataFrame, keys: list[str], item: Column) -> DataFrame:
    """Order-independent content hash of each group's items: of the hashes of its buckets of sorted item
    hashes. A bucket holds a 4096th of a group, and a group at most 4096 buckets."""
    hashed = rows.select(*keys, F.sha2(item, 256).alias("_h"))
    buckets = hashed.groupBy(*keys, F.substring("_h", 1, DIGEST_DIGITS).alias("_b")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list("_h")), "\n"), 256).alias("_d")
    )
    both = F.concat_ws(":", "_b", "_d")
    return buckets.groupBy(*keys).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(both)), "\n"), 256).alias("digest"))


def distractors(items: DataFrame, classes: int, steps: tuple[int, ...]) -> DataFrame:
    """For each item (id, position) the first item of the classes that lie the given steps further, cyclically."""
    first = items.groupBy(F.col("position").alias("_p")).agg(F.min("id").alias("distractor"))
    asked = items.withColumn("step", F.explode(F.array(*(F.lit(s) for s in steps))))
    return asked.join(first, F.pmod(F.col("position") + F.col("step"), F.lit(classes)) == F.col("_p")).select("id", "step", "distractor")
