"""Merging readings of many batches: explicit abstention instead of voting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Reasons of an unresolved list, the strongest first.
REASONS = ("ambiguous", "invalid", "unreadable", "missing")


def readings_of(raw: Column, normal: Column | None) -> Column:
    """What readings are compared by: the normal form, or the raw text where it has none."""
    return raw if normal is None else F.coalesce(normal, raw)


def merge_scalars(readings: DataFrame, keys: list[str], traversed: Column | None = None, normal: Column | None = None) -> DataFrame:
    """One status and raw value for each key from its readings (batch, status, raw and, if present, pages).

    Any ambiguous reading, or two that differ in their normal forms, is ambiguous; else the first extracted one wins,
    else the first invalid one; without any, unreadable outranks missing. ``normal`` is the normal form of
    ``raw``, null if it has none, and of numbers only. Pages are the union in the order of the batches.
    One shuffle, partial aggregates only."""
    given = F.col("status").isin("extracted", "invalid")
    what = F.when(given, readings_of(F.col("raw"), normal))
    first = {s: F.min_by(F.when(F.col("status") == s, F.col("raw")), F.when(F.col("status") == s, F.col("batch"))) for s in ("extracted", "invalid")}
    more = [] if normal is None else [F.min_by(F.when(F.col("status") == "extracted", normal), F.when(F.col("status") == "extracted", F.col("batch"))).alias("_normal")]
    if "pages" in readings.columns:
        more.append(F.array_sort(F.collect_list(F.struct("batch", "pages"))).alias("_pages"))  # a field's batches
    flags = readings.withColumn("_traversed", F.lit(True) if traversed is None else traversed).groupBy(*keys).agg(
        (F.bool_or(F.col("status") == "ambiguous") | F.coalesce(F.min(what) != F.max(what), F.lit(False))).alias("_ambiguous"),
        F.bool_or(F.col("status") == "extracted").alias("_extracted"), F.bool_or(F.col("status") == "invalid").alias("_invalid"),
        (F.bool_or(F.col("status") == "unreadable") | ~F.bool_and("_traversed")).alias("_unreadable"),
        first["extracted"].alias("_raw"), first["invalid"].alias("_broken"), F.count("*").alias("batches"), *more,
    )
    status = (
        F.when(F.col("_ambiguous"), "ambiguous").when(F.col("_extracted"), "extracted").when(F.col("_invalid"), "invalid")
        .when(F.col("_unreadable"), "unreadable").otherwise("missing")
    )
    raw = F.when(status == "extracted", F.col("_raw")).when(status == "invalid", F.col("_broken"))
    extra = [] if normal is None else [F.when(status == "extracted", F.col("_normal")).alias("normalized")]
    if "pages" in readings.columns:
        extra.append(F.array_distinct(F.flatten(F.transform("_pages", lambda x: x["pages"]))).alias("pages"))
    return flags.select(*keys, status.alias("status"), raw.alias("raw"), *extra, "batches")


def outcome(fields: DataFrame, lists: DataFrame, keys: list[str], traversed: Column | None = None) -> DataFrame:
    """Of fields (status) and lists (status, accepted cells, rows): failed without any accepted value or
    confirmed empty list, complete if nothing is open and all was traversed, else partial."""
    confirmed = (F.col("status") == "complete") & (F.col("rows") == 0)
    parts = fields.select(
        *keys, (F.col("status") == "extracted").alias("some"), F.col("status").isin("extracted", "missing").alias("settled"), F.lit(1).alias("field")
    ).unionByName(lists.select(
        *keys, ((F.col("accepted") > 0) | confirmed).alias("some"), (F.col("status") == "complete").alias("settled"), F.lit(0).alias("field")
    ))
    whole = F.lit(True) if traversed is None else traversed
    found = parts.groupBy(*keys).agg(F.bool_or("some").alias("some"), F.bool_and("settled").alias("settled"), F.sum("field").alias("fields"), F.count("*").alias("results"))
    state = F.when(~F.col("some"), "failed").when(F.col("settled") & whole, "complete").otherwise("partial")
    return found.select(*keys, state.alias("outcome"), "fields", "results")


def strongest(*present: Column) -> Column:
    """The strongest of ``REASONS`` that is present (a condition for each), else null."""
    return F.coalesce(*(F.when(c, r) for r, c in zip(REASONS, present, strict=True)))


def list_status(cells: DataFrame, keys: list[str], whole: Column, complete: Column, reason: Column) -> DataFrame:
    """A list's status and reason after its cells (status) changed. ``whole``: all was enumerated;
    ``complete`` and ``reason``: what the list was before. Only an unresolved list has a reason: the strongest of
    its cells and its own, ambiguous without any; missing counts as unreadable unless all was enumerated."""
    flags = [F.bool_or(F.coalesce((F.col("status") == r) | (F.col("_reason") == r), F.lit(False))) for r in REASONS]
    found = cells.withColumn("_whole", whole).withColumn("_complete", complete).withColumn("_reason", reason).groupBy(*keys).agg(
        F.bool_and("_whole").alias("_whole"), F.bool_and("_complete").alias("_complete"), strongest(*flags).alias("_worst"),
        F.bool_or(F.col("status") == "extracted").alias("_some"), F.bool_and(F.col("status").isin("extracted", "missing")).alias("_settled"),
    )
    status = F.when(F.col("_whole") & F.col("_settled") & F.col("_complete"), "complete").when(F.col("_some"), "partial").otherwise("unresolved")
    worst = F.coalesce("_worst", F.lit("ambiguous"))
    worst = F.when((worst == "missing") & ~F.col("_whole"), "unreadable").otherwise(worst)
    return found.select(*keys, status.alias("status"), F.when(status == "unresolved", worst).alias("reason"))


def drop_replays(rows: DataFrame, keys: list[str], order: str, cells: list[str]) -> DataFrame:
    """One row for each source key: identical replays vanish, a different one makes its cells ambiguous
    and the list not enumerated."""
    first = [F.min_by(c, order).alias(c) for c in cells]
    differ = [F.coalesce(F.min(c) != F.max(c), F.lit(False)).alias(f"_{c}") for c in cells]
    out = rows.groupBy(*keys).agg(*first, *differ, F.count("*").alias("replays"))
    conflict = F.lit(False)
    for c in cells:
        conflict = conflict | F.col(f"_{c}")
    return out.select(
        *keys, "replays", *(F.when(~F.col(f"_{c}"), F.col(c)).alias(c) for c in cells),
        *(F.when(F.col(f"_{c}"), "ambiguous").otherwise("extracted").alias(f"{c}_status") for c in cells), (~conflict).alias("enumerated"),
    )


def stitch(rows: DataFrame, key: str, order: str, cells: list[str]) -> DataFrame:
    """Rows that continue across a batch boundary joined to one; a half without its other half is
    unresolved. A joined row takes its right part's flag, so only neighbours matter."""
    by = Window.partitionBy(key).orderBy(order)
    joined = F.coalesce(F.lag("continues_next").over(by), F.lit(False)) & F.col("continues_previous")
    follows = F.coalesce(F.lead("continues_previous").over(by), F.lit(False))
    flagged = rows.withColumn("_joined", joined).withColumn(
        "_lone", (F.col("continues_previous") & ~F.col("_joined")) | (F.col("continues_next") & ~follows)
    ).withColumn("island", F.sum(F.when(F.col("_joined"), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    lone = F.bool_or("_lone")
    return flagged.groupBy(key, "island").agg(
        F.count("*").alias("parts"), lone.alias("lone"),
        *(F.when(lone | (F.min(c) != F.max(c)), "ambiguous").otherwise("extracted").alias(f"{c}_status") for c in cells),
        *(F.when(~lone & (F.min(c) == F.max(c)), F.min(c)).alias(c) for c in cells),
    )


def contiguous(spans: DataFrame, key: str, order: str) -> DataFrame:
    """For each key the first position whose span (first, last) does not follow on the one before."""
    by = Window.partitionBy(key).orderBy(order)
    expected = F.coalesce(F.lag("last").over(by) + 1, F.lit(1))
    broken = spans.withColumn("_want", expected).where("first <> _want")
    return broken.groupBy(key).agg(
        F.min(order).alias("position"),
        F.min_by(F.when(F.col("first") < F.col("_want"), "overlap").otherwise("gap"), order).alias("problem"),
    )


def misplaced_flags(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Continuation flags inside a batch: previous may stand on its first row only, next on its last."""
    by = Window.partitionBy(key).orderBy(order)
    last = F.lead(order).over(by).isNull()
    place = rows.withColumn("_n", F.row_number().over(by)).withColumn("_last", last)
    return place.groupBy(key).agg(
        F.count_if(F.col("continues_previous") & (F.col("_n") > 1)).alias("previous_misplaced"), F.count_if(F.col("continues_next") & ~F.col("_last")).alias("next_misplaced")
    )
