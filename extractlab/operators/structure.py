"""The structure of lists against the truth: extra and absent rows, and what blank rows say of present values.

``lists``: case_id, list_id, status, context (the right profile was used), wanted (the truth has this list),
expected_status, expected_rows (null: none). ``rows``, the actual ones: case_id, list_id, pos, accepted (any cell
was extracted), pages, absent (columns reported missing), matched (the expected row, or null). ``truth``: case_id,
list_id, ix (from 0), pages, present (columns with a value in the document).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIST = ("case_id", "list_id")


def placed(rows: DataFrame) -> DataFrame:
    """Rows with ``ix``: their match, or the place of an unmatched row without an accepted cell, by position among the unmatched
    expected rows of the same gap between matches; null beyond the gap and for the others. Matches rise with the rows."""
    before = F.coalesce(F.max("matched").over(Window.partitionBy(*LIST).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    # A gap's rows are those after one match, up to and with the next.
    gap = Window.partitionBy(*LIST, "_before")
    blank = F.col("matched").isNull() & ~F.col("accepted")
    spot = F.col("_before") + F.sum(blank.cast("int")).over(gap.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    found = rows.withColumn("_before", before).withColumn("_spot", spot).withColumn("_after", F.max("matched").over(gap))
    inside = blank & (F.col("_after").isNull() | (F.col("_spot") < F.col("_after")))
    return found.withColumn("ix", F.coalesce("matched", F.when(inside, F.col("_spot")))).drop("_before", "_spot", "_after")


def blank_row_pairs(rows: DataFrame, truth: DataFrame) -> DataFrame:
    """(case_id, list_id, pos, ix, absent, present): unmatched rows without an accepted cell and the expected rows of their places;
    both must share their pages."""
    blank = placed(rows).where("matched IS NULL AND ix IS NOT NULL")
    met = blank.join(truth.select(*LIST, "ix", F.col("pages").alias("_pages"), "present"), [*LIST, "ix"])
    return met.where(F.size(F.array_except("pages", "_pages")) == 0).select(*LIST, "pos", "ix", "absent", "present")


def structure(lists: DataFrame, rows: DataFrame, truth: DataFrame) -> DataFrame:
    """(case_id, list_structure_errors, confirmed_empty_lists, false_missing_values in blank rows) of every case.

    A list is wrong in structure if the truth has no such list, if an extra row was accepted, or if it claims to be
    complete while rows are extra or absent or the truth itself is not complete."""
    counts = rows.groupBy(*LIST).agg(
        F.count("*").alias("_rows"), F.count_if(F.col("matched").isNull()).alias("_extra"), F.count_if(F.col("matched").isNull() & F.col("accepted")).alias("_accepted"),
    )
    claims = blank_row_pairs(rows, truth).groupBy(*LIST).agg(F.sum(F.size(F.array_intersect("absent", "present"))).alias("_claims"))
    all_lists = lists.join(counts, [*LIST], "left").join(claims, [*LIST], "left")
    return all_lists.groupBy("case_id").agg(*(F.sum(c).alias(k) for k, c in judgement().items()))


def judgement() -> dict[str, Column]:
    """What :func:`structure` counts of a list with the numbers of its rows (null: none): _rows, _extra, _accepted and _claims."""
    rows, extra, accepted, claims = (F.coalesce(c, F.lit(0)) for c in ("_rows", "_extra", "_accepted", "_claims"))
    whole = F.col("wanted") & (F.col("expected_status") == "complete")
    exact = F.col("wanted") & (extra == 0) & (rows == F.col("expected_rows"))
    claimed = F.col("status") == "complete"
    wrong = ~F.col("wanted") | (accepted > 0) | (claimed & ~F.coalesce(exact & whole, F.lit(False)))
    empty = whole & (F.col("expected_rows") == 0) & claimed & (rows == 0) & F.col("context")
    one = lambda c: F.when(c, 1).otherwise(0).cast("long")
    return {"list_structure_errors": one(wrong), "confirmed_empty_lists": one(empty), "false_missing_values": F.when(F.col("context") & F.col("wanted"), claims).otherwise(0).cast("long")}
