"""Smaller rules of the contracts: declarations, references, coverage, environments, previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How ground truth can have been checked; the last only for public material.
METHODS = ("script_reading", "glyph_sequence_comparison", "published_transcription")
#: What an environment is made of, with the code of a difference, in order.
COMPONENTS = (
    ("code_sha256", "code_hash_mismatch"), ("prompt", "prompt_mismatch"), ("runtime_artifacts", "runtime_artifacts_mismatch"),
    ("runtime_profile", "runtime_profile_mismatch"), ("core", "core_settings_mismatch"), ("dependencies", "dependency_versions_mismatch"),
)
#: The states of a job, with those that may follow. Any may finish.
NEXT_STATES = {
    "collecting": ("admission",), "admission": ("queued",), "queued": ("delivering", "awaiting_choice", "awaiting_instruction", "restarting"),
    "awaiting_choice": ("queued", "awaiting_instruction", "restarting"), "awaiting_instruction": ("compiling", "queued", "restarting"),
    "compiling": ("awaiting_confirmation", "awaiting_instruction", "restarting"), "awaiting_confirmation": ("saving", "awaiting_instruction", "restarting"),
    "saving": ("queued", "awaiting_choice", "awaiting_confirmation", "awaiting_instruction", "restarting"), "delivering": (), "restarting": ("collecting",), "finishing": (),
}
#: Failures that may come from the time spent.
BUDGET_CODES = ("processing_budget_exhausted", "runtime_timeout", "worker_timeout")
IDLE_ACTOR = 3600
MAX_DRAFTS = 10
PREVIEW_UNITS = 3900


def subset(part: Column, whole: Column) -> Column:
    return F.size(F.array_except(part, whole)) == 0


def unique(values: Column) -> Column:
    return F.size(F.array_distinct(values)) == F.size(values)


def recognition_rules(outcome: Column, derived: Column, traversed: Column, missing_fields: Column, finished_lists: Column, missing_cells: Column) -> dict[str, Column]:
    """The derived outcome must agree, and what was not traversed can't be known to be missing or complete."""
    return {"outcome_disagrees": outcome != derived, "untraversed_claims": ~traversed & (missing_fields | finished_lists | missing_cells)}


def validator_rules(kind: Column, formats: Column, codes: Column) -> dict[str, Column]:
    """Of a declared format check: kind, date formats and allowed codes (arrays, never null)."""
    def parts(f: Column) -> Column:
        return F.array_sort(F.regexp_extract_all(f, F.lit("%."), F.lit(0)))

    wanted = F.array(F.lit("%Y"), F.lit("%d"), F.lit("%m"))
    return {
        "codes_required": (kind == "iso_code") & (F.size(codes) == 0), "codes_forbidden": (kind != "iso_code") & (F.size(codes) > 0),
        "formats_forbidden": (kind != "calendar_date") & (F.size(formats) > 0), "formats_repeated": ~unique(formats),
        "formats_incomplete": F.exists(formats, lambda f: parts(f) != wanted), "codes_inexact": F.exists(codes, lambda c: (c == "") | (F.trim(c) != c)), "codes_repeated": ~unique(codes),
    }


def call_rules(kind: Column, stage: Column, batch: Column) -> dict[str, Column]:
    return {"call_stage_mismatch": (kind != "token_count") & (kind != stage), "call_batch_mismatch": (stage == "matching") != batch.isNull()}


def result_rules(field: Column, wanted: Column, kind: Column, status: Column, raw: Column, normalized: Column, normal: Column, pages: Column, available: Column) -> dict[str, Column]:
    """One field's result against its declaration: ``normal`` is the recomputed normal form, null if there is none."""
    taken = status == "extracted"
    return {
        "not_requested": field != wanted, "pages_unavailable": ~subset(pages, available), "pages_invalid": ~unique(pages) | F.exists(pages, lambda p: p < 1),
        "number_without_normal_form": taken & (kind == "number") & normal.isNull(),
        "normalization_unjustified": taken & normalized.isNotNull() & ~normalized.eqNullSafe(normal),
        "date_not_iso": taken & (kind == "date") & normalized.isNotNull() & (~normalized.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") | F.try_to_timestamp(normalized, F.lit("yyyy-MM-dd")).isNull()),
    }


def rejects(memberships: DataFrame, keys: list[str]) -> DataFrame:
    """Batches of which any page does not belong to the document."""
    return memberships.groupBy(*keys).agg(F.bool_or(F.col("membership") == "no").alias("mixed"))


def applicable_methods(origin: Column) -> Column:
    return F.when(origin == "permitted_public", F.array(*(F.lit(m) for m in METHODS))).otherwise(F.array(*(F.lit(m) for m in METHODS[:-1])))


def retirable(signed_in: Column, awaiting: Column, active: Column, settings_open: Column, idle: Column, now: Column, last: Column) -> Column:
    return ~signed_in & ~awaiting & ~active & ~settings_open & idle & (now - last >= IDLE_ACTOR)


def environment_mismatches(same: dict[str, Column]) -> Column:
    """The codes of the components that differ; ``same``: component to whether it is equal."""
    return F.array_compact(F.array(*(F.when(~same[name], code) for name, code in COMPONENTS if name in same)))


def boundary_context(rows: DataFrame, keys: list[str], order: str, cells: list[str]) -> DataFrame:
    """The last row of each batch's list, where it continues in the next batch."""
    last = F.max_by(F.struct("continues_next", *cells), order)
    return rows.groupBy(*keys).agg(last.alias("_last")).where("_last.continues_next").select(*keys, *(F.col(f"_last.{c}").alias(c) for c in cells))


def external(results: DataFrame, keys: list[str]) -> DataFrame:
    """What may leave: status and accepted value, no candidate."""
    value = F.when(F.col("status") == "extracted", F.coalesce("normalized", "raw"))
    return results.select(*keys, "status", value.alias("value"))


def decision_problems(expected: DataFrame, given: DataFrame, keys: list[str]) -> DataFrame:
    """By case the first problem of its review decisions: a value decided twice, unknown, or left out."""
    counted = given.groupBy("case_id", *keys).agg(F.count("*").alias("_n"))
    both = expected.select("case_id", *keys, F.lit(True).alias("_wanted")).join(counted, ["case_id", *keys], "full")
    rank = F.when(F.col("_n") > 1, 1).when(F.col("_wanted").isNull(), 2).when(F.col("_n").isNull(), 3).otherwise(4)
    names = F.array(*(F.lit(x) for x in ("review_decision_duplicate_value", "review_decision_unknown_value", "review_decisions_incomplete")))
    return both.groupBy("case_id").agg(F.min(rank).alias("_r")).where("_r < 4").select("case_id", F.element_at(names, F.col("_r")).alias("problem"))


def artifact_problems(artifacts: DataFrame, files: DataFrame) -> DataFrame:
    """Declared artifacts (id, sha256) without a file, with other content, and files that no artifact declares."""
    both = artifacts.select("id", F.col("sha256").alias("_want")).join(files.select("id", F.col("sha256").alias("_got")), "id", "full")
    problem = F.when(F.col("_got").isNull(), "file_missing").when(F.col("_want").isNull(), "undeclared").when(F.col("_got") != F.col("_want"), "hash_mismatch")
    return both.select("id", problem.alias("problem")).where("problem IS NOT NULL")


def image_size(exif: Column, width: Column, height: Column, limit: int) -> Column:
    """struct<width, height, allowed>; orientations 5 to 8 lie on their side."""
    turned = exif.between(5, 8)
    return F.struct(F.when(turned, height).otherwise(width).alias("width"), F.when(turned, width).otherwise(height).alias("height"), (width.cast("long") * height <= limit).alias("allowed"))


def preview_parts(text: Column) -> Column:
    """All of a text in parts of at most ``PREVIEW_UNITS`` UTF-16 units; no surrogate pair is split. Several parts are numbered."""
    plain = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % PREVIEW_UNITS), F.lit(0))
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("n"))

    def add(a: Column, c: Column) -> Column:
        size = F.when(F.octet_length(c) == 4, 2).otherwise(1)
        full = a["n"] + size > PREVIEW_UNITS
        return F.struct(
            F.when(full, F.array_append(a["done"], a["now"])).otherwise(a["done"]).alias("done"),
            F.when(full, c).otherwise(F.concat(a["now"], c)).alias("now"), F.when(full, size).otherwise(a["n"] + size).alias("n"),
        )

    paired = F.aggregate(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), empty, add, lambda a: F.array_append(a["done"], a["now"]))
    parts = F.when(text.rlike(r"[\x{10000}-\x{10FFFF}]"), paired).otherwise(plain)
    named = F.transform(parts, lambda p, i: F.concat(F.lit("Preview part "), (i + 1).cast("string"), F.lit("/"), F.size(parts).cast("string"), F.lit("\n"), p))
    return F.when(F.size(parts) > 1, named).otherwise(parts)


def credited(values: DataFrame, identity: list[str], order: list[str]) -> DataFrame:
    """Of correct values with one identity only the first counts; the others are incorrect."""
    rank = F.row_number().over(Window.partitionBy(*identity).orderBy((~F.col("matches")).cast("int"), *order))
    return values.withColumn("correct", F.col("matches") & (rank == 1))


def usable_probabilities(values: Column) -> Column:
    """Not empty, and all finite within 0 and 1."""
    return F.coalesce((F.size(values) > 0) & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & x.between(0.0, 1.0)), F.lit(False))


def probability_map(tokens: DataFrame, keys: list[str], pointer: str, order: str, value: str) -> DataFrame:
    """By key a map of pointers to their tokens' probabilities in order; null where they can't be used."""
    lists = tokens.groupBy(*keys, pointer).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("_l"))  # tokens of one value
    values = F.transform("_l", lambda x: x[value])
    entries = lists.select(*keys, F.struct(F.col(pointer), F.when(usable_probabilities(values), values)).alias("_e"))
    return entries.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.col("_e")))).alias("probabilities"))


def undetermined(budget: int | None, skipped: Column, skipped_error: Column, code: Column, elapsed: Column) -> Column:
    """Whether a recorded failure need not happen to a job that skips calls: it spent time or broke the runtime on them."""
    budgeted = (skipped > 0) & code.isin(*BUDGET_CODES)
    if budget is not None:
        budgeted = budgeted & (elapsed > budget)
    return skipped_error | budgeted


def list_spread(rows: DataFrame, keys: list[str], list_: str, pages: str) -> DataFrame:
    """By key whether any of its lists lies on more than one page, and whether any one row does. Partial sums: a list's
    pages are more than one if their smallest and largest differ."""
    low, high = F.array_min(pages), F.array_max(pages)
    lists = rows.groupBy(*keys, list_).agg((F.min(low) < F.max(high)).alias("_several"), F.bool_or(F.size(pages) > 1).alias("_split"))
    return lists.groupBy(*keys).agg(F.bool_or(F.coalesce("_several", F.lit(False))).alias("crosses_pages"), F.bool_or("_split").alias("record_split"))


def transitions() -> list[tuple[str, str]]:
    """All pairs of a job's state and one that may follow it."""
    return sorted({(a, b) for a, then in NEXT_STATES.items() for b in (*then, *(("finishing",) if a != "finishing" else ()))})


def illegal_transitions(log: DataFrame, job: str, order: str, state: str) -> DataFrame:
    """Steps of a job's log that its states do not allow; the first state must be collecting."""
    before = F.lag(state).over(Window.partitionBy(job).orderBy(order))
    steps = log.select(job, order, before.alias("a"), F.col(state).alias("b"))
    allowed = F.map_from_entries(F.array(*(F.struct(F.lit(a), F.array(*(F.lit(y) for x, y in transitions() if x == a)).cast("array<string>")) for a in NEXT_STATES)))
    fine = F.when(F.col("a").isNull(), F.col("b") == "collecting").otherwise(F.array_contains(F.element_at(allowed, F.col("a")), F.col("b")))
    return steps.where(~F.coalesce(fine, F.lit(False)))


def draft_problems(drafts: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """By profile whether its drafts refer to its current fields: at most ``MAX_DRAFTS``, every index used once and there."""
    sizes = current.groupBy(key).agg(F.count("*").alias("_size"))
    found = drafts.groupBy(key).agg(
        F.count("*").alias("drafts"), F.count("source_index").alias("_given"), F.count_distinct("source_index").alias("_different"), F.max("source_index").alias("_most"), F.min("source_index").alias("_least")
    ).join(sizes, key, "left")
    problem = (
        F.when(F.col("drafts") > MAX_DRAFTS, "too_many").when(F.col("_given") > F.col("_different"), "index_repeated")
        .when((F.col("_most") > F.coalesce("_size", F.lit(0))) | (F.col("_least") < 1), "index_out_of_range")
    )
    return found.select(key, "drafts", problem.alias("problem"))


def canonical_json(row: dict[str, Column]) -> Column:
    """Compact JSON with its keys in order."""
    return F.to_json(F.struct(*(row[k].alias(k) for k in sorted(row))), {"ignoreNullFields": "false"})

