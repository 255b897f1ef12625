"""Typed contracts as rules over rows: each rule names what a row breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Error codes by the state that they put a case in.
TIMEOUTS = ("processing_budget_exhausted", "runtime_timeout")
REFUSALS = ("unsupported_format", "damaged_input", "encrypted_pdf", "pixel_limit")
#: Limits of captured photos, and the codes of what is wrong with one.
FILE_LIMIT = 20 * 1024 * 1024
CHAT_SIDES = {"standard": 1280, "hd": 2560}
CAMERA_LEAST_SIDE = 2561
PIXEL_LIMIT = 89_478_485
CAPTURE_CODES = {
    "format": "not_jpeg", "pixels": "pixel_limit", "gps": "location_metadata_present", "standard": "telegram_standard_size_mismatch",
    "hd": "telegram_hd_size_mismatch", "camera": "camera_original_too_small", "file": "exceeds_bot_api_file_limit",
}


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The rows once for each rule that they break, named in ``rule``. One pass, no shuffle."""
    return rows.withColumn("rule", F.explode(F.array_compact(F.array(*(F.when(c, name) for name, c in rules.items())))))


def field_rules(status: Column, raw: Column, normalized: Column, pages: Column) -> dict[str, Column]:
    return {
        "raw_required": (status == "extracted") & raw.isNull(),
        "raw_forbidden": ~status.isin("extracted", "invalid") & raw.isNotNull(),
        "normalized_forbidden": (status != "extracted") & normalized.isNotNull(),
        "pages_required": raw.isNotNull() & (pages == 0),
    }


def list_rules(status: Column, whole: Column, reason: Column, accepted: Column, resolved: Column) -> dict[str, Column]:
    """``accepted``: whether any cell was extracted; ``resolved``: whether all cells were, or are missing."""
    return {
        "complete_needs_enumeration_and_cells": (status == "complete") & ~(whole & resolved),
        "partial_needs_accepted_cell": (status == "partial") & ~accepted,
        "unresolved_has_accepted_cell": (status == "unresolved") & accepted,
        "unresolved_needs_reason": (status == "unresolved") & reason.isNull(),
        "reason_forbidden": (status != "unresolved") & reason.isNotNull(),
        "partial_is_complete": (status == "partial") & whole & resolved,
    }


def coverage_gaps(wanted: DataFrame, given: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of one side only: missing if wanted, unexpected if given."""
    sides = wanted.distinct().withColumn("_w", F.lit(True)).join(given.distinct().withColumn("_g", F.lit(True)), keys, "full")
    return sides.where("_w IS NULL OR _g IS NULL").select(*keys, F.when(F.col("_g").isNull(), "missing").otherwise("unexpected").alias("gap"))


def capture_reasons(format_: Column, pixels: Column, gps: Column, source: Column, sent: Column, side: Column, size: Column) -> Column:
    """Why a captured photo can't be used. Another format or too many pixels is the only reason that is given; a chat
    photo is held against the longest side of the quality that it was sent in, a camera original against a least
    side and the largest file."""
    hd = sent == "hd"
    chat = (side > F.when(hd, CHAT_SIDES["hd"]).otherwise(CHAT_SIDES["standard"])) | (hd & (side <= CHAT_SIDES["standard"]))
    codes = CAPTURE_CODES
    more = F.array_compact(F.array(
        F.when(gps, codes["gps"]), F.when((source == "telegram") & chat, F.when(hd, codes["hd"]).otherwise(codes["standard"])),
        F.when((source == "camera") & (side < CAMERA_LEAST_SIDE), codes["camera"]), F.when((source == "camera") & (size > FILE_LIMIT), codes["file"]),
    ))
    return F.when(format_ != "JPEG", F.array(F.lit(codes["format"]))).when(pixels > PIXEL_LIMIT, F.array(F.lit(codes["pixels"]))).otherwise(more)


def failure_state(code: Column) -> Column:
    return F.when(code.isin(*TIMEOUTS), "timeout").when(code.isin(*REFUSALS), "input_refused").otherwise("failed")


def allowed_log(rows: DataFrame, event: Column, text: Column, events: list[str], pattern: str) -> DataFrame:
    return rows.where(event.isin(*events) & text.rlike(pattern))


def accepted_value(status: Column, normalized: Column, raw: Column) -> Column:
    return F.when(status == "extracted", F.coalesce(normalized, raw))
