"""Rules of the ground truth and of a corpus' sources, as named conditions; see ``contracts.violations``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from extractlab.operators.rules import subset, unique


def value_rules(status: Column, present: Column, value: Column, allowed: Column, pages: Column, readable: Column) -> dict[str, Column]:
    """Of one expected value; ``present`` null: not known. ``readable``: the quality of its case."""
    there = F.coalesce(present, F.lit(False))
    absent = F.coalesce(~present, F.lit(False))
    return {
        "invalid_page": F.exists(pages, lambda p: p < 1) | ~unique(pages),
        "extracted_needs_value_presence_page": (status == "extracted") & (value.isNull() | ~there | (F.size(pages) == 0)),
        "value_forbidden": (status != "extracted") & (value.isNotNull() | (F.size(allowed) > 0)),
        "missing_needs_absence": (status == "missing") & ~absent,
        "absence_needs_missing": absent & (status != "missing"),
        "redundant_allowed_value": ~unique(allowed) | F.coalesce(F.array_contains(allowed, value), F.lit(False)),
        "readable_present_needs_value": readable & there & (status != "extracted"),
    }


def row_rules(pages: Column, fields: Column, cell_pages: Column) -> dict[str, Column]:
    """Of one expected row; ``cell_pages``: the pages of each cell."""
    return {
        "row_without_pages": F.size(pages) == 0, "row_without_cells": F.size(fields) == 0, "cell_repeated": ~unique(fields),
        "invalid_row_page": ~unique(pages) | F.exists(pages, lambda p: p < 1), "cell_page_outside_row": ~subset(F.flatten(cell_pages), pages),
    }


def list_rules(status: Column, enumerated: Column, reason: Column, read: Column, resolved: Column, keys: Column) -> dict[str, Column]:
    """Of one expected list. ``read``: a cell was extracted; ``resolved``: all cells were, or are missing."""
    return {
        "row_repeated": ~unique(keys),
        "complete_needs_enumeration_resolution": (status == "complete") & ~(enumerated & resolved),
        "partial_needs_read_and_unresolved": (status == "partial") & (~read | (enumerated & resolved)),
        "unresolved_needs_reason_and_nothing_read": (status == "unresolved") & (read | reason.isNull()),
        "reason_needs_unresolved": (status != "unresolved") & reason.isNotNull(),
    }


def outcome_rules(matching: Column, profile: Column, outcome: Column, accepted: Column, resolved: Column, anything: Column) -> dict[str, Column]:
    """Of the expected outcome. ``accepted``: a value or cell was extracted or a list is confirmed empty; ``resolved``: all
    fields are extracted or missing and all lists complete; ``anything``: fields or lists were given at all."""
    derived = F.when(~accepted, "failed").when(resolved, "complete").otherwise("partial")
    matched = matching == "matched"
    return {
        "matched_needs_profile": matched & F.coalesce(profile == "", F.lit(True)),
        "matched_refused": matched & (outcome == "refused"),
        "outcome_inconsistent": matched & (outcome != "refused") & (outcome != derived),
        "refusal_with_extraction": ~matched & (profile.isNotNull() | (outcome != "refused") | anything),
    }


def artifact_rules(kind: Column, sha256: Column, simulated: Column, verified: Column) -> dict[str, Column]:
    return {
        "invalid_sha256": ~F.coalesce(sha256.rlike("^[0-9a-f]{64}$"), F.lit(False)),
        "simulation_needs_photo": simulated & (kind != "photo"),
        "delivery_needs_real_photo": verified & ((kind != "photo") | simulated),
    }


def pending_rules(source: Column, quality: Column, delivery: Column, condition: Column, sent_quality: Column, printed: Column, inputs: Column, artifact: Column) -> dict[str, Column]:
    """Of a planned case and the capture it waits for; ``source`` null: none."""
    pending = source.isNotNull()
    by_chat = F.coalesce(source == "chat", F.lit(False))
    hard, readable = quality == "difficult", quality == "readable"
    return {
        "chat_quality_exactly_for_chat": pending & (by_chat != sent_quality.isNotNull()),
        "difficult_needs_capture": hard & (~pending | condition.isNull() | printed.isNull()),
        "readable_photo_needs_chat": ~hard & readable & (delivery == "photo") & (~by_chat | condition.isNotNull()),
        "unexpected_pending": ~hard & ~(readable & (delivery == "photo")) & pending,
        "camera_only_for_difficult": pending & ~by_chat & ~hard,
        "pending_must_be_only_input": pending & ((delivery != F.when(by_chat, "photo").otherwise("image_file")) | ~inputs.eqNullSafe(F.array(artifact))),
        "only_difficult_is_printed": ~hard & printed.isNotNull(),
    }
