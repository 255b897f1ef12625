"""Whether a corpus may be measured, and whether a plan has the composition that was agreed: rules over all cases of a corpus.

Every rule is an aggregate with partial sums (counts by declared label, no distinct over data), so corpora of any number
and size are judged in one pass; see ``corpus.reasons``. The labels that must be covered are parameters.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

QUALITIES = ("readable", "difficult", "negative")


def n(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def covers(value: Column, labels: Iterable[str], least: int = 1, among: Column | None = None) -> Column:
    """Whether each label comes up often enough."""
    among = F.lit(True) if among is None else among
    met = F.lit(True)
    for x in labels:
        met = met & (n(among & (value == x)) >= least)
    return met


def only(value: Column, labels: Iterable[str], among: Column | None = None) -> Column:
    among = F.lit(True) if among is None else among
    return n(among & ~F.coalesce(value.isin(*labels), F.lit(False))) == 0


def different(value: Column, labels: Iterable[str], among: Column) -> Column:
    """How many of the labels come up."""
    return sum((F.when(n(among & (value == x)) > 0, 1).otherwise(0) for x in labels), F.lit(0))


def eligibility(mode: str, split: Column, scripts: Iterable[str], categories: Iterable[str]) -> dict[str, Column]:
    """Why a corpus can't be measured in a mode. Columns of a case: purpose, reviewed (verified, with ground truth), script, category,
    quality, delivery_path, sealed (and frozen), simulated and verified (any and all of its inputs' deliveries), captured (all physically)."""
    c = F.col
    readable, difficult, photo = c("quality") == "readable", c("quality") == "difficult", c("delivery_path") == "photo"
    found = {
        "review_preparation_only": n(c("purpose") != "quality_measurement") > 0, "human_review_or_ground_truth_pending": n(~c("reviewed")) > 0,
        "wrong_split": n(split != ("tuning" if mode == "calibration" else "benchmark")) > 0,
        "diversity_incomplete": ~(covers(c("script"), scripts) & only(c("script"), scripts) & covers(c("category"), categories) & only(c("category"), categories) & covers(c("quality"), QUALITIES) & only(c("quality"), QUALITIES)),
    }
    if mode == "calibration":
        return found | {"tuning_case_count_below_twenty": F.count("*") < 20}
    return found | {
        "benchmark_composition_incomplete": (n(readable) != 40) | (n(difficult) != 20) | (n(c("quality") == "negative") != 10), "benchmark_not_sealed_and_frozen": n(~c("sealed")) > 0,
        "benchmark_image_delivery_paths_incomplete": ~covers(c("delivery_path"), ("photo", "image_file"), 1, readable), "benchmark_telegram_photo_delivery_unverified": n(photo & (c("simulated") | ~c("verified"))) > 0,
        "benchmark_difficult_cases_require_physical_photographs": n(difficult & ~c("captured")) > 0, "benchmark_physical_photo_coverage_incomplete": n(difficult & photo & c("captured") & ~c("simulated")) < 10,
    }


def composition(scripts: Iterable[str], categories: Iterable[str], conditions: Iterable[str], scenarios: Iterable[str], layouts: Iterable[str], new_layouts: Iterable[str]) -> dict[str, Column]:
    """What a plan of cases lacks. Besides the columns above: crosses (a list goes over pages), splits (a record does), source and
    sent_quality and condition of the capture it waits for, inputs (their number), scenario, layout, table_style, printed, profiles
    (their number), owner."""
    c = F.col
    readable, difficult, negative = (c("quality") == q for q in QUALITIES)
    path = c("delivery_path")
    wanted = Counter(scenarios)
    agreed = n(negative) == sum(wanted.values())
    for x, k in wanted.items():
        agreed = agreed & (n(negative & (c("scenario") == x)) == k)
    fresh = sum((F.when(n(readable & ((c("layout") == x) | (c("table_style") == x))) > 0, 1).otherwise(0) for x in new_layouts), F.lit(0))
    pages = F.when(difficult, c("printed"))
    return {
        "quality_composition": (n(readable) != 40) | (n(difficult) != 20) | (n(negative) != 10) | (F.count("*") != 70),
        "readable_script_coverage": ~covers(c("script"), scripts, 6, readable), "readable_category_coverage": ~covers(c("category"), categories, 4, readable),
        "readable_delivery_split": (n(readable & (path == "image_file")) != 24) | (n(readable & (path == "pdf")) != 8) | (n(readable & (path == "photo")) != 8),
        "readable_multipage_list_across_boundary": n(readable & (path == "pdf") & c("crosses")) < 3, "readable_record_split_across_boundary": n(readable & (path == "pdf") & c("splits")) == 0,
        "readable_telegram_quality_split": (n(readable & (c("sent_quality") == "standard")) != 4) | (n(readable & (c("sent_quality") == "hd")) != 4),
        "readable_two_sided_cards": n(readable & (path == "image_file") & (c("inputs") == 2) & (c("scenario") == "two_sided_card")) < 2,
        "readable_layout_variety": (fresh < 2) | (different(c("layout"), layouts, readable) < 4),
        "difficult_condition_coverage": ~covers(c("condition"), conditions, 3, difficult), "difficult_telegram_photo_count": n(difficult & (c("source") == "chat")) < 10,
        "difficult_script_coverage": ~(covers(c("script"), scripts, 1, difficult) & only(c("script"), scripts, difficult)), "difficult_category_coverage": different(c("category"), categories, difficult) < 6,
        "printable_pages": (F.count_distinct(pages) != n(difficult)) | (n(difficult) > 0) & ((F.min(pages) != 1) | (F.max(pages) != n(difficult))),
        "negative_scenarios": ~agreed, "profile_library": ~F.coalesce(F.min("owner") == F.max("owner"), F.lit(False)) | (n(c("owner").isNull()) > 0) | (n(c("profiles") != 3) > 0),
    }
