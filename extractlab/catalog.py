"""All registered queries of the library outside the training-data subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from extractlab.plans import admission, alignments, assembled, lists, operations, ordered, planning, recognition, replays, replies, reports, rules, scalars, truth, typed  # noqa: F401  they register their queries
from extractlab.plans.registry import ORACLES, QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
