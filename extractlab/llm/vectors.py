"""Embedding tables: which rows take part, and packing vectors as bytes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(embedding: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(embedding.isNotNull() & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def matrix(column) -> np.ndarray:
    """An Arrow list column as rows of doubles; all lists must have one length."""
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def sample(vectors: DataFrame, rows: int, *columns: str) -> list:
    """At most ``rows`` rows in the order of a hash: what trees and curves are fitted on."""
    return vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(rows).select(*columns).collect()


def one_length(vectors: DataFrame) -> list[int]:
    """The lengths that occur; vectors are compared within a length only. A few values at most in practice."""
    return sorted(r[0] for r in vectors.select(F.size("embedding")).distinct().collect())
