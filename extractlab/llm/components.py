"""Connected components of an undirected graph by alternating large-star and small-star steps.

Runs of at most ``EDGES`` edges are first contracted to stars within tasks. If no more than that many
edges remain in all, one task finishes; otherwise the stars alternate. Every such step is a join and a
shuffle over edges; its result is written to the scratch folder. A node with very many neighbours is
split by the skew handling of sort-merge joins, since both inputs of each join are plain exchanges of
written tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from extractlab.llm.common import batch_of, written

EDGES = 200_000


def roots(pairs: Iterator[tuple[int, int]]) -> dict[int, int]:
    """Every node of some edges with the smallest node it reaches."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


def contracted(edges: DataFrame) -> DataFrame:
    """Stars with the same components, from runs of at most ``EDGES`` edges in each task."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"u": pa.int64(), "v": pa.int64()}
        own: list[tuple[int, int]] = []

        def star() -> pa.RecordBatch:
            found = [(x, r) for x, r in roots(iter(own)).items() if x != r]
            return batch_of(types, {"u": [x for x, _ in found], "v": [r for _, r in found]})

        for b in batches:
            own += zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
            if len(own) >= EDGES:
                yield star()
                own = []
        if own:
            yield star()

    return edges.select("u", "v").mapInArrow(contract, "u bigint, v bigint")


def starred(stars: DataFrame) -> DataFrame:
    """(node, component) of stars (u, v), whose centres v are their smallest nodes."""
    own = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return own.unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def connected_components(edges: DataFrame, most: int = EDGES) -> DataFrame:
    """(node, component) for all nodes of the edges (u, v); a component is its smallest node. One task
    takes the last step over at most ``most`` edges."""
    now = written(contracted(edges.where("u <> v")).distinct(), "components")
    seen = None
    while True:
        size, total = now.select(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if size <= min(most, EDGES):
            return starred(written(contracted(now.repartition(1)), "components") if size else now)
        if seen == (size, total):
            return starred(now)
        seen = (size, total)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "components-least")
        large = written(
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "components-large"
        )
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "components-least")
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
        now = written(small.distinct(), "components")
