"""Near-duplicate embeddings by a forest of random-projection trees.

1. Equal vectors of a label form a class with a representative (smallest id) and a size (different ids).
2. Each tree splits recursively: a node projects on a random direction and splits at the median of a
   bounded sample; a vector within the spill margin of the split goes to both sides. A vector descends
   as deep as its label has vectors for; where the sample has too few in a node, that node splits where
   its last ancestor with enough would. No split goes through a crowd: a group of near copies stays in
   one node, whose leaf is then large.
3. Vectors of one label in one leaf are compared, in blocks where a leaf is large. A pair that shares
   several leaves is counted in the first one only, so no pairs need to be shuffled for that: a task
   returns how many vectors each one links with, and a spanning forest of the links.

With spill margin m a tree separates two vectors only if their projections differ by over 2m around a
split; in a spread-out cloud, margins and the number of trees make a missed link at the threshold rarer
than one in a million. For groups of near copies this is tested on a large one, not proved.

Defined results: vectors that are null, zero or hold null or non-finite components, and those with a
null label or vec_id, have no links and are kept (component: their own id); vectors of different
lengths never link; equal vectors are linked; rows equal in vec_id, label and vector count once as each
other's partners; rows that share a vec_id only are one node of the components, and each has the links of its
own vector, to others of that id as well; a similarity of exactly the limit links; an empty table gives no
rows; extra columns are not read; labels may be of any type.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from extractlab.llm.common import batch_of, table, written
from extractlab.llm.components import connected_components
from extractlab.llm.vectors import matrix, sample, usable

SIMILARITY = 0.98
TREES = 6
LEAF = 128
SPILL = 0.6
FIT_ROWS = 8192
#: A node splits by its own rows of the sample if it has so many.
ENOUGH = 8
MOST_DEPTH = 16
#: A node is split only where at most this share of it is within two margins (about 0.19 in an isotropic cloud).
CROWDED = 0.3
BLOCK = 1024


def split_of(p: np.ndarray, reach: float) -> float:
    """The median of the projections ``p``, or another quantile where too many lie within reach of it; if
    that holds for all of them, no split (minus infinity: every vector goes right)."""
    for q in (0.5, 0.4, 0.6, 0.3, 0.7, 0.2, 0.8):
        at = np.quantile(p, q)
        if (np.abs(p - at) < reach).mean() <= CROWDED:
            return at
    return -np.inf


@dataclass
class Forest:
    """For each tree and level a direction, and the splits of the nodes in heap order."""

    directions: np.ndarray
    splits: list[list[np.ndarray]]
    margin: float

    @classmethod
    def fit(cls, unit: np.ndarray, dim: int, depth: int, trees: int, similarity: float) -> Forest:
        random = np.random.default_rng(2)
        directions = random.normal(size=(trees, depth, dim))
        directions /= np.linalg.norm(directions, axis=2, keepdims=True)
        margin = SPILL * np.sqrt(2 * (1 - similarity)) / np.sqrt(dim)
        splits = []
        for t in range(trees):
            # What nodes split by: their own rows of the sample, or those of an ancestor (index in ``sources``).
            node, source, own = np.zeros(len(unit), np.int64), np.zeros(1, np.int64), []
            sources = [np.arange(len(unit))]
            for level in range(depth):
                p = unit @ directions[t, level]
                own.append(np.array([split_of(p[rows], 2 * margin) if len(rows) >= ENOUGH else 0.0 for rows in sources])[source])
                node = 2 * node + (p >= own[-1][node])
                source = np.repeat(source, 2)
                order = np.argsort(node, kind="stable")
                names, first = np.unique(node[order], return_index=True)
                for k, rows in zip(names, np.split(order, first[1:]), strict=True):
                    if len(rows) >= ENOUGH:
                        source[k] = len(sources)
                        sources.append(rows)
                used, source = np.unique(source, return_inverse=True)
                sources = [sources[i] for i in used]
            splits.append(own)
        return cls(directions, splits, margin)

    def leaves(self, unit: np.ndarray, depth: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each tree the row numbers and their leaves; a row may be in several. ``depth`` of each row, the
        forest's if not given."""
        out = []
        for t, own in enumerate(self.splits):
            row, node = np.arange(len(unit)), np.zeros(len(unit), np.int64)
            done = []
            for level, at in enumerate(own):
                if depth is not None:
                    stays = depth[row] <= level
                    done.append((row[stays], node[stays]))
                    row, node = row[~stays], node[~stays]
                gap = (unit @ self.directions[t, level])[row] - at[node]
                left, right = gap < self.margin, gap >= -self.margin
                row = np.concatenate((row[left], row[right]))
                node = np.concatenate((2 * node[left], 2 * node[right] + 1))
            done.append((row, node))
            out.append((np.concatenate([r for r, _ in done]), np.concatenate([k for _, k in done])))
        return out


def routed(classes: DataFrame, forest: Forest) -> DataFrame:
    """(label, leaf, vec_id, h, size, leaves, unit): a row for each leaf that a class is in."""
    shared = classes.sparkSession.sparkContext.broadcast(forest)  # at most TREES * 2^MOST_DEPTH splits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"label": pa.string(), "leaf": pa.int32(), "vec_id": pa.int64(), "h": pa.int64(), "size": pa.int64(), "leaves": pa.binary(), "unit": pa.binary()}
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                v = matrix(b.column(5))
                unit = v / np.linalg.norm(v, axis=1, keepdims=True)
                depth = len(shared.value.splits[0])
                rows, codes = [], []
                for t, (row, node) in enumerate(shared.value.leaves(unit, np.array(b.column(4).to_pylist()))):
                    rows.append(row)
                    codes.append((t << depth) + node)
                row, code = np.concatenate(rows), np.concatenate(codes)
                order = np.lexsort((code, row))
                row, code = row[order], code[order].astype(np.int32)
                sets = [x.tobytes() for x in np.split(code, np.flatnonzero(np.diff(row)) + 1)]
                label, vec, h, size = (b.column(i).to_pylist() for i in range(4))
                units = [x.tobytes() for x in unit]
                yield batch_of(types, {
                    "label": [label[r] for r in row], "leaf": code, "vec_id": [vec[r] for r in row], "h": [h[r] for r in row], "size": [size[r] for r in row],
                    "leaves": [sets[r] for r in row], "unit": [units[r] for r in row],
                })

    return classes.select("label", "vec_id", "h", "size", "depth", "embedding").mapInArrow(
        run, "label string, leaf int, vec_id bigint, h bigint, size bigint, leaves binary, unit binary"
    )


def earlier_leaves(leaves, leaf: int) -> np.ndarray:
    """For each row which of the group's leaves before this one it is in, as a 0/1 matrix."""
    sets = [np.frombuffer(x, np.int32) for x in leaves]
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    code = np.concatenate(sets)
    row, code = row[code < leaf], code[code < leaf]
    names, column = np.unique(code, return_inverse=True)
    out = np.zeros((len(sets), len(names)), np.float32)
    out[row, column] = 1
    return out


def least_reached(n: int, ids: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of ``n`` rows the smallest id that it reaches by links between rows x and y."""
    order = np.argsort(ids, kind="stable")
    label = np.empty(n, np.int64)
    label[order] = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[order[new]]
        if (new == label).all():
            return ids[order[label]]
        label = new


def compared(rows: DataFrame, similarity: float) -> DataFrame:
    """(u, h, v, n): v null: u's class h links with n further vectors; n null: u and v are connected."""
    sizes = rows.groupBy("label", "leaf").agg(F.count("*").alias("n")).where("n > 1")
    sizes = written(sizes.select("label", "leaf", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "forest-leaves")
    own = F.pmod(F.col("h"), F.col("blocks")).cast("int")
    dealt = (
        rows.join(sizes, ["label", "leaf"]).withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("label", "leaf", "vec_id", "h", "size", "leaves", "unit", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    )

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        i, j, leaf = group["i"].iat[0], group["j"].iat[0], group["leaf"].iat[0]
        block, ids, size = (group[k].to_numpy() for k in ("own", "vec_id", "size"))
        unit = np.frombuffer(b"".join(group["unit"])).reshape(len(group), -1)
        earlier = earlier_leaves(group["leaves"], leaf)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        further, xs, ys = np.zeros(len(group), np.int64), [], []
        for at in range(0, len(left), 256):
            some = left[at : at + 256]
            linked = unit[some] @ unit[right].T >= similarity
            if i == j:
                linked &= some[:, None] < right[None, :]
            if linked.any():
                x, y = np.nonzero(linked)
                xs.append(some[x])
                ys.append(right[y])
                first = linked & (earlier[some] @ earlier[right].T == 0)
                further[some] += first @ size[right]
                further[right] += size[some] @ first
        counted = np.flatnonzero(further)
        root = least_reached(len(group), ids, np.concatenate(xs), np.concatenate(ys)) if xs else ids
        joined = np.flatnonzero(root != ids)
        return pd.DataFrame({
            "u": pd.array([*ids[counted], *ids[joined]], "Int64"),
            "h": pd.array([*group["h"].to_numpy()[counted]] + [None] * len(joined), "Int64"),
            "v": pd.array([None] * len(counted) + [*root[joined]], "Int64"),
            "n": pd.array([*further[counted]] + [None] * len(joined), "Int64"),
        })

    return dealt.groupBy("label", "leaf", "i", "j").applyInPandas(compare, "u bigint, h bigint, v bigint, n bigint")


def near_vectors(embeddings: DataFrame, similarity: float = SIMILARITY, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """vec_id, n_links and component_id of every row."""
    label = F.col("label").cast("string")
    part = embeddings.where(usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()).select(
        "vec_id", "embedding", label.alias("label")
    )
    classes = written(
        part.distinct().groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("size"))
        .withColumn("h", F.xxhash64("label", "embedding")), "vector-classes",
    )
    levels = F.least(F.greatest(F.ceil(F.log2(F.col("n") / leaf)), F.lit(0)), F.lit(MOST_DEPTH)).cast("int")
    deep = written(
        classes.groupBy("label", F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).withColumn("depth", levels), "vector-labels"
    )
    found = None
    for row in deep.groupBy("dim").agg(F.max("depth").alias("depth")).collect():  # a few lengths of vectors
        own = classes.where(F.size("embedding") == row["dim"])
        unit = np.array([r[0] for r in sample(own, FIT_ROWS, "embedding")], dtype=float).reshape(-1, row["dim"])
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        own = own.join(deep.where(F.col("dim") == row["dim"]).select("label", "depth"), "label")
        one = compared(routed(own, Forest.fit(unit, row["dim"], row["depth"], trees, similarity)), similarity)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return embeddings.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    found = written(found, "vector-links")
    # Ids with several vectors tie the classes of these together.
    several = part.select("vec_id", F.xxhash64("label", "embedding").alias("h")).groupBy("vec_id").agg(F.min("h").alias("x"), F.max("h").alias("y"))
    several = part.join(several.where("x <> y").select("vec_id"), "vec_id")
    tied = several.withColumnRenamed("vec_id", "v").join(classes, ["label", "embedding"]).select(F.col("vec_id").alias("u"), "v")
    components = written(connected_components(found.where("v IS NOT NULL").select("u", "v").unionByName(tied)), "vector-components")
    further = found.where("v IS NULL").groupBy("u", F.col("h").alias("u_h")).agg(F.sum("n").alias("more"))
    settled = (
        classes.join(further, (F.col("vec_id") == F.col("u")) & (F.col("h") == F.col("u_h")), "left")
        .join(components, F.col("vec_id") == F.col("node"), "left")
        .select(
            F.col("label").alias("of_label"), F.col("embedding").alias("of_embedding"),
            (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("links"), F.coalesce("component", "vec_id").alias("component"),
        )
    )
    return embeddings.select("vec_id", "embedding", label.alias("label")).join(
        settled, (F.col("label") == F.col("of_label")) & (F.col("embedding") == F.col("of_embedding")) & F.col("vec_id").isNotNull(), "left"
    ).select("vec_id", F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_vectors(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
