"""Centroid clustering by plain Lloyd rounds, in whole numbers.

1. A vector's components become ``floor(1024 * x)`` and are written once, packed, to the shared folder.
2. The centroids start as the kept vectors with the smallest hashes of their ids, in that order.
3. Each round broadcasts the centroids (``clusters * dims`` numbers, whatever the table's size); a task takes
   the squared differences to one centroid after another in NumPy, and the smallest distance with the lowest
   number wins. A task emits whole sums for each centroid and component; ``groupBy`` merges these, and what reaches
   the driver are ``clusters * (dims + 1)`` numbers. A round without a move ends the rounds, as the others would repeat it.
4. After the rounds every vector is assigned once more.

No step deals vectors out by cluster, so the sizes of clusters don't matter. All sums are exact: within a task
in 64 bits, across tasks as decimals.

Defined results: vectors that are null, of another length than ``dims`` or hold null or non-finite components
aren't kept and get no row; repeated rows each count and each get a row; a null vec_id counts, but is chosen
as a first centroid after all others; of equal hashes the vector with the smaller bytes comes first; with fewer kept vectors than
``clusters`` there are as many centroids as vectors; ties go to the smaller number; empty centroids stay;
components beyond ``LIMIT`` (|x| of 131072 or more, where a distance would pass a long) count as the limit;
an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from extractlab.llm.common import table, written

DIMS, CLUSTERS, ROUNDS, SEED = 64, 8, 10, 3
SCALE, LIMIT = 1024.0, 1 << 27
#: Vectors that a task turns into 64-bit differences at once.
SLICE = 4096


def kept(embedding: Column, dims: int) -> Column:
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(embedding.isNotNull() & (F.size(embedding) == dims) & finite, F.lit(False))


def packed(embeddings: DataFrame, dims: int) -> DataFrame:
    """(vec_id, v): the kept vectors as whole numbers, 32 bits each."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), SLICE):
                some = b.iloc[at : at + SLICE]
                x = np.stack(some["embedding"].to_list()).astype(np.float64)
                with np.errstate(over="ignore"):
                    whole = np.clip(np.floor(x * SCALE), -LIMIT, LIMIT).astype("<i4")
                yield pd.DataFrame({"vec_id": some["vec_id"].to_numpy(), "v": [row.tobytes() for row in whole]})

    own = embeddings.where(kept(F.col("embedding"), dims)).select(F.col("vec_id").cast("string").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return written(own.mapInPandas(pack, "vec_id string, v binary").select(F.col("vec_id").cast("long").alias("vec_id"), "v"), "lloyd-vectors")


def numbers(column: pd.Series, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<i4").reshape(len(column), dims)


def first_centroids(vectors: DataFrame, clusters: int, dims: int, seed: int) -> np.ndarray:
    """The kept vectors with the smallest hashes of ``seed:vec_id``."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = vectors.withColumn("name", name).orderBy(F.col("name").asc_nulls_last(), "v").limit(clusters).select("v").collect()
    return np.array([np.frombuffer(r["v"], "<i4") for r in chosen], np.int64).reshape(len(chosen), dims)


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's nearest centroid, the lowest of equals, and the squared distance."""
    distances = np.empty((len(centroids), len(v)), np.int64)
    for number, c in enumerate(centroids):
        d = v - c
        np.einsum("ij,ij->i", d, d, out=distances[number])
    number = distances.argmin(axis=0)
    return number, distances[number, np.arange(len(v))]


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round."""
    k, dims = centroids.shape
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for b in batches:
            for at in range(0, len(b), SLICE):
                v = numbers(b["v"].iloc[at : at + SLICE], dims).astype(np.int64)
                number, _ = nearest(v, shared.value)
                np.add.at(count, number, 1)
                for c in np.unique(number):
                    sums[c] += v[number == c].sum(axis=0)
        some = np.flatnonzero(count)
        whole = np.column_stack((count, sums))[some]  # place 0 is the count
        yield pd.DataFrame({"cluster": np.repeat(some, dims + 1).astype(np.int32), "place": np.tile(np.arange(dims + 1, dtype=np.int32), len(some)), "part": whole.ravel()})

    parts = vectors.select("v").mapInPandas(summed, "cluster int, place int, part long")
    rows = parts.groupBy("cluster", "place").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("whole")).collect()
    found = {(r["cluster"], r["place"]): int(r["whole"]) for r in rows}
    out = centroids.copy()
    for c in {c for c, _ in found}:
        out[c] = [found[c, i] // found[c, 0] for i in range(1, dims + 1)]
    shared.unpersist()
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    dims = centroids.shape[1]
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), SLICE):
                some = b.iloc[at : at + SLICE]
                number, distance = nearest(numbers(some["v"], dims).astype(np.int64), shared.value)
                yield pd.DataFrame({"vec_id": some["vec_id"].to_numpy(), "cluster": number.astype(np.int32), "distance": distance})

    ids = F.col("vec_id").cast("string").alias("vec_id")  # nulls stay null in pandas
    return vectors.select(ids, "v").mapInPandas(assign, "vec_id string, cluster int, distance long").withColumn("vec_id", F.col("vec_id").cast("long"))


def lloyd(embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every kept vector after the rounds, and the final centroids."""
    vectors = packed(embeddings, dims)
    centroids = first_centroids(vectors, clusters, dims, seed)
    for _ in range(rounds if len(centroids) else 0):
        now = moved(vectors, centroids)
        if (now == centroids).all():
            break
        centroids = now
    if not len(centroids):
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    return written(assigned(vectors, centroids), "lloyd-assigned"), centroids


def op11_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = lloyd(table(spark, sf_dir, "embeddings"))
    inertia = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    most = (1 << 63) - 1
    whole = min(most, sum(inertia.values()))
    rows = [(c, min(most, d), whole, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in sorted(inertia.items())]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # a row for each centroid
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
