"""Nearest neighbours by shifted space-filling curves, as many and as wide as a measured recall asks for.

1. ``MOST_CURVES`` random orthogonal projections to ``DIMS`` dimensions, each shifted at random, are cut into
   a grid whose scale is fitted on a bounded sample; a vector's key is its place on the Hilbert curve
   through the grid. All rows are indexed.
2. How many curves and rows a window needs is measured: for at most ``PROBES`` queries the true neighbours are found by brute
   force, and one scan counts how many rows lie before each of them on every curve. Of the settings that
   bring the probes' recall to ``RECALL`` the cheapest is taken, else the largest.
3. Rows are dealt out by curve and block of its keys, with a copy of what lies near a block's edges in the neighbouring block;
   equal keys are told apart by a hash of the id, so that many equal vectors fill several blocks. Each query meets the
   rows of its window before and after it, and its nearest ones over all curves merge and are ranked again.
4. An exact check follows: the distance of the k-th neighbour found bounds the true one, so the queries, in blocks, are held against
   all rows, in blocks along a curve; a block whose ball lies beyond the bound is skipped, and of the others only
   rows within it come back. What the curves miss (their recall is in the README) is so added.

Distances are Euclidean, in double precision, on the original vectors; ties go to the smaller id.

Defined results: vectors that are null, zero or hold null or non-finite components, or have a null
vec_id, take no part, also as queries; vectors of another length than a query's aren't its candidates;
rows that share a vec_id are one candidate, at the nearest of their distances; with fewer candidates
than k all are returned; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from extractlab.llm.common import batch_of, fitted, table, written
from extractlab.llm.vectors import matrix, one_length, usable

K = 10
MOST_CURVES, DIMS, GRID_BITS = 32, 8, 6
#: Rows of a window on either side; a task holds two windows. The exact check is the way beyond the largest.
WINDOWS = (32, 64, 128, 256, 512, 1024, 2048)
RECALL, PROBES = 0.95, 64
FIT_ROWS = 4096
QUERY_BLOCK, ROW_BLOCK = 8192, 4096
EVERY = 100

FOUND = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}
FOUND_SQL = "query_id bigint, vec_id bigint, score double"


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of grid cells (rows) on the Hilbert curve: the inverse Gray-code walk from the highest bit,
    exchanging or inverting the lower bits of the axes as the curve turns."""
    x = cells.astype(np.uint64).copy()
    n = x.shape[1]
    for q in range(bits - 1, 0, -1):
        bit, low = np.uint64(1 << q), np.uint64((1 << q) - 1)
        for i in range(n):
            on = (x[:, i] & bit) != 0
            swap = np.where(on, np.uint64(0), (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] = np.where(on, x[:, 0] ^ low, x[:, 0] ^ swap)
            x[:, i] ^= swap
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.uint64)
    for q in range(bits - 1, 0, -1):
        turn ^= np.where((x[:, n - 1] & np.uint64(1 << q)) != 0, np.uint64((1 << q) - 1), np.uint64(0))
    x ^= turn[:, None]
    key = np.zeros(len(x), np.uint64)
    for q in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << np.uint64(1)) | ((x[:, i] >> np.uint64(q)) & np.uint64(1))
    return key.astype(np.int64)


@dataclass
class Curves:
    projections: np.ndarray
    low: np.ndarray
    scale: np.ndarray
    #: The sample's keys in order, by curve.
    marks: np.ndarray

    @classmethod
    def fit(cls, vectors: np.ndarray, curves: int = MOST_CURVES, dims: int = DIMS, bits: int = GRID_BITS) -> Curves:
        random = np.random.default_rng(8)
        dim = vectors.shape[1]
        dims = min(dims, dim)
        projections = np.stack([np.linalg.qr(random.normal(size=(dim, dim)))[0][:, :dims] for _ in range(curves)])
        placed = np.einsum("nd,cdk->cnk", vectors, projections)
        low, high = np.quantile(placed, [0.005, 0.995], axis=1)
        width = np.maximum(high - low, 1e-12)
        shift = random.uniform(0, 0.25, low.shape) * width
        made = cls(projections, low - shift, (2**bits - 1) / (1.25 * width), np.zeros((curves, 0), np.int64))
        made.marks = np.sort(np.stack(made.keys(vectors)), axis=1)
        return made

    def keys(self, vectors: np.ndarray, bits: int = GRID_BITS, curves: int = MOST_CURVES) -> list[np.ndarray]:
        out = []
        for p, low, scale in list(zip(self.projections, self.low, self.scale, strict=True))[:curves]:
            cells = np.clip((vectors @ p - low) * scale, 0, 2**bits - 1)
            out.append(hilbert(cells.astype(np.int64), bits))
        return out

    def places(self, curve: int, key: np.ndarray, share: np.ndarray) -> np.ndarray:
        """Where keys lie among the sample's; equal keys are spread by their ``share`` from 0 to 1."""
        first, last = (np.searchsorted(self.marks[curve], key, side) for side in ("left", "right"))
        return first + np.floor(share * (last - first)).astype(np.int64)


def shares(ids: np.ndarray) -> np.ndarray:
    """A number from 0 to 1 of each id, by a multiplicative hash."""
    mixed = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(11)).astype(np.float64) / 2.0**53


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of corresponding rows."""
    return np.sqrt(((a - b) ** 2).sum(axis=1))


def nearest(k: int, ids: np.ndarray, distances: np.ndarray) -> np.ndarray:
    """Numbers of the k nearest distinct ids, ties to the smaller id."""
    order = np.lexsort((ids, distances))
    _, first = np.unique(ids[order], return_index=True)
    return order[np.sort(first)[:k]]


@dataclass(frozen=True)
class Setting:
    curves: int
    window: int


def measured(vectors: DataFrame, curves: Curves, k: int) -> Setting:
    """The cheapest setting with which the probes' windows hold ``RECALL`` of their true neighbours. What reaches the driver is
    bounded: at most ``PROBES`` ids with k neighbours each, their keys, and the counts between these."""
    probes = vectors.where("is_query").orderBy(F.xxhash64("vec_id"), "vec_id").limit(PROBES)
    asked = written(probes.select("vec_id", "embedding", F.lit(float("inf")).alias("radius")), "neighbour-probes")
    near = completed(vectors, asked, k, PROBES)
    truth: dict[int, list[int]] = {}
    for r in ranked(near, k).select("query_id", "vec_id").collect() if near is not None else []:
        truth.setdefault(r["query_id"], []).append(r["vec_id"])
    largest = Setting(MOST_CURVES, WINDOWS[-1])
    if not truth:
        return Setting(1, WINDOWS[0])
    known = sorted({*truth, *(i for own in truth.values() for i in own)})
    shared = vectors.sparkSession.sparkContext.broadcast(curves)  # of fixed size

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = np.array(b.column(0).to_pylist(), np.int64)
            keys = shared.value.keys(matrix(b.column(1)))
            yield batch_of({"vec_id": pa.int64(), "keys": pa.binary()}, {"vec_id": ids, "keys": [np.array(x, np.int64).tobytes() for x in zip(*keys, strict=True)]})

    found = vectors.where(F.col("vec_id").isin(known)).select("vec_id", "embedding").mapInArrow(marked, "vec_id bigint, keys binary").groupBy("vec_id").agg(F.min("keys").alias("keys")).collect()
    ids = np.array([r["vec_id"] for r in found], np.int64)
    keys, share = np.stack([np.frombuffer(r["keys"], np.int64) for r in found]), shares(ids)
    order = np.stack([np.lexsort((share, keys[:, c])) for c in range(MOST_CURVES)])
    bounds = np.take_along_axis(keys.T, order, 1), share[order]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        between = np.zeros((MOST_CURVES, len(ids) + 1), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                own = shares(np.array(b.column(0).to_pylist(), np.int64))
                for c, key in enumerate(shared.value.keys(matrix(b.column(1)))):
                    place = np.searchsorted(bounds[0][c], key)
                    # Among bounds of the same key the share decides.
                    last = np.searchsorted(bounds[0][c], key, "right")
                    for i in np.flatnonzero(last > place):
                        place[i] += np.searchsorted(bounds[1][c][place[i] : last[i]], own[i])
                    between[c] += np.bincount(place, minlength=len(ids) + 1)
        some = np.flatnonzero(between)
        yield batch_of({"pos": pa.int64(), "n": pa.int64()}, {"pos": some, "n": between.ravel()[some]})

    # Added up in Spark, so that the driver gets one number for each bound and curve.
    numbers = vectors.select("vec_id", "embedding").mapInArrow(counted, "pos bigint, n bigint")
    sums = {r["pos"]: r["n"] for r in numbers.groupBy("pos").agg(F.sum("n").alias("n")).collect()}
    before = np.array([sums.get(i, 0) for i in range(MOST_CURVES * (len(ids) + 1))], np.int64).reshape(MOST_CURVES, -1).cumsum(axis=1)[:, :-1]
    rank = np.empty_like(before)
    np.put_along_axis(rank, order, before, 1)
    at = {int(i): n for n, i in enumerate(ids)}
    gaps = np.array([np.abs(rank[:, at[q]] - rank[:, at[i]]) for q, own in truth.items() for i in own if q in at and i in at])
    settings = sorted((Setting(c, w) for c in (4, 8, 16, MOST_CURVES) for w in WINDOWS), key=lambda s: (s.curves * (s.window + WINDOWS[0]), s.curves))
    nearest_gap = np.minimum.accumulate(gaps, axis=1)
    return next((s for s in settings if (nearest_gap[:, s.curves - 1] <= s.window).mean() >= RECALL), largest)


def windows(vectors: DataFrame, curves: Curves, k: int, setting: Setting, rows: int) -> DataFrame:
    """(query_id, vec_id, score): the nearest ones of each query's windows, by curve."""
    shared = vectors.sparkSession.sparkContext.broadcast(curves)  # of fixed size
    window = setting.window
    # A block has about eight windows of rows, and its margins somewhat over one, in places of the sample.
    marks = curves.marks.shape[1]
    per_row = marks / max(1, rows)
    margin = int(np.ceil(window * per_row + 4 * np.sqrt(window * per_row) + 4))
    block = max(2 * margin, int(8 * window * per_row), 1)
    blocks = marks // block + 1

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"place": pa.int64(), "key": pa.int64(), "share": pa.float64(), "vec_id": pa.int64(), "is_query": pa.bool_(), "vector": pa.binary()}
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                v = matrix(b.column(2))
                ids, ask = np.array(b.column(0).to_pylist(), np.int64), np.array(b.column(1).to_pylist(), bool)
                raw, own = np.array([x.tobytes() for x in v] + [None], object)[:-1], shares(ids)
                for c, key in enumerate(shared.value.keys(v, curves=setting.curves)):
                    place = shared.value.places(c, key, own)
                    home = place // block
                    near = [(home, slice(None), ask)]
                    for step, some in ((-1, (place % block < margin) & (home > 0)), (1, (place % block >= block - margin) & (home < blocks - 1))):
                        near.append((home + step, some, np.zeros(len(ids), bool)))
                    for to, some, asks in near:
                        n = len(ids[some])
                        if n:
                            yield batch_of(types, {"place": c * blocks + to[some], "key": key[some], "share": own[some], "vec_id": ids[some], "is_query": asks[some], "vector": raw[some].tolist()})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows in; holds two windows and a batch."""
        held: list[tuple[int, int, bool, bytes]] = []
        begun = 0

        def settle(upto: int) -> pa.RecordBatch:
            out: dict[str, list] = {name: [] for name in FOUND}
            ids = np.array([r[1] for r in held])
            own = np.array([r[0] for r in held])
            v = np.frombuffer(b"".join(r[3] for r in held)).reshape(len(held), -1)
            for i in range(begun, upto):
                if held[i][2]:
                    near = np.arange(max(0, i - window), min(len(held), i + window + 1))
                    near = near[(own[near] == own[i]) & (ids[near] != ids[i])]
                    d = exact(v[near], v[i])
                    best = nearest(k, ids[near], d)
                    out["query_id"] += [held[i][1]] * len(best)
                    out["vec_id"] += ids[near][best].tolist()
                    out["score"] += d[best].tolist()
            return batch_of(FOUND, out)

        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                held += zip(*(b.column(i).to_pylist() for i in (0, 3, 4, 5)), strict=True)
                if len(held) - window > begun:
                    yield settle(len(held) - window)
                    drop = max(0, len(held) - 2 * window)
                    begun = len(held) - window - drop
                    held = held[drop:]
        if held:
            yield settle(len(held))

    rows_ = vectors.select("vec_id", "is_query", "embedding").mapInArrow(
        keyed, "place bigint, key bigint, share double, vec_id bigint, is_query boolean, vector binary"
    )
    return rows_.repartition("place").sortWithinPartitions("place", "key", "share", "vec_id").mapInArrow(scan, FOUND_SQL)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def along(vectors: DataFrame, curves: Curves) -> DataFrame:
    """Rows (vec_id, embedding) in the order of the first curve, so that those of a block lie near one another."""
    shared = vectors.sparkSession.sparkContext.broadcast(curves)  # of fixed size

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = shared.value.keys(matrix(b.column(1)), curves=1)[0] if b.num_rows else []
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), b.column(0), b.column(1)], names=["key", "vec_id", "embedding"])

    rows = vectors.select("vec_id", "embedding").mapInArrow(keyed, "key bigint, vec_id bigint, embedding array<double>")
    return written(rows.repartitionByRange("key", F.xxhash64("vec_id")).sortWithinPartitions("key").drop("key"), "neighbour-blocks")


def completed(vectors: DataFrame, queries: DataFrame, k: int, most: int | None = None) -> DataFrame:
    """(query_id, vec_id, score) of all rows within each query's ``radius``, at most k from a block of rows.

    Rows and queries meet as packed blocks. Query blocks are taken one after another; each is one row of
    bounded size, so it may be broadcast."""
    block = {"ids": pa.binary(), "data": pa.binary(), "radius": pa.binary()}
    sql = "ids binary, data binary, radius binary"

    def packed(most: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, most):
                    b = whole.slice(at, most)
                    ids, radius = (np.array(b.column(i).to_pylist(), t) for i, t in ((0, np.int64), (2, np.float64)))
                    yield batch_of(block, {"ids": [ids.tobytes()], "data": [matrix(b.column(1)).tobytes()], "radius": [radius.tobytes()]})

        return run

    rows = vectors.select("vec_id", "embedding", F.lit(0.0).alias("radius")).mapInArrow(packed(ROW_BLOCK), sql)
    asked = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-(most or queries.count()) // QUERY_BLOCK)))))
    asked = written(asked, "neighbour-queries")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, data, qids, qdata, radius in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                ids, qids, radius = np.frombuffer(ids, np.int64), np.frombuffer(qids, np.int64), np.frombuffer(radius)
                v, q = np.frombuffer(data).reshape(len(ids), -1), np.frombuffer(qdata).reshape(len(qids), -1)
                centre = v.mean(axis=0)
                ball = exact(v, centre).max()
                close = np.flatnonzero(exact(q, centre) - ball <= radius * (1 + 1e-9) + 1e-9)
                vv = (v * v).sum(axis=1)
                out: dict[str, list] = {name: [] for name in FOUND}
                for at in range(0, len(close), 256):
                    some = close[at : at + 256]
                    square = vv[None, :] - 2 * (q[some] @ v.T) + (q[some] ** 2).sum(axis=1)[:, None]
                    bound = radius[some] ** 2
                    # A margin over the expanded square's rounding; distances are then taken exactly.
                    inside = square <= (bound + 1e-9 * (1 + bound + vv.max()))[:, None]
                    for i, one in zip(some, inside, strict=True):
                        near = np.flatnonzero(one & (ids != qids[i]))
                        if len(near):
                            d = exact(v[near], q[i])
                            best = nearest(k, ids[near], d)
                            out["query_id"] += [int(qids[i])] * len(best)
                            out["vec_id"] += ids[near][best].tolist()
                            out["score"] += d[best].tolist()
                yield batch_of(FOUND, out)

    found = None
    for number in [r[0] for r in asked.select("block").distinct().collect()]:
        one = asked.where(F.col("block") == number).select("vec_id", "embedding", "radius").coalesce(1)
        one = one.mapInArrow(packed(2 * QUERY_BLOCK), sql).select(*(F.col(c).alias(f"q_{c}") for c in block))
        pairs = rows.crossJoin(F.broadcast(one)).select("ids", "data", "q_ids", "q_data", "q_radius")
        part = written(pairs.mapInArrow(compare, FOUND_SQL), "neighbours-near")
        found = part if found is None else found.unionByName(part)
    return found


def neighbours(embeddings: DataFrame, is_query: Column, k: int = K, complete: bool = True, setting: Setting | None = None) -> DataFrame:
    """query_id, rank, vec_id and score; with ``complete`` off, what the windows alone find. ``setting`` replaces the measured one."""
    part = written(
        embeddings.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
        .select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("is_query")),
        "neighbour-vectors",
    )
    found = None
    for dim in one_length(part):
        own = part.where(F.size("embedding") == dim)
        drawn = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("embedding")
        curves = fitted(drawn, lambda batches: Curves.fit(np.concatenate([matrix(b.column(0)) for b in batches if b.num_rows])))
        near = windows(own, curves, k, setting or measured(own, curves, k), own.count())
        if complete:
            near = written(ranked(near, k), "neighbours-found")
            bounds = near.where(F.col("rank") == k).select("query_id", F.col("score").alias("radius"))
            asked = own.where("is_query").join(bounds, F.col("vec_id") == F.col("query_id"), "left").select(
                "vec_id", "embedding", F.coalesce("radius", F.lit(float("inf"))).alias("radius")
            )
            more = completed(along(own, curves), asked, k)
            near = near.select(*FOUND) if more is None else near.select(*FOUND).unionByName(more)
        found = near.select(*FOUND) if found is None else found.unionByName(near.select(*FOUND))
    if found is None:
        found = embeddings.sparkSession.createDataFrame([], FOUND_SQL)
    return ranked(found, k).select("query_id", "rank", "vec_id", "score")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)
