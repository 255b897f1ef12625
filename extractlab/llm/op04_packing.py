"""Best-fit packing of documents into fixed-length token sequences by linear grouping.

1. Documents are encoded once; longer ones are cut, and one row for each piece is written out.
2. Only the histogram of piece lengths (at most ``capacity`` rows) reaches the driver. Large lengths
   are put in groups of equal cardinality and rounded up to the longest of their
   group; the cutting-stock programme over these few sizes is solved by column generation.
3. Actual lengths are substituted for the rounded ones, which frees space; what the rounding of the
   solution left over and then the small lengths are placed best-fit into the tightest open space.
4. The plan is a list of runs: "the documents of length l with ranks lo to hi go, c to a sequence, to
   sequences from s on, at offset o". A piece finds its place by its rank among pieces of its length.

Ranks are taken within salted parts of a length, so one length may hold any share of the rows; the salt
comes from a number that each piece gets when it is cut, so equal rows spread as well.

Defined results: a null or empty text is a piece of one token (the end id); repeated rows are packed
separately; null doc_ids are packed like others; pieces of one length are alike, their order is that of
their numbers; a very long text is encoded alone in its batch; an empty table gives no rows; extra columns
are not read.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from extractlab.llm.common import batch_of, bounded, table, written
from extractlab.llm.tokens import default_path, encoder

CAPACITY = 2048
END_ID = 0
#: Lengths over capacity / s count as large; of these s, the plan with the fewest sequences is taken.
LARGE = (2, 3, 4)
GROUPS = 160
#: Rows that one salted part of a length holds on average, at most.
PART_ROWS = 20_000

PIECES = {
    "doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "number": pa.int64(),
}


def pieces(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """One row for each piece: a document's ids and its end id, cut into pieces of ``capacity`` ids of
    which the first may be shorter. Numbers differ, but may change when a task is run again: write them."""
    path = tokenizer or default_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        numbers = itertools.count(TaskContext.get().partitionId() << 40)
        for b in bounded(batches, "text", 1000, 8 << 20):
            out: dict[str, list] = {k: [] for k in PIECES}
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(enc.encode(text or ""), np.uint32(END_ID)).astype("<u4")
                first = len(ids) % capacity or capacity
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for k, (s, e) in enumerate(zip(edges, edges[1:], strict=False)):
                    for name, v in zip(PIECES, (doc, k, s, e - s, zlib.crc32(ids[s:e].tobytes()), next(numbers)), strict=True):
                        out[name].append(v)
            yield batch_of(PIECES, out)

    return documents.select("doc_id", "text").mapInArrow(
        cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, number bigint"
    )


@dataclass
class Plan:
    """Runs (length, lo, hi, copies, sequence, offset) and the number of sequences."""

    capacity: int
    runs: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0
    #: Free space to the (first sequence, count) runs that have it.
    open: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    used: dict[int, int] = field(default_factory=dict)

    def place(self, length: int, lo: int, n: int, copies: int, sequence: int, offset: int) -> None:
        self.runs.append((length, lo, lo + n, copies, sequence, offset))

    def opened(self, free: int, first: int, count: int) -> None:
        if free > 0 and count > 0:
            self.open.setdefault(free, []).append((first, count))

    def best_fit(self, length: int, lo: int, n: int) -> None:
        """Place ``n`` documents of one length, each into the sequence with the least sufficient space."""
        while n > 0:
            free = min((f for f in self.open if f >= length), default=None)
            if free is None:
                each = self.capacity // length
                self.opened(self.capacity, self.sequences, -(-n // each))
                self.sequences += -(-n // each)
                continue
            first, count = self.open[free].pop()
            if not self.open[free]:
                del self.open[free]
            each = free // length
            offset = self.capacity - free
            full = min(count, n // each)
            if full:
                self.place(length, lo, full * each, each, first, offset)
                self.opened(free - each * length, first, full)
                lo, n = lo + full * each, n - full * each
            if full < count and n and n < each:
                self.place(length, lo, n, n, first + full, offset)
                self.opened(free - n * length, first + full, 1)
                full, n = full + 1, 0
            self.opened(free, first + full, count - full)


def grouped(histogram: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Groups of equal cardinality, longest first, as (length, count) lists. A length may span groups;
    groups of one and the same length are joined."""
    left, out = sum(histogram.values()), []
    quota = -(-left // groups) if left else 0
    now: list[tuple[int, int]] = []
    room = quota
    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            take = min(n, room)
            now.append((length, take))
            n, room = n - take, room - take
            if not room:
                if out and len(now) == 1 and out[-1][-1][0] == length and len(out[-1]) == 1:
                    out[-1] = [(length, out[-1][0][1] + now[0][1])]
                else:
                    out.append(now)
                now, room = [], quota
    return [*out, now] if now else out


def best_pattern(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within the capacity, by dynamic programming over its
    number of members, which is small because every size is large."""
    most = capacity // int(sizes.min())
    best = np.zeros(capacity + 1)
    choices = []
    at = np.arange(capacity + 1)[:, None] - sizes[None, :]
    fits = at >= 0
    for _ in range(most):
        gain = np.where(fits, best[np.maximum(at, 0)] + values[None, :], -np.inf)
        pick = gain.argmax(axis=1)
        new = gain[np.arange(capacity + 1), pick]
        better = new > best + 1e-12
        choices.append(np.where(better, pick, -1))
        best = np.where(better, new, best)
    pattern = np.zeros(len(sizes), dtype=np.int64)
    space = capacity
    for pick in reversed(choices):
        if (g := int(pick[space])) >= 0:
            pattern[g] += 1
            space -= int(sizes[g])
    return float(best[capacity]), pattern


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 1000) -> list[tuple[np.ndarray, int]]:
    """Patterns and whole numbers of sequences: the relaxed cutting-stock programme by column
    generation over a basis, rounded down."""
    k = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / (capacity // sizes))
    x = inverse @ demand
    for step in range(rounds):
        value, pattern = best_pattern(sizes, inverse.sum(axis=0), capacity)
        # The optimum is at least sum(x) / value: stop when less than half a sequence could be won.
        if value <= 1 + 1e-7 or x.sum() * (1 - 1 / value) < max(0.5, 1e-5 * x.sum()):
            break
        direction = inverse @ pattern
        ratios = np.where(direction > 1e-9, x / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(ratios.argmin())
        basis[:, out] = pattern
        if step % 400 == 399:
            inverse = np.linalg.inv(basis)
            x = np.maximum(inverse @ demand, 0)
        else:
            pivot = inverse[out] / direction[out]
            theta = ratios[out]
            x = x - theta * direction
            x[out] = theta
            inverse = inverse - np.outer(direction, pivot)
            inverse[out] = pivot
    return [(basis[:, j].astype(np.int64), int(np.floor(x[j] + 1e-9))) for j in range(k) if x[j] >= 1 - 1e-9]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large: tuple[int, ...] = LARGE) -> Plan:
    """Where every rank of every length goes."""
    return min((plan_from(histogram, capacity, groups, s) for s in large), key=lambda p: p.sequences)


def plan_from(histogram: dict[int, int], capacity: int, groups: int, small: int) -> Plan:
    """The plan in which lengths over ``capacity / small`` are grouped and the others fill up."""
    out = Plan(capacity)
    taken = dict.fromkeys(histogram, 0)

    def take(length: int, n: int) -> int:
        taken[length] += n
        return taken[length] - n

    if n := histogram.get(capacity, 0):
        out.place(capacity, take(capacity, n), n, 1, 0, 0)
        out.sequences = n
    large = {length: n for length, n in histogram.items() if capacity // small < length < capacity}
    queues = grouped(large, groups) if large else []
    if queues:
        sizes = np.array([q[0][0] for q in queues])
        demand = np.array([sum(n for _, n in q) for q in queues], dtype=float)
        for pattern, copies in configurations(sizes, demand, capacity):
            slots = [g for g in range(len(queues)) for _ in range(int(pattern[g]))]
            copies = min([copies, *(sum(n for _, n in queues[g]) // int(pattern[g]) for g in set(slots))])
            while copies:
                # As many sequences alike as no slot's length runs out within. A group's slots share its queue.
                heads = {g: queues[g][0] for g in set(slots)}
                same = min(copies, *(heads[g][1] // int(pattern[g]) for g in heads))
                lengths: list[tuple[int, int]] = []
                if same:
                    for g in heads:
                        length, n = heads[g]
                        lengths.append((length, int(pattern[g])))
                        queues[g][0] = (length, n - same * int(pattern[g]))
                else:
                    same = 1
                    for g in heads:
                        need = int(pattern[g])
                        while need:
                            length, n = queues[g][0]
                            use = min(need, n)
                            lengths.append((length, use))
                            need -= use
                            queues[g][0] = (length, n - use)
                            if n == use:
                                queues[g].pop(0)
                offset = 0
                for length, each in lengths:
                    out.place(length, take(length, same * each), same * each, each, out.sequences, offset)
                    offset += length * each
                for g in heads:
                    while queues[g] and not queues[g][0][1]:
                        queues[g].pop(0)
                out.opened(capacity - offset, out.sequences, same)
                out.sequences += same
                copies -= same
    for length in sorted(histogram, reverse=True):
        if n := histogram[length] - taken[length]:
            out.best_fit(length, take(length, n), n)
    return out


def pack(parts: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``. ``parts`` must be a written table: it is read twice."""
    spark = parts.sparkSession
    total = parts.count()
    salts = max(64, total // PART_ROWS)
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("number"), F.lit(salts)))
    counts = written(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "piece-counts")
    # At most ``capacity`` rows reach the driver.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = plan(histogram, capacity, groups).runs
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("number")
    ranked = (
        salted.withColumn("rank", F.row_number().over(within) - 1)
        .join(offsets, ["length", "salt"])
        .withColumn("rank", F.col("rank") + F.col("before"))
    )
    schema = "run_length bigint, lo bigint, hi bigint, copies bigint, first bigint, at bigint"
    # The plan's size is bounded by the numbers of lengths and groups, not by the data.
    places = F.broadcast(spark.createDataFrame(runs, schema))
    local = F.col("rank") - F.col("lo")
    return ranked.join(
        places, (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    ).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first") + F.floor(local / F.col("copies"))).alias("sequence_id"),
        (F.col("at") + (local % F.col("copies")) * F.col("length")).alias("offset"),
    )


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(written(pieces(table(spark, sf_dir, "documents")), "pieces"))
