"""Document quality by a factorisation machine.

Features of a text are its hashed words (square roots of their shares, of unit length), structure
statistics in quantile bins (shares of character classes, repetition of words and lines, word lengths,
text length) and metadata: the recorded number of characters and how far it is from the text's own. The machine's pairwise interactions have rank ``RANK`` and are summed in time linear in
the features: half the difference between the square of a sum and the sum of squares, per factor.

It is fitted on at most ``FIT_ROWS`` labelled documents outside the held-out fold, chosen by a hash of
their ids, in one task; only the machine reaches the driver. Scoring reads every text whole.

Defined results: null and empty texts get the score of a text without words; repeated rows get equal
scores, also in ties at the threshold; a missing or null n_chars is a value of its own; a null doc_id counts as
not held out; a very long text is a batch of its own and costs memory by its distinct words; without both label values the score is their share (0.5
without any); an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import operator
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from extractlab.llm.common import batch_of, bounded, fitted, fold, labelled_sample, table

FIT_ROWS = 12_000
BUCKETS = 1 << 14
BINS = 8
RANK = 8
HELD_OUT, MODULUS = 0, 5
THRESHOLD = 0.3

_CLASSES = np.zeros(256, np.int64)
for _i in range(256):
    _c = chr(_i)
    _CLASSES[_i] = (
        0 if 97 <= _i <= 122 else 1 if 65 <= _i <= 90 else 2 if 48 <= _i <= 57 else 3 if _i == 32 else 4 if _i in (10, 13)
        else 5 if _c in ".,;:'\"()-?" else 6 if _i >= 128 else 7
    )
_STATISTICS = 8 + 7 + 2


def statistics(text: str, words: list[str], counts: Counter, n_chars: int | None) -> list[float]:
    """Structure statistics of a text, then its metadata's."""
    raw = np.frombuffer(text.encode(), np.uint8)
    n = max(1, len(words))
    shares = np.bincount(_CLASSES[raw], minlength=8) / max(1, len(raw))
    lines = [x for x in text.split("\n") if x.strip()]
    top = sorted(counts.values(), reverse=True)[:5]
    return [
        *shares.tolist(),
        np.log1p(len(text)), np.log1p(len(words)), len(raw) / n, 1 - len(counts) / n, sum(top) / n,
        sum(map(operator.eq, words, words[1:])) / n, 1 - len(set(lines)) / max(1, len(lines)),
        *((-1.0, -50.0) if n_chars is None else (np.log1p(max(0, n_chars)), np.arcsinh(float(n_chars - len(text))))),
    ]


def word_features(counts: Counter) -> tuple[np.ndarray, np.ndarray]:
    index = np.fromiter((zlib.crc32(w.encode()) for w in counts), np.int64, len(counts)) % BUCKETS
    share = np.sqrt(np.fromiter(counts.values(), np.float64, len(counts)))
    return index, (share / max(1e-12, np.sqrt((share * share).sum()))).astype(np.float32)


@dataclass
class Machine:
    """The fitted model: bin edges of the statistics, bias, weights and factors."""

    edges: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def logits(self, index: np.ndarray, value: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Of rows given as concatenated features, each beginning at ``rows``; none may be empty."""
        scaled = self.factors[index] * value[:, None]
        total = np.add.reduceat(scaled, rows, axis=0)
        squares = np.add.reduceat(scaled * scaled, rows, axis=0)
        linear = np.add.reduceat(self.weights[index] * value, rows)
        return self.bias + linear + 0.5 * (total * total - squares).sum(axis=1)


def binned(stats: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Feature numbers of the statistics' bins, one for each statistic."""
    return BUCKETS + np.arange(_STATISTICS) * BINS + (stats[:, None] > edges).sum(axis=1)


def fit(stats: np.ndarray, indices: list[np.ndarray], values: list[np.ndarray], label: np.ndarray, *, epochs: int = 6, steps: int = 400, rate: float = 0.02, decay: float = 1e-4) -> Machine:
    """Logistic loss, Adam steps on small batches: as many epochs, and more on few rows until there are enough steps."""
    size = BUCKETS + _STATISTICS * BINS
    batch = 256 if len(label) >= 4096 else 64
    epochs = max(epochs, -(-steps * batch // max(1, len(label))))
    edges = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T if len(stats) else np.zeros((_STATISTICS, BINS - 1))
    share = label.mean() if len(label) else 0.5
    random = np.random.default_rng(5)
    if share in (0.0, 1.0) or not len(label):
        share = min(max(float(share), 1e-3), 1 - 1e-3)
        return Machine(edges, float(np.log(share / (1 - share))), np.zeros(size, np.float32), np.zeros((size, RANK), np.float32))
    m = Machine(edges, float(np.log(share / (1 - share))), np.zeros(size), random.normal(0, 0.02, (size, RANK)))
    rows = [
        (np.append(i, binned(s, edges)).astype(np.int16), np.append(v, np.full(_STATISTICS, 0.3)).astype(np.float32))
        for s, i, v in zip(stats, indices, values, strict=True)
    ]
    moments = [np.zeros((size, RANK + 1)), np.zeros((size, RANK + 1))]
    step = 0
    for _ in range(epochs):
        order = random.permutation(len(rows))
        for at in range(0, len(order), batch):
            own = [rows[j] for j in order[at : at + batch]]
            index = np.concatenate([i for i, _ in own]).astype(np.int64)
            value = np.concatenate([v for _, v in own]).astype(np.float64)
            sizes = np.array([len(i) for i, _ in own])
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            which = np.repeat(np.arange(len(own)), sizes)
            scaled = m.factors[index] * value[:, None]
            total = np.add.reduceat(scaled, starts, axis=0)
            error = (1 / (1 + np.exp(-m.logits(index, value, starts))) - label[order[at : at + batch]]) / len(own)
            pull = error[which] * value
            slope = np.stack(
                [np.bincount(index, pull, size)]
                + [np.bincount(index, pull * (total[which, f] - scaled[:, f]), size) for f in range(RANK)], axis=1,
            )
            slope[:, 0] += decay * m.weights / len(own)
            slope[:, 1:] += decay * m.factors / len(own)
            step += 1
            moments[0] += 0.1 * (slope - moments[0])
            moments[1] += 0.01 * (slope * slope - moments[1])
            move = rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
            m.weights -= move[:, 0]
            m.factors -= move[:, 1:]
            m.bias -= rate * float(error.sum())
    return Machine(edges, m.bias, m.weights.astype(np.float32), m.factors.astype(np.float32))


def recorded(documents: DataFrame) -> Column:
    """The recorded number of characters, null if there is no such column."""
    return (F.col("n_chars") if "n_chars" in documents.columns else F.lit(None)).cast("long")


def train(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Machine:
    sample = F.broadcast(labelled_sample(labels, "quality", MODULUS, HELD_OUT, rows))  # at most ``rows`` rows

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"doc_id": pa.int64(), "label": pa.int32(), "stats": pa.binary(), "index": pa.binary(), "value": pa.binary()}
        for b in bounded(batches, "text", 500, 4 << 20):
            out: dict[str, list] = {k: [] for k in types}
            for doc, label, text, n_chars in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                words = (text or "").split()
                counts = Counter(words)
                index, value = word_features(counts)
                stats = np.array(statistics(text or "", words, counts, n_chars))
                for k, v in zip(types, (doc, label, stats.tobytes(), index.astype(np.int16).tobytes(), value.tobytes()), strict=True):
                    out[k].append(v)
            yield batch_of(types, out)

    def learned(batches: list[pa.RecordBatch]) -> Machine:
        found = sorted((row for b in batches for row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True)), key=lambda r: (r[0], r[2:]))
        return fit(
            np.array([np.frombuffer(r[2]) for r in found]).reshape(-1, _STATISTICS),
            [np.frombuffer(r[3], np.int16) for r in found], [np.frombuffer(r[4], np.float32) for r in found],
            np.array([r[1] for r in found], dtype=float),
        )

    # Repeated document rows beyond the bound are left out of the fit as well.
    found = (
        documents.select("doc_id", "text", recorded(documents).alias("n_chars")).join(sample, "doc_id").select("doc_id", "label", "text", "n_chars")
        .mapInArrow(features, "doc_id bigint, label int, stats binary, index binary, value binary")
        .orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("index")).limit(rows)
    )
    return fitted(found, learned)


def score(documents: DataFrame, model: Machine, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns ``keep`` (doc_id if not given) and the probability of good quality as ``name``."""
    keep = keep or ["doc_id"]
    shared = documents.sparkSession.sparkContext.broadcast(model)  # of fixed size
    schema = documents.select(*keep).schema.add(name, "double")
    read = documents.select(*keep, *(["text"] if "text" not in keep else []), recorded(documents).alias("_n_chars"))
    column, at, size = "text", read.columns.index("text"), len(read.columns) - 1

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in bounded(batches, column, 500, 4 << 20):
            index, value, sizes = [], [], []
            for text, n in zip(b.column(at).to_pylist(), b.column(size).to_pylist(), strict=True):
                words = (text or "").split()
                counts = Counter(words)
                i, v = word_features(counts)
                index += [i, binned(np.array(statistics(text or "", words, counts, n)), m.edges)]
                value += [v, np.full(_STATISTICS, 0.3, np.float32)]
                sizes.append(len(i) + _STATISTICS)
            if sizes:
                starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                z = m.logits(np.concatenate(index), np.concatenate(value), starts).astype(float)
                p = pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], p], names=[*keep, name])

    return read.mapInArrow(scored, schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scores = score(documents, train(documents, table(spark, sf_dir, "labels")))
    return fold(scores, "doc_id", MODULUS).select(
        "doc_id", F.coalesce(F.col("fold") == HELD_OUT, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
