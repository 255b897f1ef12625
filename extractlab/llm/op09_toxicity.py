"""Toxic passages by maximum-scoring segments of token log-odds.

1. Words of labelled documents are counted by class; words and stems that the toxic class favours
   significantly become the lexicon. The Dirichlet prior of their log-odds is their count over all
   documents, scaled to at most ``PRIOR`` pseudo-words.
2. A token's score is the logarithm of its likelihood in a toxic passage against the background. An
   entry's log-odds compare toxic with clean documents; a passage is denser than its document by
   1 / ``PASSAGE``, and entries make up the share ``DENSITY`` of its tokens. Other tokens lose a little.
3. A linear scan finds every maximal scoring segment of a text. Its score is turned into the
   probability that chance gives none as high in a text of that length: the extreme-value law, its
   decay from the background's scores, its constant the likeliest one given the highest segments of
   clean labelled texts. The chances of a text's significant segments multiply, and a two-parameter
   logistic fitted on labelled texts maps their logarithm to [0, 1].

Fitting uses at most ``FIT_ROWS`` labelled documents outside the held-out fold, chosen by a hash of
their ids, so the lexicon is bounded by what at least ``SUPPORT`` toxic ones of them hold; corpus counts
cover all documents; texts are scored whole.

Defined results: null and empty texts have no segment and get the lowest score; repeated rows get
equal scores, and count once in the fit; of segments with equal scores all are kept; a null doc_id counts
as not held out; a very long text is a batch of its own, at about 100 bytes for each of its tokens; without
both label values all scores are 0; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from extractlab.llm.common import batch_of, bounded, fitted, fold, labelled_sample, table, written

FIT_ROWS = 20_000
#: Words that a task counts before it passes their sums on, and words that a worker remembers the gains of.
TALLY, REMEMBERED = 50_000, 200_000
PRIOR = 1000.0
#: Least documents of the toxic class that hold an entry, and least z-score of its log-odds.
SUPPORT, SIGNIFICANCE = 3, 3.0
#: Share of a toxic passage's tokens that come from the lexicon.
DENSITY = 0.1
#: Share of a toxic document's tokens that are in its passages.
PASSAGE = 0.135
#: A segment counts if chance gives one as high in fewer texts than this share.
CHANCE = 0.05
STEMS = (7, 6, 5, 4)
LEAST_SCORE, MOST_SCORE = 1.0, 8.0
HELD_OUT, MODULUS = 0, 5
THRESHOLD = 0.5
_WORD = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


@functools.lru_cache(1 << 16)
def entries(word: str) -> tuple[str, ...]:
    """The lexicon entries that a word may match: itself, then its stems, longest first."""
    return (word, *(word[:n] + "*" for n in STEMS if len(word) > n))


def segments(scores: list[tuple[int, float]], loss: float, n: int) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of ``n`` tokens, given the gains at some
    positions and a loss everywhere else; linear in the gains."""
    # Each open candidate: start, end, total before it, total through it, index of the nearest earlier
    # candidate whose total before is smaller.
    stack: list[tuple[int, int, float, float, int]] = []
    total, last = 0.0, -1
    for at, gain in scores:
        total -= loss * (at - last - 1)
        new = (at, at + 1, total, total + gain)
        total, last = total + gain, at
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= new[3]:
                stack.append((*new, j))
                break
            new = (stack[j][0], new[1], stack[j][2], new[3])
            del stack[j:]
    return [(s, e, hi - lo) for s, e, lo, hi, _ in stack]


@dataclass
class Model:
    gains: dict[str, float] = field(default_factory=dict)
    loss: float = 0.1
    decay: float = 1.0
    constant: float = 1.0
    scale: float = 1.0
    offset: float = -50.0

    #: Words that were met, and the gains of those that have one.
    met: set[str] = field(default_factory=set)
    worth: dict[str, float] = field(default_factory=dict)

    def passages(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """The number of tokens, and all maximal segments."""
        words = tokens(text)
        own = set(words)
        for w in own - self.met:
            gain = next((self.gains[e] for e in entries(w) if e in self.gains), None)
            if gain is not None:
                self.worth[w] = gain
        self.met |= own
        known = own & self.worth.keys()
        hits = [(i, self.worth[w]) for i, w in enumerate(words) if w in known] if known else []
        if len(self.met) > REMEMBERED:
            self.met, self.worth = set(), {}
        return len(words), segments(hits, self.loss, len(words)) if hits else []

    def surprise(self, n: int, score: float) -> float:
        """Minus the logarithm of the chance of a segment in a text of n tokens; 0 if that is not small."""
        p = -math.expm1(-self.constant * max(1, n) * math.exp(-self.decay * score))
        return -math.log(max(p, 1e-300)) if p < CHANCE else 0.0

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.scale * evidence + self.offset))))


def background(gains: list[float], chances: list[float], loss: float) -> float:
    """Decay of the extreme-value law for independent background tokens."""
    s, p = np.array(gains), np.array(chances)
    rest = max(1e-9, 1 - p.sum())

    def excess(x: float) -> float:
        return float((p * np.exp(np.minimum(x * s, 500))).sum() + rest * math.exp(-x * loss) - 1)

    lo, hi = 1e-6, 1.0
    while excess(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if excess(mid) < 0 else (lo, mid)
    return hi


def likeliest_constant(decay: float, sizes: np.ndarray, highest: np.ndarray) -> float:
    """Of the extreme-value law, given the highest segments of clean texts (0 if a text has none): the texts
    with a segment by the sum of sizes times exp(-decay * highest)."""
    return float(((highest > 0).sum() + 0.5) / max(1.0, (sizes * np.exp(-decay * highest)).sum()))


def train(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    spark = documents.sparkSession
    sample = labelled_sample(labels, "toxic", MODULUS, HELD_OUT, rows)
    labelled = written(  # at most ``rows`` texts, read twice; copies count once
        documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
        .groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("label").alias("label")).select("doc_id", "label", "text"),
        "toxicity-sample",
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries with the documents of each class that hold them, summed over runs of documents that hold
        at most about ``TALLY`` entries. A text that repeats a word counts once, so that repetitive texts
        don't make their words look toxic."""
        types = {"entry": pa.string(), "clean": pa.int64(), "toxic": pa.int64()}
        tally: dict[str, list[int]] = defaultdict(lambda: [0, 0])

        def summed() -> pa.RecordBatch:
            return batch_of(types, {"entry": list(tally), "clean": [v[0] for v in tally.values()], "toxic": [v[1] for v in tally.values()]})

        for b in bounded(batches, "text", 200, 1 << 20):
            for label, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                for e in {e for w in set(tokens(text)) for e in entries(w)}:
                    tally[e][label] += 1
                if len(tally) >= TALLY:
                    yield summed()
                    tally.clear()
        yield summed()

    counted = written(
        labelled.mapInArrow(count, "entry string, clean bigint, toxic bigint")
        .groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "toxicity-counts",
    )
    totals = counted.where(~F.col("entry").endswith("*")).agg(F.sum("clean"), F.sum("toxic")).first()
    clean, toxic = int(totals[0] or 0), int(totals[1] or 0)
    if not clean or not toxic:
        return Model()
    ratio = (F.col("toxic") + 0.5) / toxic / ((F.col("clean") + 0.5) / clean)
    corpus, size = corpus_counts(documents)
    weight = min(PRIOR, toxic / 10)  # the prior must not outweigh what few labels say
    prior = weight * (F.coalesce("n", F.lit(0)) + 0.5) / max(1, size)
    # Half a count more on both sides: the corpus gives rare words next to no prior of their own.
    a, b = F.col("toxic") + prior + 0.5, F.col("clean") + prior + 0.5
    odds = F.log(a / (toxic + weight + 1 - a)) - F.log(b / (clean + weight + 1 - b))
    gain = F.least(odds + math.log(DENSITY) - math.log(PASSAGE), F.lit(MOST_SCORE))
    picked = (
        counted.where((F.col("toxic") >= SUPPORT) & (ratio > 1)).join(corpus, "entry", "left")
        .where((odds / F.sqrt(1 / a + 1 / b) >= SIGNIFICANCE) & (gain >= LEAST_SCORE))
        .select("entry", gain.alias("gain"), (b / (clean + weight)).alias("chance")).collect()  # from at most ``rows`` texts
    )
    picked.sort()
    model = Model({r["entry"]: r["gain"] for r in picked}, -math.log(1 - DENSITY))
    model.decay = background([r["gain"] for r in picked], [r["chance"] for r in picked], model.loss)
    shared = spark.sparkContext.broadcast(model)  # as large as the lexicon

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"label": pa.int32(), "n": pa.int64(), "scores": pa.list_(pa.float64())}
        for b in bounded(batches, "text", 500, 4 << 20):
            found = [shared.value.passages(t) for t in b.column(2).to_pylist()]
            yield batch_of(types, {"label": b.column(1).to_pylist(), "n": [n for n, _ in found], "scores": [[x for _, _, x in own] for _, own in found]})

    def calibrated(batches: list[pa.RecordBatch]) -> tuple[float, float, float]:
        seen = sorted(row for b in batches for row in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
        clean = [(n, max(own, default=0.0)) for label, n, own in seen if not label]
        model.constant = likeliest_constant(model.decay, np.array([n for n, _ in clean]), np.array([x for _, x in clean]))
        evidence = np.array([sum(model.surprise(n, x) for x in own) for _, n, own in seen])
        return model.constant, *logistic(evidence, np.array([label for label, _, _ in seen]))

    weighed = labelled.mapInArrow(weigh, "label int, n bigint, scores array<double>")
    model.constant, model.scale, model.offset = fitted(weighed, calibrated)
    return model


def corpus_counts(documents: DataFrame) -> tuple[DataFrame, int]:
    """(entry, n): how often words and stems occur in all documents, and the number of all tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"word": pa.string(), "n": pa.int64()}
        tally: Counter = Counter()
        for b in bounded(batches, "text", 500, 1 << 20):
            tally.update(tokens("\n".join(t for t in b.column(0).to_pylist() if t)))
            if len(tally) >= TALLY:
                yield batch_of(types, {"word": list(tally), "n": list(tally.values())})
                tally.clear()
        yield batch_of(types, {"word": list(tally), "n": list(tally.values())})

    words = documents.select("text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    words = written(words, "toxicity-words")
    stems = [F.when(F.length("word") > k, F.concat(F.substring("word", 1, k), F.lit("*"))) for k in STEMS]
    each = words.select("n", F.explode(F.array_compact(F.array("word", *stems))).alias("entry"))
    return each.groupBy("entry").agg(F.sum("n").alias("n")), words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and offset by damped Newton steps; the evidence is compressed above 50 by the cap below."""
    z = np.minimum(x, 50.0)
    a, b = 0.2, -3.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = p * (1 - p)
        g = np.array([((p - y) * z).sum() + 0.01 * a, (p - y).sum()])
        h = np.array([[(w * z * z).sum() + 0.01, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, and the significant passages' token ranges as ``passages`` (start:end, joined)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # as large as the lexicon
    types = {"doc_id": pa.int64(), "score": pa.float64(), "passages": pa.string()}

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in bounded(batches, "text", 500, 4 << 20):
            out: dict[str, list] = {k: [] for k in types}
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n, found = m.passages(text)
                counted = [(s, e, x) for s, e, x in ((s, e, m.surprise(n, score)) for s, e, score in found) if x]
                out["doc_id"].append(doc)
                out["score"].append(m.probability(min(sum(x for _, _, x in counted), 50.0)))
                out["passages"].append(",".join(f"{s}:{e}" for s, e, _ in counted))
            yield batch_of(types, out)

    return documents.select("doc_id", "text").mapInArrow(scored, "doc_id bigint, score double, passages string")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = score(documents, train(documents, table(spark, sf_dir, "labels")))
    return fold(found, "doc_id", MODULUS).select(
        "doc_id", F.coalesce(F.col("fold") == HELD_OUT, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "passages",
    )
