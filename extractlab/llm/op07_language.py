"""Language identification in two levels.

A linear classifier first predicts the language family; within the family, one linear support vector
machine for each pair of languages votes. All machines share features: hashed byte n-grams of the
lower-cased text with everything but letters read as a space, as shares of the text. They are fitted
by sub-gradient steps on at most ``FIT_ROWS`` different texts of each language: those with the smallest
hashes of id and text. The fit runs in one task. The model's size grows with the square of the number of
languages learned in a family (and of families), not with the rows.

A score is the logistic of the family's lead times that of the language's narrowest pairwise lead.

Defined results: null texts and texts without a letter are ``und`` with score 0; null languages are
not learned from; languages outside ``FAMILIES`` form a family of their own; with one language only,
every text with letters gets it; with none, all are ``und``; a null doc_id counts as not held out;
repeated rows get equal results; equal votes go to the larger sum of leads, then to the name that comes
first; texts are read whole in batches bounded by bytes, a very long one alone, at about 60 bytes for each
of its bytes; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from extractlab.llm.common import batch_of, bounded, fitted, fold, reading, table

#: ISO 639-1 codes by family.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "an ast ca es fr gl it oc pt rm ro sc",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "uralic": "et fi hu se",
    "turkic": "az kk ky tk tr tt ug uz",
    "indic": "bn gu hi mr ne pa si ur",
    "semitic": "am ar he mt ti",
    "celtic": "br cy ga gd gv kw",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
UNDETERMINED = "und"
BITS = 15
ORDERS = (2, 3, 4)
FIT_ROWS = 600
HELD_OUT, MODULUS = 1, 3
SHARPNESS = 1.5
_CANDIDATE = re.compile(r"[^\W\d_]+")
_READ = np.full(256, 32, np.uint32)
_READ[97:123] = np.arange(97, 123)
_READ[128:] = np.arange(128, 256)


def has_letter(text: str) -> bool:
    """Whether any character is a letter; number signs such as fractions and Roman numerals are not."""
    return any(m[0].isalpha() or any(map(str.isalpha, m[0])) for m in _CANDIDATE.finditer(text))


def ngrams(texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each order, the hashes of the n-grams of all texts and where each text's begin."""
    parts = [np.frombuffer(b" " + t.lower().encode() + b"    ", np.uint8) for t in texts]
    starts = np.concatenate(([0], np.cumsum([len(p) for p in parts])[:-1]))
    read = _READ[np.concatenate(parts)]
    blank = read == 32
    double = np.zeros(len(read), bool)
    double[:-1] = blank[:-1] & blank[1:]
    found, edges = [], []
    for order in ORDERS:
        n = len(read) - order + 1
        code = np.full(n, order * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        good = ~double[:n]
        for j in range(order):
            code = (code ^ read[j : j + n]) * np.uint32(0x01000193 + 2 * order)
            if 0 < j < order - 1:
                good &= ~double[j : j + n]
        code ^= code >> np.uint32(15)
        keep = np.flatnonzero(good)
        found.append((code[keep] * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS))
        edges.append(np.searchsorted(keep, starts))
    return found, edges


def profile(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text with their shares."""
    found, _ = ngrams([text])
    count = np.bincount(np.concatenate(found), minlength=1 << BITS)
    index = np.flatnonzero(count)
    return index, shares(count[index].astype(np.float64), count.sum())


def shares(count: np.ndarray, total: float) -> np.ndarray:
    """Shares on a scale on which typical texts have features of about one."""
    return 100.0 * count / max(1.0, total)


@dataclass
class Hierarchy:
    families: list[str]
    languages: dict[str, list[str]]
    #: For each column of the weights: ("family", a, b) or (family, language a, language b); positive means a.
    machines: list[tuple[str, str, str]]
    weights: np.ndarray
    bias: np.ndarray

    def decide(self, lead: np.ndarray) -> tuple[str, float]:
        """Language and score from the machines' outputs."""
        family, certain = self._vote("family", self.families, lead)
        if family is None:
            return UNDETERMINED, 0.0
        language, more = self._vote(family, self.languages[family], lead)
        return language, certain * more

    def _vote(self, level: str, names: list[str], lead: np.ndarray) -> tuple[str | None, float]:
        if len(names) < 2:
            return (names[0], 1.0) if names else (None, 0.0)
        won = dict.fromkeys(names, 0)
        margin = dict.fromkeys(names, 0.0)
        narrow = dict.fromkeys(names, np.inf)
        for j, (kind, a, b) in enumerate(self.machines):
            if kind == level:
                won[a if lead[j] >= 0 else b] += 1
                for name, x in ((a, lead[j]), (b, -lead[j])):
                    margin[name] += x
                    narrow[name] = min(narrow[name], x)
        best = max(names, key=lambda x: (won[x], margin[x]))
        return best, float(1 / (1 + np.exp(-SHARPNESS * np.clip(narrow[best], -20, 20))))


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 12, batch: int = 64, rate: float = 0.05, decay: float = 1e-4) -> Hierarchy:
    """Linear machines by hinge-loss steps; the families' by pairs as well."""
    seen = sorted({lang for lang, _, _ in rows})
    by: dict[str, list[str]] = {}
    for lang in seen:
        by.setdefault(FAMILY.get(lang, f"own:{lang}"), []).append(lang)
    families = sorted(by)
    machines = [("family", a, b) for a, b in combinations(families, 2)]
    machines += [(f, a, b) for f in families for a, b in combinations(by[f], 2)]
    weights, bias = np.zeros((1 << BITS, len(machines)), np.float32), np.zeros(len(machines))
    random = np.random.default_rng(7)
    for j, (kind, a, b) in enumerate(machines):
        name = (lambda lang: FAMILY.get(lang, f"own:{lang}")) if kind == "family" else (lambda lang: lang)
        own = [(1.0 if name(lang) == a else -1.0, i, v) for lang, i, v in rows if name(lang) in (a, b)]
        balance = {s: len(own) / (2 * max(1, sum(y == s for y, _, _ in own))) for s in (1.0, -1.0)}
        w, c, mean_w, mean_c, steps = np.zeros(1 << BITS), 0.0, np.zeros(1 << BITS), 0.0, 0
        for epoch in range(epochs):
            order = random.permutation(len(own))
            for at in range(0, len(order), batch):
                some = [own[k] for k in order[at : at + batch]]
                slope, push = np.zeros(1 << BITS), 0.0
                for y, i, v in some:
                    if y * (w[i] @ v + c) < 1:
                        slope[i] += balance[y] * y * v
                        push += balance[y] * y
                step = rate / (1 + 0.2 * epoch)
                w = w * (1 - step * decay) + step * slope / len(some)
                c += step * push / len(some)
                if epoch >= epochs // 2:
                    steps += 1
                    mean_w += w
                    mean_c += c
        weights[:, j], bias[j] = mean_w / max(1, steps), mean_c / max(1, steps)
    return Hierarchy(families, by, machines, weights, bias)


def train(documents: DataFrame, rows: int = FIT_ROWS) -> Hierarchy:
    usable = fold(documents.select("doc_id", "lang", "text"), "doc_id", MODULUS).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.coalesce("fold", F.lit(0)) != HELD_OUT)
    )
    usable = usable.select("lang", "text", F.xxhash64(F.lit("language"), "doc_id", "text").alias("draw"))
    # Per language, the hash up to which its texts are learned from; equal rows count once. Only the lowest
    # share of the hashes, half as many again as wanted, is ranked. A row for each language reaches the driver.
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.approx_count_distinct("draw", 0.02).alias("n")).collect()}
    if not sizes:
        return fit([])
    share = F.create_map(*(F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, (1.5 * rows + 50) / max(1, n)))))
    low = usable.select("lang", "draw").where(F.col("draw") / 2.0**64 + 0.5 <= F.element_at(share, F.col("lang"))).distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    most = low.withColumn("place", place).where(F.col("place") <= rows)
    upto = {r["lang"]: r["most"] for r in most.groupBy("lang").agg(F.max("draw").alias("most")).collect()}
    limit = F.element_at(F.create_map(*(F.lit(x) for pair in sorted(upto.items()) for x in pair)), F.col("lang"))
    chosen = usable.where(F.col("draw") <= limit).groupBy("lang", "draw").agg(F.min("text").alias("text"))

    def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"lang": pa.string(), "index": pa.binary(), "value": pa.binary()}
        for b in bounded(batches, "text", 500, 4 << 20):
            out: dict[str, list] = {k: [] for k in types}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if has_letter(text):
                    index, value = profile(text)
                    out["lang"].append(lang)
                    out["index"].append(index.astype(np.uint16).tobytes())
                    out["value"].append(value.astype(np.float32).tobytes())
            yield batch_of(types, out)

    def learned(batches: list[pa.RecordBatch]) -> Hierarchy:
        rows = sorted(row for b in batches for row in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
        return fit([(lang, np.frombuffer(i, np.uint16).astype(np.int64), np.frombuffer(v, np.float32)) for lang, i, v in rows])

    return fitted(chosen.select("lang", "text").mapInArrow(profiles, "lang string, index binary, value binary"), learned)


def predict(documents: DataFrame, model: Hierarchy, keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` (doc_id if not given), the language and the score under ``names``."""
    keep = keep or ["doc_id"]
    shared = documents.sparkSession.sparkContext.broadcast(model)  # 128 KB for each machine, whatever the rows
    schema = documents.select(*keep).schema.add(names[0], "string").add(names[1], "double")
    read, column, at = reading(documents, keep)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in bounded(batches, column, 300, 2 << 20):
            texts = [t or "" for t in b.column(at).to_pylist()]
            found, edges = ngrams(texts)
            lead, total = np.zeros((len(texts), len(m.machines))), np.zeros(len(texts))
            for code, start in zip(found, edges, strict=True):
                size = np.diff(np.append(start, len(code)))
                total += size
                if len(code):
                    for j in range(len(m.machines)):
                        run = np.concatenate(([0.0], np.cumsum(m.weights[:, j][code], dtype=np.float64)))
                        lead[:, j] += run[start + size] - run[start]
            lead = shares(lead, 1.0) / np.maximum(1.0, total)[:, None] + m.bias
            out = [m.decide(lead[i]) if has_letter(t) else (UNDETERMINED, 0.0) for i, t in enumerate(texts)]
            lang, p = pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], lang, p], names=[*keep, *names])

    return read.mapInArrow(predicted, schema)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = predict(documents, train(documents))
    return fold(found, "doc_id", MODULUS).select(
        "doc_id", F.coalesce(F.col("fold") == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )
