"""The scores that the registered queries give, against plain references from the fitted models; recall of the curves alone."""

import math
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from extractlab.llm import op05_quality, op07_language, op08_neighbours, op09_toxicity, queries
from extractlab.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: (r["text"], r["n_chars"]) for r in table(spark, SF, "documents").collect()}


def test_quality_scores_pair_by_pair(spark, texts):
    """Every pair of features meets in a double loop, without the identity that makes scoring linear."""
    m = op05_quality.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    got = {r["doc_id"]: r["score"] for r in queries.queries()["op5_quality"](spark, SF).collect()}
    assert set(got) == set(texts)
    weights, factors = m.weights.astype(float), m.factors.astype(float)
    small = [i for i, (t, _) in texts.items() if len(set((t or "").split())) <= 120]
    assert len(small) > 20
    for i in small:
        text, n_chars = texts[i]
        words = (text or "").split()
        counts = Counter(words)
        norm = math.sqrt(sum(counts.values())) or 1.0
        features = [(zlib.crc32(w.encode()) % op05_quality.BUCKETS, math.sqrt(n) / norm) for w, n in counts.items()]
        stats = op05_quality.statistics(text or "", words, counts, n_chars)
        for k, x in enumerate(stats):
            features.append((op05_quality.BUCKETS + k * op05_quality.BINS + sum(x > e for e in m.edges[k]), 0.3))
        z = m.bias + sum(weights[f] * x for f, x in features)
        z += sum(float(factors[f] @ factors[g]) * x * y for (f, x), (g, y) in combinations(features, 2))
        assert math.isclose(got[i], 1 / (1 + math.exp(-z)), abs_tol=2e-4), i


def test_language_scores_vote_by_vote(spark, texts):
    m = op07_language.train(table(spark, SF, "documents"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in queries.queries()["op7_language"](spark, SF).collect()}
    assert set(got) == set(texts)

    def vote(level, names, lead):
        if len(names) < 2:
            return names[0], 1.0
        pairs = {(a, b): lead[j] for j, (kind, a, b) in enumerate(m.machines) if kind == level}
        of = {x: [y if a == x else -y for (a, b), y in pairs.items() if x in (a, b)] for x in names}
        wins = {x: sum(y >= 0 if x == a else y < 0 for (a, b), y in pairs.items() if x in (a, b)) for x in names}
        best = max(names, key=lambda x: (wins[x], sum(of[x])))
        return best, 1 / (1 + math.exp(-op07_language.SHARPNESS * max(-20.0, min(20.0, min(of[best])))))

    for i, (text, _) in texts.items():
        if not any(c.isalpha() for c in text or ""):
            assert got[i] == ("und", 0.0)
            continue
        index, value = op07_language.profile(text)
        lead = [sum(float(m.weights[k, j]) * x for k, x in zip(index, value, strict=True)) + m.bias[j] for j in range(len(m.machines))]
        family, p = vote("family", m.families, lead)
        language, q = vote(family, m.languages[family], lead)
        assert got[i][0] == language and math.isclose(got[i][1], p * q, abs_tol=1e-4), i


def best_first(values, start=0):
    """Maximal scoring segments by their definition: the best one, then those of what lies left and right of it."""
    if not len(values):
        return []
    total = np.concatenate(([0.0], np.cumsum(values)))
    low = np.minimum.accumulate(total[:-1])
    gain = total[1:] - low
    stop = int(gain.argmax())
    if gain[stop] <= 1e-12:
        return []
    begin = int(np.flatnonzero(total[: stop + 1] <= low[stop] + 1e-12)[-1])
    return best_first(values[:begin], start) + [(start + begin, start + stop + 1, float(gain[stop]))] + best_first(values[stop + 1 :], start + stop + 1)


def test_toxicity_scores_segment_by_segment(spark):
    sf = "/root/testdata/sf0.1"  # smaller tables have too few toxic labels for a lexicon
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in table(spark, sf, "documents").collect()}
    m = op09_toxicity.train(table(spark, sf, "documents"), table(spark, sf, "labels"))
    got = {r["doc_id"]: (r["score"], r["passages"]) for r in queries.queries()["op9_toxicity"](spark, sf).collect()}
    assert set(got) == set(texts) and m.gains
    found = 0
    for i, (text, _) in texts.items():
        words = op09_toxicity.tokens(text)
        gains = [next((m.gains[e] for e in op09_toxicity.entries(w) if e in m.gains), -m.loss) for w in words]
        evidence, said = 0.0, []
        for start, end, score in best_first(np.array(gains)):
            chance = -math.expm1(-m.constant * len(words) * math.exp(-m.decay * score))
            if chance < op09_toxicity.CHANCE:
                evidence += -math.log(max(chance, 1e-300))
                said.append(f"{start}:{end}")
        z = m.scale * min(evidence, 50.0) + m.offset
        assert got[i][1] == ",".join(said), i
        assert math.isclose(got[i][0], 1 / (1 + math.exp(-max(-50.0, min(50.0, z)))), abs_tol=1e-6), i
        found += bool(said)
    assert found > 3


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_curves_alone_reach_the_recall(spark, sf):
    """Without the exact check, against brute force."""
    e = table(spark, f"/root/testdata/{sf}", "embeddings")
    rows = [(r["vec_id"], r["embedding"]) for r in e.select("vec_id", "embedding").collect()]
    rows = [(i, v) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, vectors = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    got = {}
    for r in op08_neighbours.neighbours(e, F.col("vec_id") % 20 == 0, complete=False).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    met = wanted = 0
    for n in np.flatnonzero(ids % 20 == 0):
        distance = ((vectors - vectors[n]) ** 2).sum(axis=1)
        distance[n] = np.inf
        near = set(ids[np.argsort(distance, kind="stable")[:10]].tolist())
        met, wanted = met + len(near & got.get(int(ids[n]), set())), wanted + len(near)
    assert met >= 0.9 * wanted
