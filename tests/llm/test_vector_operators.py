"""The vector operators against brute force, with awkward rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from extractlab.llm import op02_near_vectors, op08_neighbours
from extractlab.llm.components import connected_components, roots

SCHEMA = "vec_id long, embedding array<float>, label int, n long, score double, size int, leaf int"


def rows():
    r = np.random.default_rng(2)
    base = r.normal(size=(40, 16))
    near = base[r.integers(0, 6, 160)] + 0.04 * r.normal(size=(160, 16))
    v = [*base, *near, base[0], base[0], base[1] * 2]
    out = [(i, [float(x) for x in np.float32(e)], i % 3) for i, e in enumerate(v)]
    n = len(out)
    bad = [None, [0.0] * 16, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [None] + [1.0] * 15, [1.0, 0.0]]
    out += [(n + i, e, 0) for i, e in enumerate(bad)] + [(n + 10, out[0][1], None), (None, out[0][1], 0)]
    out += [out[0], out[0], out[45], (7, out[50][1], out[50][2]), (7, out[61][1], out[61][2]), (3 << 40, out[0][1], 0)]  # repeated rows and ids
    return [(*x, 0, 0.0, 0, 0) for x in out]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def good(e):
    return e is not None and all(x is not None and np.isfinite(x) for x in e) and any(e)


@pytest.mark.parametrize("block", [1024, 16])
def test_near_vectors(vectors, monkeypatch, block):
    monkeypatch.setattr(op02_near_vectors, "BLOCK", block)
    assert sorted(map(repr, found_near(vectors))) == sorted(map(repr, wanted_near(rows())))


def found_near(vectors, **more):
    """(vec_id, n_links, component) by vec_id, in the order of the numbers of links."""
    got = op02_near_vectors.near_vectors(vectors, leaf=16, **more).collect()
    return [(r["vec_id"], r["n_links"], r["component_id"]) for r in got]


def wanted_near(rows):
    """By comparing all different (id, label, vector)."""
    entry = {(i, tuple(e), k): np.array(e) / np.linalg.norm(e) for i, e, k, *_ in rows if good(e) and k is not None and i is not None}
    links = [(a, b) for a, x in entry.items() for b, y in entry.items() if a < b and a[2] == b[2] and len(x) == len(y) and x @ y >= 0.98]
    assert len(links) > 200
    root, n = roots((a[0], b[0]) for a, b in links), {}
    for pair in links:
        for a in pair:
            n[a] = n.get(a, 0) + 1
    return [(i, n.get((i, tuple(e or ()), k), 0), root.get(i, i)) for i, e, k, *_ in rows]


def test_near_vectors_of_large_labels(spark, vectors):
    other = vectors.withColumn("label", F.col("label").cast("long") + (1 << 40))
    assert sorted(map(repr, found_near(other))) == sorted(map(repr, wanted_near(rows())))


@pytest.mark.parametrize("depth", [8, 10, 12, 14, 16])
def test_forest_recall_in_clusters(depth):
    """Clusters of near copies among spread-out vectors, deeper than the sample reaches: no link is missed."""
    r = np.random.default_rng(depth)
    v = r.normal(size=(9000, 32)) + 2 * r.normal(size=(30, 32))[r.integers(0, 30, 9000)]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[:2000] = v[r.integers(0, 400, 2000)] + np.sqrt(0.014 / 32) * r.normal(size=(2000, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    forest = op02_near_vectors.Forest.fit(v[r.permutation(9000)[:4000]], 32, depth, op02_near_vectors.TREES, 0.98)
    group = v[:2000]
    met = np.zeros((2000, 2000), bool)
    for row, node in forest.leaves(group):
        names, column = np.unique(node, return_inverse=True)
        inside = np.zeros((2000, len(names)), np.float32)
        inside[row, column] = 1
        met |= inside @ inside.T > 0
    linked = group @ group.T >= 0.98
    assert linked.sum() > 4000 and (linked & ~met).sum() <= linked.sum() * 1e-4


def test_no_vectors(spark, vectors):
    assert op02_near_vectors.near_vectors(vectors.limit(0)).count() == 0
    only_bad = op02_near_vectors.near_vectors(vectors.where("embedding IS NULL")).collect()
    assert [(r["n_links"], r["component_id"] == r["vec_id"]) for r in only_bad] == [(0, True)]
    assert op08_neighbours.neighbours(vectors.limit(0), F.lit(True)).count() == 0


def test_forest_recall_at_the_threshold():
    """Vectors at just the least similarity meet in some leaf."""
    r = np.random.default_rng(5)
    a = r.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    t = r.normal(size=a.shape)
    t -= (t * a).sum(1, keepdims=True) * a
    t /= np.linalg.norm(t, axis=1, keepdims=True)
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * t
    forest = op02_near_vectors.Forest.fit(a, 64, 8, op02_near_vectors.TREES, 0.98)
    met = np.zeros(len(a), bool)
    for (ra, na), (rb, nb) in zip(forest.leaves(a), forest.leaves(b), strict=True):
        pairs = set(zip(ra.tolist(), na.tolist(), strict=True)) & set(zip(rb.tolist(), nb.tolist(), strict=True))
        met[[i for i, _ in pairs]] = True
    assert met.all()


@pytest.mark.parametrize("depth", [10, 12])
def test_forest_keeps_a_hot_group_together(depth):
    """A third of all vectors are near copies: all their links at the threshold meet in some leaf."""
    r = np.random.default_rng(6)
    v = r.normal(size=(12000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[:4000] = v[0] + np.sqrt(0.0142 / 64) * r.normal(size=(4000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    forest = op02_near_vectors.Forest.fit(v[r.permutation(12000)[:8192]], 64, depth, op02_near_vectors.TREES, 0.98)
    group = v[:1500]
    met = np.zeros((1500, 1500), bool)
    for row, node in forest.leaves(group):
        names, column = np.unique(node, return_inverse=True)
        inside = np.zeros((1500, len(names)), np.float32)
        inside[row, column] = 1
        met |= inside @ inside.T > 0
    linked = group @ group.T >= 0.98
    assert linked.sum() > 1_000_000 and not (linked & ~met).any()


def test_hilbert_walks_to_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), axis=-1).reshape(-1, dims)
        keys = op08_neighbours.hilbert(cells, bits)
        walk = cells[np.argsort(keys)]
        assert sorted(keys) == list(range(len(cells))) and (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("k", [3, 500])
def test_neighbours(vectors, k):
    part = {(i, tuple(e)): (i, np.array(e, float)) for i, e, *_ in rows() if good(e) and i is not None}
    part = [x for k, x in part.items() if k[0] not in (7,)]  # an id with several vectors is one candidate, at the nearest of them
    vectors = vectors.where("vec_id <> 7")
    got = {}
    for r in op08_neighbours.neighbours(vectors, F.col("vec_id") % 10 == 0, k).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for i, x in part:
        if i % 10 == 0:
            near = sorted((np.sqrt(((x - y) ** 2).sum()), j) for j, y in part if j != i and len(y) == len(x))[:k]
            assert [v for _, v, _ in sorted(got.get(i, []))] == [j for _, j in near]
            assert np.allclose([s for _, _, s in sorted(got.get(i, []))], [d for d, _ in near], rtol=1e-12)
    assert set(got) <= {i for i, _ in part if i % 10 == 0}


@pytest.mark.parametrize("most", [0, 10**6])
def test_components(spark, most):
    r = np.random.default_rng(7)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 80)]
    got = connected_components(spark.createDataFrame(edges, "u long, v long"), most).collect()
    wanted = {x: c for x, c in roots(iter(edges)).items() if any(a != b and x in (a, b) for a, b in edges)}
    assert {x["node"]: x["component"] for x in got} == wanted and len(got) == len(wanted)
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
