"""The registered queries of this subpackage, and the SQL that some of them are held against.

The other operators train models, run tokenizers or extend what patterns find, which SQL can't express;
``tests/llm`` holds their queries against brute force, the libraries or held-out labels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from extractlab.llm.op01_bpe import op1_bpe
from extractlab.llm.op02_near_vectors import op2_near_vectors
from extractlab.llm.op03_pii import op3_pii
from extractlab.llm.op04_packing import op4_pack
from extractlab.llm.op05_quality import op5_quality
from extractlab.llm.op06_token_files import op6_token_files
from extractlab.llm.op07_language import op7_language
from extractlab.llm.op08_neighbours import op8_neighbours
from extractlab.llm.op09_toxicity import op9_toxicity
from extractlab.llm.op10_minhash import op10_minhash
from extractlab.llm.op11_lloyd import op11_lloyd
from extractlab.llm.op12_alignment import op12_alignment
from extractlab.llm.op13_fingerprints import op13_fingerprints

_VECTORS = """(SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"""

#: Every pair of vectors of one label, and the ids that links reach.
_NEAR = f"""WITH RECURSIVE p AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS n FROM {_VECTORS} x WHERE label IS NOT NULL),
    l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM p a JOIN p b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id AND list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.98),
    r AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT l.v, r.root FROM r JOIN l ON r.node = l.u),
    c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node), k AS (SELECT u, count(DISTINCT v) AS n_links FROM l GROUP BY u)
    SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON vec_id = node LEFT JOIN k ON vec_id = u"""

#: Every candidate of every query.
_NEAREST = f"""SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM (
    SELECT a.vec_id AS query_id, b.vec_id, sqrt(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i])))) AS score
    FROM {_VECTORS} a JOIN {_VECTORS} b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0) d) e WHERE rank <= 10"""

#: Shingles as text, every pair that shares one, and the ids that links reach.
_COPIES = """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS sh FROM w),
    u AS (SELECT doc_id, unnest(sh) AS h FROM s), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM u a JOIN u b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
    k AS (SELECT x, y FROM p JOIN s a ON x = a.doc_id JOIN s b ON y = b.doc_id WHERE 100 * n >= 85 * (len(a.sh) + len(b.sh) - n)),
    l AS (SELECT x AS u, y AS v FROM k UNION ALL SELECT y, x FROM k),
    r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT l.v, r.root FROM r JOIN l ON r.node = l.u), c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
    SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON doc_id = node"""


def _lloyd(rounds: int = 10) -> str:
    """The rounds one after another; sums and whole quotients in 128 bits."""
    distance = "list_sum(list_transform(range(1, 65), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i])))"

    def assigned(k: int) -> str:
        return f"""a{k} AS MATERIALIZED (SELECT n, arg_min(c.cluster, (d, c.cluster)) AS cluster, min(d) AS d, any_value(v) AS v FROM (
            SELECT x.n, x.v, c.cluster, {distance} AS d FROM x, c{k} c) c GROUP BY n)"""

    def moved(k: int) -> str:
        return f"""c{k + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN (
            SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
                SELECT cluster, i, sum(CAST(v[i] AS HUGEINT)) AS s, count(*) AS n FROM a{k}, range(1, 65) r(i) GROUP BY cluster, i) t GROUP BY cluster) m ON c.cluster = m.cluster)"""

    steps = ",\n    ".join(s for k in range(rounds) for s in (assigned(k), moved(k)))
    return f"""WITH x AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda y: CAST(floor(1024 * CAST(y AS DOUBLE)) AS HUGEINT)) AS v FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
    c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS cluster, v FROM x ORDER BY sha256('3:' || vec_id) LIMIT 8),
    {steps},
    {assigned(rounds)}
    SELECT x.vec_id, CAST(a.cluster AS INT) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
        CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
    FROM a{rounds} a JOIN x ON x.n = a.n JOIN c{rounds} c ON c.cluster = a.cluster"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_near_vectors": op2_near_vectors,
        "op3_pii": op3_pii,
        "op4_pack": op4_pack,
        "op5_quality": op5_quality,
        "op6_token_files": op6_token_files,
        "op7_language": op7_language,
        "op8_neighbours": op8_neighbours,
        "op9_toxicity": op9_toxicity,
        "op10_minhash": op10_minhash,
        "op11_lloyd": op11_lloyd,
        "op12_alignment": op12_alignment,
        "op13_fingerprints": op13_fingerprints,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_near_vectors": _NEAR, "op8_neighbours": _NEAREST, "op10_minhash": _COPIES, "op11_lloyd": _lloyd()}
