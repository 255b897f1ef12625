"""The registered queries on small tables with awkward rows: every contract column, by brute force where that can say it."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from extractlab.llm import queries
from extractlab.llm.components import roots
from extractlab.llm.tokens import default_path

from .. import oracle
from .test_text_operators import awkward, base_spans, labelled, shingle_set
from .test_vector_operators import good, rows as vector_rows, wanted_near

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return [(r[0], r[1]) for r in awkward()] + [(40, "one two three four five six"), (40, "seven eight nine ten eleven twelve"), (41, "ONE two three four five six"), (42, "seven eight nine ten\televen twelve")]


@pytest.fixture(scope="module")
def folder(spark, texts, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    docs, labels = labelled(spark, "toxic")
    rows = [(i, t, "en" if k % 2 else "de", "s", None if k % 3 else len(t or ""), k) for k, (i, t) in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, number int").repartition(4).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i == 5)) for i, _ in texts if i is not None], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([x[:3] for x in vector_rows()], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d


def run(spark, folder, name, columns):
    found = queries.queries()[name](spark, folder)
    assert set(columns) <= set(found.columns)
    return [tuple(r) for r in found.select(*columns).collect()]


def ids_of(text, lib=Tokenizer.from_file(default_path())):
    return lib.encode(text or "", add_special_tokens=False).ids


def packed(ids):
    return np.array(ids, "<u4").tobytes()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_agrees_with_sql(spark, name):
    assert oracle.difference(queries.queries()[name](spark, SF), oracle.connect(SF), queries.oracle_sql()[name]) == ""


def test_op1(spark, folder, texts):
    got = run(spark, folder, "op1_bpe", ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    wanted = [(i, len(ids_of(t)), hashlib.sha256(packed(ids_of(t))).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in texts]
    assert Counter(got) == Counter(wanted)


def test_op1_repeated_rows(spark, texts):
    from extractlab.llm.op01_bpe import encode

    text = texts[7][1]
    frame = spark.createDataFrame([(None, text)] * 3000 + [(1, text), (2, None), (2, None)], "doc_id long, text string").repartition(5)
    got = Counter((r["doc_id"], len(r["ids"]) // 4, r["decoded"] == (text if r["doc_id"] != 2 else "")) for r in encode(frame).collect())
    n = len(ids_of(text))
    assert got == {(None, n, True): 3000, (1, n, True): 1, (2, 0, True): 2}


def test_op2(spark, folder):
    got = run(spark, folder, "op2_near_vectors", ["vec_id", "n_links", "component_id", "kept"])
    assert Counter(g[:3] for g in got) == Counter(wanted_near(vector_rows()))
    assert all(k == (i is None or i == c) for i, _, c, k in got)


def test_op3(spark, folder, texts):
    got = run(spark, folder, "op3_pii", ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])
    kinds = ("email", "ip", "card", "phone")
    wanted = Counter()
    for i, t in texts:
        found = base_spans(t or "")
        by = sorted(found, key=lambda s: (kinds.index(s[0]), s[1]))
        wanted[(i, *(sum(s[0] == k for s in found) for k in kinds), hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in by).encode()).hexdigest())] += 1
    assert Counter(g[:6] for g in got) == wanted
    assert all(sum(g[1:5]) <= len([x for x in g[6].split(",") if x]) for g in got)


def test_op4(spark, folder, texts):
    got = run(spark, folder, "op4_pack", ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    wanted = Counter()
    for i, t in texts:
        ids = [*ids_of(t), 0]
        first = len(ids) % 2048 or 2048
        edges = [0, *range(first, len(ids) + 1, 2048)]
        wanted.update((i, k, s, e - s, zlib.crc32(packed(ids[s:e]))) for k, (s, e) in enumerate(zip(edges, edges[1:], strict=False)))
    assert Counter(g[:5] for g in got) == wanted
    held = defaultdict(list)
    for g in got:
        held[g[5]].append((g[6], g[3]))
    for places in held.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 2048
    assert len(held) <= -(-sum(g[3] for g in got) // 2048) + 1


def test_op6(spark, folder, texts):
    got = run(spark, folder, "op6_token_files", ["doc_id", "start", "n_tokens", "ids_crc32"])
    assert Counter((g[0], g[2], g[3]) for g in got) == Counter((i, len(ids_of(t)) + 1, zlib.crc32(packed([*ids_of(t), 0]))) for i, t in texts)
    at = 0
    for doc, start, n, _ in sorted(got, key=lambda g: g[1]):
        assert start == at
        at += n
    order = [g[0] for g in sorted(got, key=lambda g: g[1])]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))


def test_op6_sparse_ids(spark):
    from extractlab.llm import op06_token_files
    from extractlab.llm.common import scratch_dir

    ids = [-(1 << 62), -5, 0, 7, 1 << 61, (1 << 62) - 1]
    frame = spark.createDataFrame([(i, "a b") for i in ids], "doc_id long, text string")
    files = op06_token_files.write_token_files(frame, f"{scratch_dir(spark)}/sparse", file_docs=2)
    assert files.agg({"n_docs": "max"}).first()[0] <= 2
    assert sorted(r["doc_id"] for r in op06_token_files.read_token_files(files).collect()) == ids


@pytest.mark.parametrize(("name", "limit", "fold"), [("op5_quality", 0.3, (5, 0)), ("op9_toxicity", 0.5, (5, 0))])
def test_scores(spark, folder, texts, name, limit, fold):
    got = run(spark, folder, name, ["doc_id", "held_out", "score", "predicted"])
    assert Counter(g[0] for g in got) == Counter(i for i, _ in texts)
    for i, held, score, predicted in got:
        assert held == (i is not None and zlib.crc32(str(i).encode()) % fold[0] == fold[1])
        assert 0 <= score <= 1 and predicted == int(score >= limit)
    by = defaultdict(set)
    for i, _, score, _ in got:
        by[i].add(score)
    assert len(by[7]) == 1  # a repeated row


def test_op7(spark, folder, texts):
    got = run(spark, folder, "op7_language", ["doc_id", "held_out", "lang_pred", "score"])
    assert Counter(g[0] for g in got) == Counter(i for i, _ in texts)
    und = Counter(i for i, t in texts if not any(c.isalpha() for c in t or ""))
    assert Counter(g[0] for g in got if g[2] == "und") == und and und
    for i, held, lang, score in got:
        assert held == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1) and lang in ("en", "de", "und") and 0 <= score <= 1


def test_op7_learns_each_language_up_to_the_bound(spark):
    from extractlab.llm import op07_language

    assert not op07_language.has_letter("½ ② Ⅷ 12 _ !") and op07_language.has_letter("½ a") and op07_language.has_letter("日")
    rows = [(None, "der und nicht eine mit sich auch", "de")] * 400 + [(i, f"the and with that this from have number {i}", "en") for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    model = op07_language.train(table, rows=5)
    assert model.languages == {"germanic": ["de", "en"]}
    assert {r["lang_pred"] for r in op07_language.predict(table.where("lang = 'de'"), model).collect()} == {"de"}


def test_op8(spark, folder):
    got = run(spark, folder, "op8_neighbours", ["query_id", "rank", "vec_id", "score"])
    part = defaultdict(list)
    for i, e, *_ in vector_rows():
        if good(e) and i is not None:
            part[i].append(np.array(e, float))
    wanted = {}
    for i in part:
        if i % 100 == 0:
            near = {j: min(np.sqrt(((x - y) ** 2).sum()) for x in part[i] for y in ys if len(x) == len(y)) for j, ys in part.items() if j != i and len(ys[0]) == len(part[i][0])}
            wanted |= {(i, k): j for k, (_, j) in enumerate(sorted((d, j) for j, d in near.items())[:10], 1)}
    assert {(q, k): j for q, k, j, _ in got} == wanted and len(got) == len(wanted)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_op10(spark, texts, seed, tmp_path):
    """In any order of the rows: an id with two texts has the links of both."""
    order = np.random.default_rng(seed).permutation(len(texts))
    spark.createDataFrame([texts[k] for k in order], "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = run(spark, str(tmp_path), "op10_minhash", ["doc_id", "n_shingles", "component_id", "kept"])
    sets = [(i, shingle_set(t)) for i, t in texts]
    known = [(i, s) for i, s in sets if i is not None and s]
    root = roots((i, j) for i, x in known for j, y in known if i < j and 100 * len(x & y) >= 85 * len(x | y))
    assert root[41] == root[42] == 40
    component = [(i, len(s), root.get(i, i) if i is not None and s else i) for i, s in sets]
    # A row without words whose id has other rows with links is alone.
    assert Counter(got) == Counter((i, n, c, i is None or c == i) for i, n, c in component)


def test_op10_long_words_and_texts():
    from extractlab.llm import op10_minhash as op

    long = "x" * (op.STRIPE + 10) + " b c d e f " + "y" * (2 * op.STRIPE + 3)
    assert len(op.shingles(long)) == 3
    words = " ".join(f"w{k}" for k in range(400_000))
    assert len(words) > 2 * op.STRIPE and len(op.shingles(words)) == 400_000 - 4
    shifted = "z " * 1000 + words
    assert np.isin(op.shingles(words), op.shingles(shifted)).all()


def test_op10_crowded_buckets(spark, monkeypatch):
    """Many blocks of members in different components give what brute force gives."""
    from extractlab.llm import op10_minhash as op

    monkeypatch.setattr(op, "BLOCK", 4)
    monkeypatch.setattr(op, "ROWS", 1)
    monkeypatch.setattr(op, "BANDS", 2)
    r = np.random.default_rng(4)
    common = [f"c{k}" for k in range(40)]
    rows = [" ".join([*common, *(f"u{i // 3}x{k}" for k in range(60 + int(r.integers(0, 6))))]) for i in range(60)]
    rows = list(enumerate(rows))
    sets = {i: shingle_set(t) for i, t in rows}
    root = roots((i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]))
    got = op.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == {i: root.get(i, i) for i in sets}


def test_near_duplicates_stage_keeps_one_row(spark):
    import corpus_pipeline

    rows = [(1, "a b c d e f", "p"), (1, "a b c d e f", "q"), (2, "A b c d e f", "r"), (3, "", "s"), (3, None, "t"), (None, "a b c d e f", "u"), (4, "g h", "v"), (4, "i j", "w"), (5, "i j", "x")]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id int, text string, source string"), "")
    got = [tuple(r) for r in kept.collect()]
    assert sorted(r[2] for r in got if r[0] not in (1, 4)) == ["s", "t", "u"]
    # "g h" and "i j" share an id and nothing else: both stay, the copy of "i j" goes.
    assert len([r for r in got if r[0] == 1]) == 1 and sorted(r[1] for r in got if r[0] == 4) == ["g h", "i j"] and len(got) == 6


def test_pipeline_stages_on_awkward_rows(spark, folder):
    """Every stage but the last returns rows of its input; decisions follow from the operators' own results."""
    import corpus_pipeline
    from extractlab.llm import op05_quality, op07_language

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    whole = Counter(r["number"] for r in docs.collect())

    def numbers(stage):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        return Counter(r["number"] for r in out.collect())

    model = op05_quality.train(docs, labels)
    good_ones = op05_quality.score(docs, model, ["number"]).where("score >= 0.3")
    assert numbers(corpus_pipeline.quality) == Counter(r["number"] for r in good_ones.collect())
    found = op07_language.predict(docs, op07_language.train(docs), ["number"]).where("lang_pred <> 'und' AND score >= 0.2")
    assert numbers(corpus_pipeline.language) == Counter(r["number"] for r in found.collect())
    assert numbers(corpus_pipeline.personal_data) == whole
    assert {r["doc_id"] for r in corpus_pipeline.packing(spark, docs, folder).select("doc_id").collect()} == {r["doc_id"] for r in docs.collect()}


CLASHING = ("blocks", "marks", "pii_hash", "found_id", "found_hash", "_gone", "_id", "_worded", "_quality", "_language", "_certainty", "_n_chars", "other0", "told_id", "stays", "first", "row_id", "digest", "component_id", "a.b", "number")


def test_stages_keep_clashing_columns(spark, folder):
    """Columns under the names that stages use inside come through untouched, and no text leaks into them."""
    import corpus_pipeline

    call = [f"please call me at +1 555 555 01{i:02d} before noon, thanks {i} and more words follow here" for i in range(12)]
    rows = [(5, "one two three four five six seven"), (5, "other words that share nothing with it at all"), (6, "one two three four five six seven"), (7, None), (8, ""), *((20 + i, t) for i, t in enumerate(call))]
    values = [f"v{k}" for k in range(len(CLASHING))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *values) for i, t in rows], schema).repartition(3)
    for stage in (corpus_pipeline.quality, corpus_pipeline.language, corpus_pipeline.near_duplicates, corpus_pipeline.personal_data):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        for r in out.collect():
            assert list(r)[5:] == values
    texts = {r["text"] for r in corpus_pipeline.near_duplicates(spark, docs, folder).collect() if r["doc_id"] == 5}
    assert texts == {rows[0][1], rows[1][1]}
    said = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.personal_data(spark, docs, folder).collect()}
    for i in range(12):
        text = f"please call me at [PHONE] before noon, thanks {i} and more words follow here"
        assert said[20 + i] == (text, len(text))
    assert {r["doc_id"] for r in corpus_pipeline.packing(spark, docs, folder).collect()} == {i for i, _ in rows}


def test_stage_of_near_copies_against_brute_force(spark, folder, texts):
    """One row of each group of texts, whatever their ids; of a group the smallest id and then hash."""
    import corpus_pipeline
    import xxhash

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["number"]) for r in docs.collect()]
    part = sorted({(i, t) for i, t, _ in rows if i is not None and shingle_set(t)}, key=lambda x: (x[0], x[1]))
    sets = [shingle_set(t) for _, t in part]
    root = roots((a, b) for a in range(len(part)) for b in range(a + 1, len(part)) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    signed = lambda t: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64(t.encode(), seed=42).intdigest())
    groups = defaultdict(list)
    for k, (i, t) in enumerate(part):
        groups[root.get(k, k)].append((i, signed(t), t))
    stay = {(i, t) for i, _, t in (min(g) for g in groups.values())}
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, folder).collect()]
    whole = [(i, t) for i, t, _ in rows if i is None or not shingle_set(t)]
    assert Counter(got) == Counter(whole) + Counter(stay)
