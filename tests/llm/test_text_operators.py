"""The text operators on awkward documents, against the library, brute force or known answers.

Every table here has nulls, empty and long texts, repeated rows and columns whose names clash with the
operators' own."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from extractlab.llm import op01_bpe, op03_pii, op04_packing, op05_quality, op06_token_files, op07_language, op09_toxicity, op10_minhash
from extractlab.llm.common import scratch_dir
from extractlab.llm.tokens import default_path, encoder

WORDS = "the river of stone and light was over an old house that nobody owned since winter".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fold int, label int, rank int, salt int, digest binary"


def passage(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", ".", ",", "\n"]) for _ in range(n))


def awkward() -> list[tuple]:
    shared = passage(1, 600)
    texts = [
        None, "", " ", "  two  spaces  and\ttabs \n\n", "a", "<|endoftext|> x<|endoftext|>", "naïve café – “quotes” 日本語 テスト 😀 é nbsp",
        shared, shared, "intro " + shared, passage(2, 50) + " " + shared + " " + passage(3, 70), "x" * 5000, "ab " * 4000, " " * 3000 + "end", passage(4, 8000),
        "mail a.b+c@mail.example.com, ip 10.0.0.255 and 10.0.0.256; card 4242 4242 4242 4242, phone +1 (555) 555-0100.", "1" * 20000, "+1 " * 5000,
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, shared), (None, "no id " + shared), (None, None)]
    return [(i, t, "en", "s", len(t or ""), 0.5, 1, 1, 1, 1, b"") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_path())


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200) | st.lists(st.sampled_from(["a", " ", "  ", "\n", "é", "'s", "12", "<|endoftext|>", "日", " ", "!?", "word"]), max_size=40).map("".join))
def test_encoder_is_the_library(text):
    enc, lib = encoder(default_path()), Tokenizer.from_file(default_path()) if not hasattr(test_encoder_is_the_library, "lib") else test_encoder_is_the_library.lib
    test_encoder_is_the_library.lib = lib
    ids = lib.encode(text, add_special_tokens=False).ids
    assert enc.encode(text).tolist() == ids
    assert enc.decode(np.array(ids, np.uint32)) == lib.decode(ids, skip_special_tokens=False)


def test_chunks_follow_content():
    a, b = passage(5, 3000).encode(), ("another start " + passage(5, 3000)).encode()
    def chunks(x):
        return {x[s:e] for s, e in zip([0, *op01_bpe.boundaries(x)], op01_bpe.boundaries(x), strict=False)}

    assert b"".join(b[s:e] for s, e in zip([0, *op01_bpe.boundaries(b)], op01_bpe.boundaries(b), strict=False)) == b
    assert len(chunks(a) & chunks(b)) >= len(chunks(a)) - 3


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=" abcé\n日.", max_size=300), st.data())
def test_repaired_joins_agree(text, data):
    enc, raw = encoder(default_path()), text.encode()
    cuts = sorted(set(data.draw(st.lists(st.integers(0, len(text)), max_size=6))))
    places = [len(text[:c].encode()) for c in cuts]
    shared = {s: (e - s, enc.encode(raw[s:e].decode())) for s, e in zip(places, places[1:], strict=False) if data.draw(st.booleans())}
    assert op01_bpe.assemble(enc, raw, shared).tolist() == enc.encode(text).tolist()


def test_bpe(docs, empty, library):
    out = op01_bpe.encode(docs, mean=512).collect()
    wanted = [(r[0], np.array(library.encode(r[1] or "", add_special_tokens=False).ids, "<u4").tobytes(), r[1] or "") for r in awkward()]
    assert key((r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in out) == key(wanted)
    assert op01_bpe.encode(empty).count() == 0


def test_elias_fano():
    r = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (1, 10**9), (500, 3), (1000, 10**7), (200, 200)):
        v = np.sort(r.integers(0, top, n)).astype(np.uint64)
        f, _ = op06_token_files.EliasFano.from_bytes(op06_token_files.EliasFano.build(v).to_bytes())
        assert f.values().tolist() == v.tolist() and [f.select(i) for i in range(n)] == v.tolist()
        if n >= 200:
            assert len(f.to_bytes()) < n * (2 + np.log2(max(2, top / n)) + 1) / 8 + 200


def test_token_files(spark, docs, empty, library):
    folder = f"{scratch_dir(spark)}/files"
    files = op06_token_files.write_token_files(docs, folder, file_ids=3000)
    assert files.count() > 3
    out = op06_token_files.read_token_files(files).collect()
    at, wanted = 0, defaultdict(list)
    assert sum(r["n_tokens"] for r in out) == sum(len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in awkward())
    for r in sorted(out, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
        wanted[r["doc_id"]].append((r["n_tokens"], r["ids_crc32"]))
    order = [r["doc_id"] for r in sorted(out, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    for doc, text in ((r[0], r[1]) for r in awkward()):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (len(ids), zlib.crc32(ids.tobytes())) in wanted[doc]
    assert op06_token_files.read_token_files(op06_token_files.write_token_files(empty, folder + "-none")).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 60), max_size=25))
def test_plans_are_packings(histogram):
    p = op04_packing.plan(histogram, 64, 12)
    ranks, space = defaultdict(set), defaultdict(list)
    for length, lo, hi, copies, first, offset in p.runs:
        for r in range(lo, hi):
            assert r not in ranks[length]
            ranks[length].add(r)
            space[first + (r - lo) // copies].append((offset + (r - lo) % copies * length, length))
    assert {k: len(v) for k, v in ranks.items()} == histogram and all(v == set(range(len(v))) for v in ranks.values())
    for held in space.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64
    assert set(space) == set(range(p.sequences))
    plain: list[int] = []  # first fit, longest first
    for length in sorted((k for k, v in histogram.items() for _ in range(v)), reverse=True):
        at = next((i for i, free in enumerate(plain) if free >= length), None)
        if at is None:
            plain.append(64 - length)
        else:
            plain[at] -= length
    assert -(-sum(k * v for k, v in histogram.items()) // 64) <= p.sequences <= len(plain) + 1


def test_packing(spark, docs, empty, library):
    from extractlab.llm.common import written

    out = op04_packing.pack(written(op04_packing.pieces(docs, 256), "t"), 256).collect()
    rows = defaultdict(list)
    for r in out:
        rows[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in rows.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 256
    crcs = sorted(r["ids_crc32"] for r in out)
    wanted = []
    for r in awkward():
        ids = np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 256 or 256
        wanted += [zlib.crc32(x.tobytes()) for x in np.split(ids, range(first, len(ids), 256))]
    assert crcs == sorted(wanted)
    assert op04_packing.pack(written(op04_packing.pieces(empty), "t")).count() == 0


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    def luhn(s):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0

    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            n = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(n) <= 19 and luhn(n), "phone": 8 <= len(n) <= 15}
            if good[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans(spark):
    r = random.Random(3)
    bits = ["a@b.co", "x.y@z-1.com.org", "@", ".", "1.2.3.4", "300.1.1.1", "001.2.3.4", "4242424242424242", "4242-4242 4242 4242", "+", "+49 30 1234567", "+1(2)3", "é", "😀", " ", "-", "7", "a", "%", ".."]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(400)] + ["a@b.c+d@e.f", "1.2.3.4.5.6.7.8", None, ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scanned, found = op03_pii.find_pii(frame)
    rows = found.where("seed").join(scanned.select("row_id", "doc_id"), "row_id").collect()
    got = defaultdict(list)
    for x in rows:
        got[x["doc_id"]].append((x["kind"], x["start"], x["end"]))
    for i, t in enumerate(texts):
        assert sorted(got[i]) == sorted(base_spans(t or "")), t


def test_context_finds_unseen_identifiers(spark):
    texts = [f"please call me at +1 555 555 01{i:02d} before noon, thanks {i}" for i in range(12)]
    texts += ["please call me at 555 555 0177 before noon, thanks", "the year 2024 555 0199 of nothing at all", None, ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scanned, found = op03_pii.find_pii(frame)
    new = found.where("NOT seed").join(scanned.select("row_id", "doc_id"), "row_id").collect()
    assert [(r["doc_id"], r["kind"], r["value"]) for r in new] == [(12, "phone", "555 555 0177")]
    redacted = {r["doc_id"]: r["text"] for r in op03_pii.redact(frame).collect()}
    assert redacted[12] == "please call me at [PHONE] before noon, thanks" and redacted[13] == texts[13] and redacted[14] is None


def test_pii_on_awkward_rows(docs, empty):
    out = op03_pii.redact(docs, block=64)
    assert out.columns == docs.columns and out.count() == docs.count()
    text = {r["doc_id"]: r["text"] for r in out.collect() if r["doc_id"] is not None}
    assert text[15] == "mail [EMAIL], ip [IP] and 10.0.0.256; card [CARD], phone [PHONE]."
    assert op03_pii.redact(empty).count() == 0


def labelled(spark, column: str):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(260):
        bad = i % 4 == 0
        if column == "quality":
            text = " ".join(["buy", "now!!", "CLICK"] * r.randint(5, 20)) if bad else passage(i + 100, r.randint(20, 120))
            label = int(not bad)
        else:
            words = passage(i + 100, 80).split()
            if bad:
                for _ in range(6):
                    words.insert(r.randrange(len(words)), r.choice(["zorgling", "zorglings", "vilefex"]))
            text, label = " ".join(words), int(bad)
        rows.append((i, text, "en", "s", len(text), 0.0, 0, 0, 0, 0, b""))
        labels.append((i, label, 9, "x"))
    rows += [(None, None, None, None, None, None, None, None, None, None, None), (900, "", "en", "s", 0, 0.0, 0, 0, 0, 0, b"")]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*labels, (None, 1, 1, "y"), (5, None, 1, "z")], f"doc_id long, {column} int, fold int, text string")


def test_quality(spark, empty):
    docs, labels = labelled(spark, "quality")
    scores = op05_quality.score(docs, op05_quality.train(docs, labels)).collect()
    assert len(scores) == docs.count() and all(0 <= r["score"] <= 1 for r in scores)
    held = [r for r in scores if r["doc_id"] is not None and r["doc_id"] < 260 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    right = [(r["score"] >= 0.3) == (r["doc_id"] % 4 != 0) for r in held]
    assert len(held) > 30 and sum(right) / len(right) > 0.95
    none = op05_quality.train(docs, labels.limit(0))
    assert {r["score"] for r in op05_quality.score(docs, none).collect()} == {0.5}
    assert op05_quality.score(empty, none).count() == 0


def test_interactions_are_pairwise():
    r = np.random.default_rng(4)
    m = op05_quality.Machine(np.zeros((1, 1)), 0.3, r.normal(size=20), r.normal(size=(20, 8)))
    index, value = np.array([1, 4, 7, 2, 3]), r.normal(size=5)
    got = m.logits(index, value, np.array([0, 3]))
    for own, z in ((slice(0, 3), got[0]), (slice(3, 5), got[1])):
        i, v = index[own], value[own]
        slow = 0.3 + m.weights[i] @ v + sum(m.factors[i[a]] @ m.factors[i[b]] * v[a] * v[b] for a in range(len(i)) for b in range(a))
        assert np.isclose(z, slow)


def test_language(spark, docs, empty):
    voices = {"en": "the and with that this from have", "de": "der und nicht eine mit sich auch", "fr": "les des une dans pour avec est", "xx": "zyq qyz zzy qqz yqz"}
    r = random.Random(6)
    rows = [(i, " ".join(r.choice(v.split()) for _ in range(40)), lang) for i, (lang, v) in enumerate(list(voices.items()) * 30)]
    table = spark.createDataFrame([*rows, (500, "123 !?", "en"), (501, None, "en"), (502, "the and with", None), (None, "der und", "de")], "doc_id long, text string, lang string")
    model = op07_language.train(table)
    assert model.families == ["germanic", "own:xx", "romance"] and model.languages["germanic"] == ["de", "en"]
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in op07_language.predict(table, model).collect()}
    assert all(got[i][0] == lang and 0 <= got[i][1] <= 1 for i, _, lang in rows)
    assert got[500] == got[501] == ("und", 0.0) and got[502][0] == "en" and got[None][0] == "de"
    nothing = op07_language.train(empty)
    assert {x["lang_pred"] for x in op07_language.predict(docs, nothing).collect()} == {"und"}
    assert op07_language.predict(empty, model).count() == 0


def brute_segments(scores: list[float]) -> list[tuple[int, int]]:
    """By definition: the best segment, the shortest of equals, then the same on both sides of it."""
    def split(lo, hi):
        best = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0,))
        if best[0] <= 1e-12:
            return []
        return [*split(lo, best[3]), (best[3], best[4]), *split(best[4], hi)]

    return split(0, len(scores))


@settings(max_examples=120, deadline=None)
@given(st.lists(st.none() | st.integers(1, 1000), max_size=14), st.integers(1, 400))
def test_segments(gains, loss):
    gains = [None if g is None else g + k * 0.001 for k, g in enumerate(gains)]
    hits = [(i, g) for i, g in enumerate(gains) if g is not None]
    got = [(s, e) for s, e, _ in op09_toxicity.segments(hits, loss + 0.0003, len(gains))]
    assert got == brute_segments([-(loss + 0.0003) if g is None else g for g in gains])


def test_toxicity(spark, empty):
    docs, labels = labelled(spark, "toxic")
    model = op09_toxicity.train(docs, labels)
    scores = op09_toxicity.score(docs, model).collect()
    assert len(scores) == docs.count() and all(0 <= r["score"] <= 1 for r in scores)
    known = [r for r in scores if r["doc_id"] is not None and r["doc_id"] < 260]
    assert sum((r["score"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in known) / len(known) > 0.97
    assert {r["score"] >= 0.5 for r in scores if r["doc_id"] in (None, 900)} == {False}
    assert op09_toxicity.train(docs, labels.limit(0)).gains == {} and op09_toxicity.score(empty, model).count() == 0


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text):
    w = words(text)
    n = min(5, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def near_corpus():
    r = random.Random(12)
    base = [passage(i, 120) for i in range(6)]
    rows = []
    for b in base:
        for _ in range(25):
            w = b.split(" ")
            for _ in range(r.choice([0, 0, 1, 2, 3, 5])):
                w[r.randrange(len(w))] = r.choice(["alpha", "beta", "gamma", "delta"])
            rows.append(" ".join(w))
    rows += ["one two", "One TWO", "one two three", None, "", "É two", "é two"]
    return list(enumerate(rows))


def test_near_duplicates(spark, docs, empty):
    from extractlab.llm.components import roots

    rows = near_corpus()
    sets = {i: shingle_set(t) for i, t in rows}
    links = [(i, j) for i in sets for j in sets if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    root = roots(iter(links))
    got = op10_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(s), root.get(i, i)) for i, s in sets.items()}
    out = op10_minhash.near_duplicates(docs).collect()
    assert len(out) == docs.count() and {r["component_id"] for r in out if r["doc_id"] is None} == {None}
    assert {r["component_id"] for r in out if r["doc_id"] in (7, 8)} == {7}
    assert op10_minhash.near_duplicates(empty).count() == 0


def test_pipeline_drops_near_copies_from_0_8(spark):
    """The stage against brute force at 0.8, with chains that only links under 0.85 hold together."""
    import corpus_pipeline
    from extractlab.llm.components import roots

    rows = []
    for i in range(80):
        w, v = ([f"{c}{i}x{k}" for k in range(104)] for c in "wv")  # ten words at an end cost ten of 100 shingles
        rows += [" ".join(x) for x in (w, w[:94] + v[94:], v[:10] + w[10:94] + v[94:])]
    rows = list(enumerate(rows))
    sets = {i: shingle_set(t) for i, t in rows}
    part = {(i, j): 100 * len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in sets for j in range(i + 1, min(i + 3, len(rows)))}
    links = [p for p, share in part.items() if share >= 80]
    assert len(links) == 160 and max(part.values()) < 85
    root = roots(iter(links))
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({root.get(i, i) for i in sets})


def test_bands_reach_the_threshold():
    assert op10_minhash.bands_for(85) == op10_minhash.BANDS and op10_minhash.bands_for(80) == 27
    r = np.random.default_rng(4)
    a = r.integers(0, 2**32, (20000, op10_minhash.HASHES), dtype=np.uint32)
    b = np.where(r.random(a.shape) < 0.8, a, a + np.uint32(1))
    assert len(op10_minhash.surviving(a, b, 80)[0]) >= 19998
    same = op10_minhash.bands_of(a, 27) == op10_minhash.bands_of(b, 27)
    assert same.any(axis=1).all()


def test_pruning_keeps_similar_pairs():
    """At the threshold itself, fewer than one pair in ten thousand is lost to the sequential comparison."""
    r = np.random.default_rng(3)
    a = r.integers(0, 2**32, (20000, op10_minhash.HASHES), dtype=np.uint32)
    b = np.where(r.random(a.shape) < 0.85, a, a + np.uint32(1))
    rows, _ = op10_minhash.surviving(a, b)
    assert len(rows) >= 19998
    rows, _ = op10_minhash.surviving(a, np.where(r.random(a.shape) < 0.3, a, a + np.uint32(1)))
    assert len(rows) < 20


def test_digest_is_of_the_set():
    a, b = op10_minhash.shingles("a b c d e f"), op10_minhash.shingles("A\tb  c\nd e F ")
    assert hashlib.sha256(a.tobytes()).digest() == hashlib.sha256(b.tobytes()).digest() and len(a) == 2
    assert F is not None
