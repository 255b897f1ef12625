"""Centroids, tokenizer alignment and fingerprints against plain Python, on awkward rows."""

import hashlib
import json
from collections import Counter

import numpy as np
import pytest
import regex
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from extractlab.llm import op11_lloyd, op12_alignment, op13_fingerprints, queries
from extractlab.llm.op12_alignment import default_paths

from .test_text_operators import awkward

EXTRA = "kind string, block long, at int, stripe int, slice int, place long, term long, df long, bucket long, cluster int, v binary, own int"
CLASH = ("k", 1, 2, 3, 4, 5, 6, 7, 8, 9, b"x", 10)


def documents(spark, rows):
    return spark.createDataFrame([(*r, *CLASH) for r in rows], f"doc_id long, text string, {EXTRA}").repartition(5)


# ---- centroids


def vector_rows():
    r = np.random.default_rng(11)
    good = [[float(x) for x in np.float32(r.normal(size=64))] for _ in range(60)]
    rows = [(i, e) for i, e in enumerate(good)] + [(70, good[0]), (70, good[1]), (71, good[2]), (71, good[2]), (None, good[3])]
    return rows + [(80, None), (81, []), (82, [1.0] * 63), (83, [1.0] * 65), (84, [*good[0][:63], None]), (85, [*good[0][:63], float("nan")]), (86, [*good[0][:63], float("-inf")]), (87, [0.0] * 64), (88, [-200000.0] + [3.0e38] * 63)]


def by_hand(rows, clusters=8, rounds=10):
    held = [(i, [max(-(1 << 27), min(1 << 27, int(np.floor(np.float64(x) * 1024)))) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and np.isfinite(x) for x in e)]
    named = sorted(held, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes()))
    centroids = [e for _, e in named[:clusters]]

    def nearest(e):
        return min((sum((a - b) ** 2 for a, b in zip(e, c, strict=True)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, e in held:
            groups.setdefault(nearest(e)[1], []).append(e)
        for k, own in groups.items():
            centroids[k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [(i, *nearest(e)[::-1]) for i, e in held]
    by = Counter()
    for _, k, d in found:
        by[k] += d
    return Counter((i, k, d, by[k], sum(by.values()), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for i, k, d in found)


@pytest.mark.parametrize("some", [slice(None), slice(0, 5), slice(65, 70)])
def test_lloyd(spark, tmp_path, some):
    rows = vector_rows()[some]
    spark.createDataFrame([(*r, *CLASH) for r in rows], f"vec_id long, embedding array<float>, {EXTRA}").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.queries()["op11_lloyd"](spark, str(tmp_path))
    assert Counter(tuple(r) for r in got.collect()) == by_hand(rows)


def test_lloyd_with_few_slices(spark, monkeypatch):
    monkeypatch.setattr(op11_lloyd, "SLICE", 7)
    rows = vector_rows()
    found, centroids = op11_lloyd.lloyd(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2), clusters=3, rounds=2)
    wanted = by_hand(rows, 3, 2)
    assert Counter((r["vec_id"], r["cluster"], r["distance"]) for r in found.collect()) == Counter({}) + Counter([w[:3] for w in wanted.elements()])
    assert centroids.shape == (3, 64)


# ---- tokenizer alignment


def side_bytes():
    a_path, b_path = default_paths()
    lib = Tokenizer.from_file(a_path)
    lib.encode_special_tokens = True
    with open(a_path, encoding="utf-8") as f:
        spec = json.load(f)
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or (0xA1 <= b and b != 0xAD)]
    chars = {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
    a = {i: bytes(chars[c] for c in p) for p, i in spec["model"]["vocab"].items() if all(c in chars for c in p)}
    pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
    b = {i: bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in range(pieces.vocab_size())}
    return lib, a, pieces, b


def alignment_by_hand(rows):
    lib, a_bytes, pieces, b_bytes = side_bytes()
    docs, counts = [], Counter()
    for i, t in rows:
        x = lib.encode(" " + t, add_special_tokens=False).ids if t else []
        y = pieces.encode(t) if t else []
        raw = (" " + t).encode() if t else b""
        if not t or b"".join(a_bytes[k] for k in x) != raw or b"".join(b_bytes[k] for k in y) != raw:
            docs.append((i, [], [], []))
            continue
        ends = lambda ids, size: list(np.cumsum([len(size[k]) for k in ids]))
        ex, ey = ends(x, a_bytes), ends(y, b_bytes)
        links, j = [], 0
        for k, stop in enumerate(ex):
            start = ex[k - 1] if k else 0
            while j < len(ey) and ey[j] <= start:
                j += 1
            m = j
            while m < len(ey) and (ey[m - 1] if m else 0) < stop:
                links.append((x[k], y[m]))
                m += 1
        groups, at_x, at_y = [], 0, 0
        for stop in sorted(set(ex) & set(ey)):
            to_x, to_y = ex.index(stop) + 1, ey.index(stop) + 1
            groups.append(",".join(map(str, x[at_x:to_x])) + "|" + ",".join(map(str, y[at_y:to_y])))
            at_x, at_y = to_x, to_y
        counts.update(links)
        docs.append((i, (x, y), groups, links))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for i, xy, groups, links in docs:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((i, *((len(xy[0]), len(xy[1])) if xy else (0, 0)), len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), digest))
    return Counter(out)


def alignment_rows():
    texts = ["<|endoftext|> <s></s><unk> <0x41> \x00 ▁x", "a▁b", " lead  two \n\t tabs ", "日本語のテキスト ﬁ é 😀👍🏽", "­​ ﻿", "the the the the", "x" * 3000, "ab " * 2000, " "]
    return [(r[0], r[1]) for r in awkward()] + [(200 + k, t) for k, t in enumerate(texts)] + [(205, texts[5])]


@pytest.mark.parametrize("small", [False, True])
def test_alignment(spark, tmp_path, monkeypatch, small):
    if small:
        for name, value in (("BLOCK_DOCS", 3), ("HELD", 40), ("ROW_PAIRS", 2), ("SLICE_BYTES", 64), ("STRIPES", 500)):
            monkeypatch.setattr(op12_alignment, name, value)
    rows = alignment_rows()
    docs = documents(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.queries()["op12_alignment"](spark, str(tmp_path))
    assert got.dtypes[:1] == [("doc_id", "bigint")]
    wanted = alignment_by_hand(rows)
    assert Counter(tuple(r) for r in got.collect()) == wanted
    assert sum(w[1] == 0 for w in wanted) >= 2 and any(w[5] < w[4] for w in wanted)


# ---- fingerprints


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def hashed(data, seed=42):
    return signed(xxhash.xxh64(data, seed=seed).intdigest())


def fingerprints_by_hand(rows):
    rows = [(i, t or "") for i, t in rows]
    terms = lambda t: {x for x in regex.split(r"[^\p{L}\p{M}\p{N}]+", t.lower()) if x}
    df = Counter(x for _, t in rows for x in terms(t))
    lexicon = {hashed(x.encode()) for x, n in df.items() if n >= 2 and 2 * n <= len(rows)}

    def fingerprint(text):
        found = terms(text)
        level = max(5, max(0, len(found) - 1).bit_length() - 1 if len(found) > 1 else 0)
        held = sorted(h for h in (hashed(x.encode()) for x in found) if h in lexicon and h & ((1 << level) - 1) < 32)
        if not held:
            return None, f"={hashed(text.encode()) & ((1 << 64) - 1):x}"
        parts = []
        for bits in (level, level + 1):
            row = []
            for j in range(32):
                seed = 42
                for h in held:
                    if h & ((1 << bits) - 1) == j:
                        seed = hashed(h.to_bytes(8, "little", signed=True), seed & ((1 << 64) - 1))
                row.append("" if seed == 42 else f"{seed & 0xFFFFFFFF:08X}")
            parts.append(row)
        return {level: parts[0], level + 1: parts[1]}, f"{level}|{','.join(parts[0])}|{','.join(parts[1])}"

    def likeness(a, b):
        if a[1] == b[1]:
            return 1.0
        both = [(x, y) for k in (set(a[0] or ()) & set(b[0] or ())) for x, y in zip(a[0][k], b[0][k], strict=True) if x or y]
        return sum(x == y for x, y in both) / len(both) if both else 0.0

    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashed(r[1].encode())))
    out = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        third = len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        a, e, n = fingerprint(t), fingerprint(edited), fingerprint(after)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a[1], e[1], round(likeness(a, e), 9), round(likeness(a, n), 9)))
    return Counter(out)


def fingerprint_rows():
    r = np.random.default_rng(13)
    words = [f"wort{k}" for k in range(900)] + ["Straße", "ÉTÉ", "日本", "naïve"]
    texts = [" ".join(words[k] for k in r.integers(0, len(words), int(r.integers(1, 400)))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(i + 100, t + " more words at the end") for i, t in enumerate(texts[:20])]
    rows += [(300, texts[0]), (301, texts[0]), (-5, "😀" * 10 + texts[1]), (-(1 << 63), "x y z"), ((1 << 63) - 1, texts[2])]
    return rows + [(r[0], r[1]) for r in awkward()]


@pytest.mark.parametrize("kind", ["plain", "null ids", "one id", "single"])
def test_fingerprints(spark, tmp_path, kind):
    rows = fingerprint_rows()
    if kind == "null ids":
        rows = [(None if k % 3 == 0 else i, t) for k, (i, t) in enumerate(rows)]
    elif kind == "one id":
        rows = [(17 if k % 2 else i, t) for k, (i, t) in enumerate(rows)]
    elif kind == "single":
        rows = [(4, "alone with its own words, abc")]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.queries()["op13_fingerprints"](spark, str(tmp_path))
    found = Counter((*r[:5], round(r[5], 9), round(r[6], 9)) for r in map(tuple, got.collect()))
    wanted = fingerprints_by_hand(rows)
    assert found == wanted
    if kind == "plain":
        assert np.mean([w[5] for w in wanted]) > np.mean([w[6] for w in wanted]) + 0.15


def test_fingerprints_stay_in_dataframe_functions(spark, tmp_path):
    documents(spark, fingerprint_rows()).write.parquet(f"{tmp_path}/documents.parquet")
    plan = queries.queries()["op13_fingerprints"](spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_tables(spark):
    docs = documents(spark, []).select("doc_id", "text")
    assert op12_alignment.alignment(docs).collect() == [] and op13_fingerprints.fingerprints(docs).collect() == []
    found, centroids = op11_lloyd.lloyd(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert found.collect() == [] and len(centroids) == 0
