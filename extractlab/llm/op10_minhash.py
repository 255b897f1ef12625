"""Near-duplicate documents by MinHash with sequential Bayesian verification.

1. Every text becomes the set of its five-word shingles (64-bit hashes), its size, a digest of the whole
   set and ``HASHES`` MinHash values. Documents with equal sets form a class, known by its digest; its
   smallest id stands for it in the graph of links.
2. Bands of ``ROWS`` values bring candidates together. Within a bucket everything is first paired with
   one member; after these pairs are settled, only buckets that still hold several components go on:
   there all members meet those outside the bucket's largest component, in blocks, so a bucket of near
   copies costs no square. A pair is examined in the first bucket that it shares.
3. A pair's signatures are compared batch by batch; it is dropped as soon as the posterior chance that
   its similarity reaches the threshold falls under ``MISS``.
4. Surviving pairs are verified on the full sets, the most similar partner of each document first, then
   whatever still joins two components. Texts are fetched for members with a surviving pair only.

Defined results: texts without words (or null) have an empty set and link with nothing; fewer than five
words make one shingle; rows that share a doc_id are one node with the links of all their texts; rows
with a null doc_id link with nothing, get a null component and are kept; of equally similar partners
the one with the larger digest goes first, which changes no result; repeated rows get equal results;
texts are hashed in stripes, so a very long one needs a few bytes for each of its bytes; an empty table
gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from extractlab.llm.common import batch_of, bounded, table, written
from extractlab.llm.components import connected_components

WIDTH = 5
BANDS, ROWS = 20, 4
HASHES = 128
STEP = 16
MISS = 1e-6
#: A link: 100 * intersection >= THRESHOLD * union.
THRESHOLD = 85
#: A block of a bucket holds so many members on average, and so many bytes of shingles.
BLOCK, BLOCK_BYTES = 512, 64 << 20
#: Bytes of shingle sets that a task keeps.
KEPT_BYTES = 64 << 20

_P = 0x9E3779B97F4A7C15
_RANDOM = np.random.default_rng(10)
_A = _RANDOM.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(0, 2**63, HASHES, dtype=np.uint64)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
STRIPE = 1 << 20
_POWER = np.cumprod(np.full(STRIPE, _P, np.uint64))
_INVERSE = np.cumprod(np.full(STRIPE, pow(_P, -1, 2**64), np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed(word: np.ndarray) -> np.uint64:
    """The polynomial hash of one word of any length, in stripes."""
    total, factor = np.zeros(1, np.uint64), np.ones(1, np.uint64)
    for at in range(0, len(word), STRIPE):
        part = word[at : at + STRIPE].astype(np.uint64) + np.uint64(1)
        total += (part * _POWER[: len(part)]).sum(dtype=np.uint64) * factor
        factor *= _POWER[-1]
    return total[0]


def word_hashes(data: bytes) -> np.ndarray:
    """A hash for each word, in order. Stripes end at white space; what is longer than one is a single word."""
    out, at, n = [], 0, len(data)
    while at < n:
        raw = np.frombuffer(data, np.uint8, min(STRIPE, n - at), at)
        white = _WHITE[raw]
        if at + len(raw) < n:
            last = np.flatnonzero(white)
            if not len(last):
                end = _SPACE.search(data, at + STRIPE)
                raw = np.frombuffer(data, np.uint8, (end.start() if end else n) - at, at)
                out.append(np.array([hashed(raw)]) + np.uint64(len(raw)))
                at += len(raw)
                continue
            raw, white = raw[: last[-1] + 1], white[: last[-1] + 1]
        edges = np.flatnonzero(np.diff(white, prepend=True, append=True))
        starts, ends = edges[::2], edges[1::2]
        if len(starts):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _POWER[: len(raw)])))
            out.append((total[ends] - total[starts]) * _INVERSE[starts] * np.uint64(_P) + (ends - starts).astype(np.uint64))
        at += len(raw)
    return mixed(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = word_hashes((text or "").encode().lower())  # bytes: lower-cases A-Z only
    if not len(words):
        return words
    width = min(WIDTH, len(words))
    code = np.full(len(words) - width + 1, width, np.uint64)
    for j in range(width):
        code = (code ^ words[j : len(words) - width + 1 + j]) * np.uint64(0xFF51AFD7ED558CCD) + np.uint64(j)
    return np.unique(mixed(code))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values (rows: sets, none empty) as unsigned 32-bit integers."""
    flat = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), HASHES), np.uint32)
    for j in range(HASHES):
        out[:, j] = np.minimum.reduceat(((flat * _A[j] + _B[j]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def least_matches(threshold: float = THRESHOLD / 100, miss: float = MISS) -> list[tuple[int, int]]:
    """After each batch: how many values are compared, and the fewest matches with which the posterior
    chance (uniform prior) of a similarity of at least the threshold is not under ``miss``."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, least = 0.0, n + 1
        for m in range(n + 2):
            # P(S >= t | m of n) = P(Binomial(n + 1, t) <= m)
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                least = m
                break
        out.append((n, least))
    return out


def bands_for(threshold: int) -> int:
    """``BANDS``, or as many as it takes that a pair at the threshold shares no bucket with a chance of at
    most ``MISS``; from 77 on the hashes suffice for that."""
    apart = 1 - (threshold / 100) ** ROWS
    return next((n for n in range(BANDS, HASHES // ROWS) if apart**n <= MISS), HASHES // ROWS)


def surviving(a: np.ndarray, b: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the signature pairs that pass every batch, and their numbers of matches."""
    alive, matches, done = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for n, least in least_matches(threshold / 100):
        matches = matches + (a[alive, done:n] == b[alive, done:n]).sum(axis=1)
        keep = matches >= least
        alive, matches, done = alive[keep], matches[keep], n
    return alive, matches


def describe(documents: DataFrame, hashed_texts: bool = False) -> DataFrame:
    """doc_id, n_shingles, digest of the set and signature (null for empty sets); if wanted, the text's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"doc_id": pa.int64(), "n_shingles": pa.int64(), "digest": pa.binary(), "signature": pa.binary()}
        if hashed_texts:
            types["text_hash"] = pa.int64()
        for b in bounded(batches, "text", 200, 1 << 20):
            sets = [shingles(t) for t in b.column(1).to_pylist()]
            full = [s for s in sets if len(s)]
            signed = iter(signatures(full) if full else [])
            yield batch_of(types, {"text_hash": b.column(2).to_pylist() if hashed_texts else []} | {
                "doc_id": b.column(0).to_pylist(), "n_shingles": [len(s) for s in sets],
                "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                "signature": [next(signed).astype("<u4").tobytes() if len(s) else None for s in sets],
            })

    schema = "doc_id bigint, n_shingles bigint, digest binary, signature binary"
    if hashed_texts:
        return documents.select("doc_id", "text", F.xxhash64("text")).mapInArrow(run, f"{schema}, text_hash bigint")
    return documents.select("doc_id", "text").mapInArrow(run, schema)


def bands_of(signatures: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """The bucket of each signature in each band."""
    s = signatures.astype(np.uint64)
    key = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None, :], len(s), axis=0)
    for r in range(ROWS):
        key = mixed(key * np.uint64(_P) ^ s[:, r : bands * ROWS : ROWS])
    return key.view(np.int64)


def banded(classes: DataFrame, bands: int) -> DataFrame:
    """(bucket, digest): a row for each band of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                key = bands_of(np.frombuffer(b"".join(b.column(1).to_pylist()), "<u4").reshape(-1, HASHES), bands)
                digests = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), bands)))
                yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1)), digests], names=["bucket", "digest"])

    return classes.select("digest", "signature").mapInArrow(run, "bucket bigint, digest binary")


def screened(pairs: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """The pairs of digests (a, b) that pass the sequential comparison, with their matches."""
    sides = [classes.select(F.col("digest").alias(k), F.col("signature").alias(f"signature_{k}")) for k in ("a", "b")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), "<u4").reshape(-1, HASHES) for i in (2, 3))
                rows, matches = surviving(x, y, threshold)
                taken = b.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array(matches)], names=["a", "b", "matches"])

    joined = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "signature_a", "signature_b")
    return joined.mapInArrow(run, "a binary, b binary, matches bigint")


def packed_texts(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(digest, packed): one compressed text for each wanted class (digest, doc_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in bounded(batches, "text", 500, 4 << 20):
            rows = [
                (digest, pack(t.encode()))
                for t, digest in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
                if hashlib.blake2b(shingles(t).tobytes(), digest_size=16).digest() == digest
            ]
            yield batch_of({"digest": pa.binary(), "packed": pa.binary()}, {"digest": [d for d, _ in rows], "packed": [p for _, p in rows]})

    texts = documents.select("doc_id", "text").join(wanted, "doc_id").select("text", "digest")
    return texts.mapInArrow(run, "digest binary, packed binary").groupBy("digest").agg(F.min("packed").alias("packed"))


def verified(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """The pairs of digests (a, b) whose full sets are similar enough."""
    sides = [texts.select(F.col("digest").alias(k), F.col("packed").alias(f"packed_{k}")) for k in ("a", "b")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in bounded(batches, "packed_a", 500, 1 << 20):
            linked, last, x = [], None, None
            for k, (i, p, q) in enumerate(zip(*(b.column(k).to_pylist() for k in (0, 2, 3)), strict=True)):
                if i != last:
                    last, x = i, shingles(unpack(p).decode())
                if similar(x, shingles(unpack(q).decode()), threshold):
                    linked.append(k)
            yield b.select([0, 1]).take(pa.array(linked, pa.int64()))

    joined = pairs.select("a", "b").join(sides[0], "a").join(sides[1], "b").select("a", "b", "packed_a", "packed_b")
    return joined.mapInArrow(run, "a binary, b binary")


def similar(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= threshold * (len(x) + len(y) - both)


def grids(members: DataFrame) -> DataFrame:
    """The members (bucket, digest, root, n_shingles) of buckets with several components, dealt out: all of
    them by rows of blocks, those outside the largest component also by columns; a row for each cell (i, j)."""
    parts = members.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"))
    buckets = parts.groupBy("bucket").agg(
        F.count("*").alias("components"), F.sum("n").alias("n"), F.sum("size").alias("size"),
        F.max(F.struct("n", "root", "size")).alias("most"),
    ).where("components > 1")

    def blocks(n, size):
        return F.ceil(F.greatest(n / BLOCK, size * 8 / BLOCK_BYTES)).cast("int")

    sizes = written(buckets.select(
        "bucket", F.col("most.root").alias("main"), blocks(F.col("n"), F.col("size")).alias("rows"),
        blocks(F.col("n") - F.col("most.n"), F.col("size") - F.col("most.size")).alias("columns"),
    ), "minhash-blocks")
    dealt = members.join(sizes, "bucket").select(
        "bucket", "digest", "root", (F.col("root") != F.col("main")).alias("outside"), "rows", "columns",
        F.pmod(F.xxhash64("digest"), F.col("rows")).cast("int").alias("row"),
        F.pmod(F.xxhash64("digest"), F.col("columns")).cast("int").alias("column"),
    )
    left = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("columns") - 1))).select(
        "bucket", F.col("row").alias("i"), "j", "digest", "root", "outside", F.lit(True).alias("left"))
    right = dealt.where("outside").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).select(
        "bucket", "i", F.col("column").alias("j"), "digest", "root", "outside", F.lit(False).alias("left"))
    return left.unionByName(right)


def across(members: DataFrame, classes: DataFrame, documents: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) between members of one bucket in different components. Cells of blocks are compared by
    signature first; texts go only to the cells' members with a surviving pair. Within a task, members
    that a link has joined are not compared again."""
    bands = bands_for(threshold)
    cells = grids(members).join(classes.select("digest", "signature"), "digest")

    def pairs(group: pd.DataFrame, root: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each member on the left its surviving partners on the right in other components, most similar
        first. The caller may join components in ``root`` meanwhile."""
        s = np.frombuffer(b"".join(group["signature"]), "<u4").reshape(-1, HASHES)
        keys = bands_of(s, bands)
        bucket, left, outside, digest = group["bucket"].iat[0], group["left"].to_numpy(), group["outside"].to_numpy(), group["digest"].to_numpy()
        right = np.flatnonzero(~left)
        for x in np.flatnonzero(left):
            y = right[root[right] != root[x]]
            if outside[x] and len(y):  # two members outside meet in two cells
                y = y[digest[y] > digest[x]]
            if len(y):
                y = y[keys[y, (keys[y] == keys[x]).argmax(axis=1)] == bucket]
                rows, matches = surviving(np.broadcast_to(s[x], (len(y), HASHES)), s[y], threshold)
                yield x, y[rows[np.argsort(-matches, kind="stable")]]

    def numbered(group: pd.DataFrame) -> np.ndarray:
        return np.unique(group["root"].to_numpy(), return_inverse=True)[1]

    def screen(group: pd.DataFrame) -> pd.DataFrame:
        found = np.zeros(len(group), bool)
        for x, y in pairs(group, numbered(group)):
            found[x] |= len(y) > 0
            found[y] = True
        return group.loc[found, ["bucket", "i", "j", "digest", "root", "outside", "left", "signature"]]

    schema = "bucket bigint, i int, j int, digest binary, root bigint, outside boolean, left boolean, signature binary"
    close = written(cells.groupBy("bucket", "i", "j").applyInPandas(screen, schema), "minhash-close")
    wanted = close.select("digest").distinct().join(classes.select("digest", "doc_id"), "digest")
    texts = packed_texts(documents, wanted)

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        unpack = zstandard.ZstdDecompressor().decompress
        packed, digest = group["packed"].to_numpy(), group["digest"].to_numpy()
        sets: dict[int, np.ndarray] = {}

        def full(row: int) -> np.ndarray:
            if row not in sets:
                own = shingles(unpack(packed[row]).decode())
                if own.nbytes + sum(x.nbytes for x in sets.values()) > KEPT_BYTES:
                    sets.clear()
                sets[row] = own
            return sets[row]

        out = []
        root = numbered(group)
        for x, ys in pairs(group, root):
            for z in ys.tolist():
                if root[z] != root[x] and similar(full(x), full(z), threshold):
                    out.append((digest[x], digest[z]))
                    root[root == root[z]] = root[x]
        return pd.DataFrame(out, columns=["a", "b"])

    return close.join(texts, "digest").groupBy("bucket", "i", "j").applyInPandas(compare, "a binary, b binary")


def near_duplicates(documents: DataFrame, threshold: int = THRESHOLD, apart: bool = False) -> DataFrame:
    """doc_id, n_shingles, digest and component_id of every row. Rows that share an id are one node; ``apart`` keeps
    their different texts apart, numbers the groups anyhow and adds the hash of the text."""
    described = written(describe(documents, apart), "minhash")
    full = described.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = written(
        full.groupBy("digest").agg(
            F.min("doc_id").alias("doc_id"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles")
        ),
        "minhash-classes",
    )
    bands = banded(classes, bands_for(threshold))
    buckets = written(
        bands.groupBy("bucket").agg(F.min("digest").alias("lead"), F.count("*").alias("n")).where("n > 1"), "minhash-buckets"
    )
    stars = (
        bands.join(buckets, "bucket").where("digest <> lead").select(F.col("lead").alias("a"), F.col("digest").alias("b")).distinct()
    )
    survivors = written(screened(stars, classes, threshold), "minhash-survivors")
    named = classes.select("digest", "doc_id")
    nodes = written(classes.select("digest", F.monotonically_increasing_id().alias("doc_id")), "minhash-nodes") if apart else named
    wanted = survivors.select(F.col("a").alias("digest")).unionByName(survivors.select(F.col("b").alias("digest"))).distinct()
    texts = written(packed_texts(documents, wanted.join(named, "digest")), "minhash-texts")
    # The most similar partner of each class first: in a group of copies this settles nearly all.
    best = survivors.groupBy("b").agg(F.max(F.struct("matches", "a")).alias("most")).select("most.a", "b")

    def edges(pairs: DataFrame) -> DataFrame:
        sides = [nodes.select(F.col("digest").alias(k), F.col("doc_id").alias(n)) for k, n in (("a", "u"), ("b", "v"))]
        return pairs.join(sides[0], "a").join(sides[1], "b").select("u", "v")

    # Ids whose rows have different texts tie the classes of these texts together.
    several = full.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y").select("doc_id")
    tied = full.join(several, "doc_id").select(F.col("doc_id").alias("v"), "digest").join(nodes, "digest").select(F.col("doc_id").alias("u"), "v")
    first = edges(verified(best, texts, threshold))
    links = written(first if apart else first.unionByName(tied), "minhash-links")

    def rooted(components: DataFrame) -> DataFrame:
        """(digest, root): the component of each class, its own node if it has none."""
        found = components.select(F.col("node").alias("doc_id"), "component")
        return nodes.join(found, "doc_id", "left").select("digest", F.coalesce("component", "doc_id").alias("root"))

    roots = written(rooted(connected_components(links)), "minhash-roots")
    sides = [roots.select(F.col("digest").alias(k), F.col("root").alias(f"root_{k}")) for k in ("a", "b")]
    rest = survivors.join(best, ["a", "b"], "left_anti").join(sides[0], "a").join(sides[1], "b").where("root_a <> root_b")
    more = written(edges(verified(rest, texts, threshold)), "minhash-links")
    if not more.isEmpty():
        links = links.unionByName(more)
        roots = written(rooted(connected_components(links)), "minhash-roots")
    crowded = bands.join(buckets.where("n > 2").select("bucket"), "bucket")
    members = written(crowded.join(roots, "digest").join(classes.select("digest", "n_shingles"), "digest"), "minhash-members")
    last = written(edges(across(members, classes, documents, threshold)), "minhash-links")
    if not last.isEmpty():
        roots = written(rooted(connected_components(links.unionByName(last))), "minhash-roots")
    by_class = roots.select("digest", F.col("root").alias("component"))
    if apart:
        return described.join(by_class, "digest", "left").select("doc_id", "n_shingles", "digest", "text_hash", F.col("component").alias("component_id"))
    return described.join(by_class, "digest", "left").select(
        "doc_id", "n_shingles", "digest", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")
    )


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents")).drop("digest")
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
