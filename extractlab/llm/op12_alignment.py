"""Alignment of two tokenizers' ids through the bytes that their tokens share.

1. A task encodes its documents with both tokenizers and places all tokens of a block of documents on one
   line of bytes. Between two neighbouring token ends of either side lies exactly one pair of tokens whose ranges
   overlap (a link); ends that both sides have cut a document into groups. One row for each document and, for each
   stripe of side-B ids, one row of the block's distinct (document, pair, times) are written to the shared folder.
   Stripes deal B ids out by remainder, so that neighbouring, equally frequent ids spread.
2. Counting: tasks sum equal pairs of what they read, and the sums meet by stripe. A stripe's counts are a dense
   block (its B ids by all A ids), filled with ``np.add.at``; what is not zero is written.
3. Scoring: counts and links meet again by stripe and slice; the dense block is loaded, its row maxima are the best
   counts, and each link row gives sums by document, which are added up by block. A stripe with many links is
   dealt into slices of at most ``SLICE_BYTES``, each with a copy of the stripe's counts.

A task holds one dense block (``STRIPES`` bound its size by the two vocabularies alone), one block of documents or
``HELD`` summed pairs, whatever the table's size.

Defined results: a text that is null, empty, or whose joined token bytes of either side differ from a space and the
text has no tokens: zeros and an empty ``groups_sha256``; strings of special tokens are plain text; repeated rows
each count and each get a row; ties for the best count all count; null doc_ids are kept; very long texts
are encoded whole, in a block of their own; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from extractlab.llm.common import batch_of, bounded, scratch_dir, table, written
from extractlab.llm.tokens import Encoder

STRIPES = 256
BLOCK_DOCS, BLOCK_BYTES = 512, 4 << 20
#: Distinct pairs that a counting task holds, pairs in a row of counts, and bytes of links in a slice.
HELD, ROW_PAIRS, SLICE_BYTES = 1 << 21, 1 << 18, 64 << 20


class Side:
    """One tokenizer: ids of texts, and the bytes of every id."""

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))


class ByteSide(Side):
    """Byte-level ids of a space and the text."""

    def __init__(self, path: str):
        self.own = Encoder(path)
        self.own.slow.encode_special_tokens = True  # their strings in a text are then ordinary text
        self.own.special = []
        self.token_bytes = self.own.token_bytes

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.own.encode(" " + t).tolist() for t in texts]


class PieceSide(Side):
    """Pieces of the text; the model puts the space before it."""

    def __init__(self, path: str):
        import sentencepiece

        self.own = sentencepiece.SentencePieceProcessor(model_file=path)
        spelled = [self.own.id_to_piece(i) for i in range(self.own.vocab_size())]
        self.token_bytes = [bytes([int(p[3:5], 16)]) if self.own.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(spelled)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.own.encode(texts, num_threads=1)


@functools.lru_cache(maxsize=2)
def sides(a_path: str, b_path: str) -> tuple[ByteSide, PieceSide, np.ndarray, np.ndarray, list[str]]:
    """Both sides, their tokens' lengths, and the spellings of ids before a comma, bar or semicolon."""
    a, b = ByteSide(a_path), PieceSide(b_path)
    spelled = [f"{i}{end}" for n, end in ((a, ","), (a, "|"), (b, ","), (b, ";")) for i in range(len(n.token_bytes))]
    return a, b, np.array([*map(len, a.token_bytes)]), np.array([*map(len, b.token_bytes)]), spelled


def vocabularies(a_path: str, b_path: str) -> tuple[int, int]:
    """The numbers of ids of both sides, read without building the encoders."""
    import sentencepiece

    with open(a_path, encoding="utf-8") as f:
        spec = json.load(f)
    ids = [*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))]
    return max(ids) + 1, sentencepiece.SentencePieceProcessor(model_file=b_path).vocab_size()


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Linked:
    """Documents ``at`` of a block that have tokens, and their links as rows of (document, A id, B id)."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    digests: list[str]
    link_doc: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def linked(texts: list[str | None], a_path: str, b_path: str) -> Linked:
    """Tokens, groups and links of a block of documents."""
    a, b, a_lengths, b_lengths, spelled = sides(a_path, b_path)
    n = len(texts)
    have = [i for i, t in enumerate(texts) if t]
    own = [texts[i] for i in have]
    kept, ids_a, ids_b = [], [], []
    for i, t, x, y in zip(have, own, a.encode(own), b.encode(own), strict=True):
        raw = b" " + t.encode()
        if a.joined(x) == raw and b.joined(y) == raw:
            kept.append(i)
            ids_a.append(x)
            ids_b.append(y)
    at = np.array(kept, np.int64)
    n_a, n_b = np.zeros(n, np.int64), np.zeros(n, np.int64)
    n_a[at], n_b[at] = [len(x) for x in ids_a], [len(x) for x in ids_b]
    flat_a = np.fromiter((i for x in ids_a for i in x), np.int64, int(n_a.sum()))
    flat_b = np.fromiter((i for x in ids_b for i in x), np.int64, int(n_b.sum()))
    ends_a, ends_b = a_lengths[flat_a].cumsum(), b_lengths[flat_b].cumsum()
    ends = np.union1d(ends_a, ends_b)  # one link each
    both_a, both_b = np.isin(ends_a, ends_b, assume_unique=True), np.isin(ends_b, ends_a, assume_unique=True)
    of_a, of_b = np.repeat(np.arange(n), n_a), np.repeat(np.arange(n), n_b)
    n_groups = np.bincount(of_a[both_a], minlength=n)
    # Spellings in order: by group, A before B, then by place; a group's last id of a side has the other end.
    group_a, group_b = np.cumsum(both_a) - both_a, np.cumsum(both_b) - both_b
    place = np.concatenate((np.arange(len(flat_a)) + np.searchsorted(group_b, group_a), np.arange(len(flat_b)) + np.searchsorted(group_a, group_b, "right")))
    kinds = np.concatenate((flat_a + both_a * len(a_lengths), 2 * len(a_lengths) + flat_b + both_b * len(b_lengths)))
    ordered = np.empty(len(kinds), np.int64)
    ordered[place] = kinds
    digests, start = [""] * n, 0
    for i in kept:
        stop = start + int(n_a[i] + n_b[i])
        said = "".join(map(spelled.__getitem__, ordered[start:stop].tolist()))
        digests[i], start = hashlib.sha256(said[:-1].encode()).hexdigest(), stop
    link_at = np.searchsorted(ends_a, ends)
    return Linked(n_a, n_b, n_groups, digests, of_a[link_at], flat_a[link_at], flat_b[np.searchsorted(ends_b, ends)])


DOCS = {"block": pa.int64(), "at": pa.int32(), "doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "groups_sha256": pa.string()}
LINKS = {"stripe": pa.int32(), "docs": pa.binary(), "pairs": pa.binary(), "times": pa.binary()}
BOTH = {"kind": pa.string()} | DOCS | LINKS
BOTH_SQL = "kind string, block long, at int, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, stripe int, docs binary, pairs binary, times binary"


def aligned(documents: DataFrame, a_path: str, b_path: str, stripes: int = STRIPES) -> tuple[DataFrame, DataFrame]:
    """Rows of documents (``DOCS``), and rows of links by block and stripe (block, ``LINKS``), written in one pass.

    A pair is its place in the stripe's dense block: the B id's row there times the A ids, and the A id."""
    columns = {**DOCS, **LINKS}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for b in bounded(batches, "text", BLOCK_DOCS, BLOCK_BYTES):
            block = part << 32 | number
            number += 1
            found = linked(b.column(1).to_pylist(), a_path, b_path)
            n, width = b.num_rows, len(sides(a_path, b_path)[2])
            none = dict.fromkeys(columns, [None] * n)
            yield batch_of(BOTH, none | {"kind": ["docs"] * n, "block": [block] * n, "at": range(n), "doc_id": b.column(0).to_pylist(), "n_a": found.n_a, "n_b": found.n_b, "n_groups": found.n_groups, "groups_sha256": found.digests})
            size = -(-len(sides(a_path, b_path)[3]) // stripes) * width  # places in a stripe
            key = ((found.link_b % stripes) * size + (found.link_b // stripes) * width + found.link_a) * n + found.link_doc
            key, times = np.unique(key, return_counts=True)
            pair, doc = np.divmod(key, max(1, n))
            stripe, pair = np.divmod(pair, size)
            some, first = np.unique(stripe, return_index=True)
            edges = [*first.tolist(), len(key)]
            cut = lambda x, t: [x[i:j].astype(t).tobytes() for i, j in zip(edges, edges[1:], strict=False)]
            m = len(some)
            none = dict.fromkeys(columns, [None] * m)
            yield batch_of(BOTH, none | {"kind": ["links"] * m, "block": [block] * m, "stripe": some, "docs": cut(doc, "<u2"), "pairs": cut(pair, "<u4"), "times": cut(times, "<u4")})

    path = f"{scratch_dir(documents.sparkSession)}/aligned-{uuid.uuid4().hex}"
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encode, BOTH_SQL)
    rows.write.option("compression", "zstd").partitionBy("kind").parquet(path)
    read = documents.sparkSession.read.schema(rows.schema).parquet(path)
    return read.where("kind = 'docs'").select(*DOCS), read.where("kind = 'links'").select("block", *LINKS)


COUNTS_SQL = "stripe int, pairs binary, counts binary"
COUNTS = {"stripe": pa.int32(), "pairs": pa.binary(), "counts": pa.binary()}


def rows_of_counts(stripe: int, pairs: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    cuts = range(0, len(pairs), ROW_PAIRS)
    cut = lambda x, t: [x[i : i + ROW_PAIRS].astype(t).tobytes() for i in cuts]
    return batch_of(COUNTS, {"stripe": [stripe] * len(cuts), "pairs": cut(pairs, "<u4"), "counts": cut(counts, "<i8")})


def pair_counts(links: DataFrame, size: int) -> DataFrame:
    """(stripe, pairs, counts) of all links: each pair in one row only."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        total = 0

        def merge() -> int:
            for stripe, parts in held.items():
                if len(parts) > 1:
                    pairs, place = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
                    counts = np.zeros(len(pairs), np.int64)
                    np.add.at(counts, place, np.concatenate([c for _, c in parts]))
                    held[stripe] = [(pairs, counts)]
            return sum(len(parts[0][0]) for parts in held.values())

        for b in bounded(batches, "pairs", 256, 8 << 20):
            for stripe, pairs, times in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                held.setdefault(stripe, []).append((np.frombuffer(pairs, "<u4"), np.frombuffer(times, "<u4").astype(np.int64)))
                total += len(pairs) // 4
                if total > HELD:
                    total = merge()
                    if total > HELD // 2:
                        for stripe, parts in held.items():
                            yield rows_of_counts(stripe, *parts[0])
                        held, total = {}, 0
        merge()
        for stripe, parts in held.items():
            yield rows_of_counts(stripe, *parts[0])

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense, now = np.zeros(0, np.int64), None
        for b in bounded(batches, "pairs", 256, 8 << 20):
            for stripe, pairs, counts in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if stripe != now:
                    if now is not None:
                        some = np.flatnonzero(dense)
                        yield rows_of_counts(now, some, dense[some])
                    dense, now = np.zeros(size, np.int64), stripe
                np.add.at(dense, np.frombuffer(pairs, "<u4"), np.frombuffer(counts, "<i8"))
        if now is not None:
            some = np.flatnonzero(dense)
            yield rows_of_counts(now, some, dense[some])

    parts = links.select("stripe", "pairs", "times").mapInArrow(summed, COUNTS_SQL)
    return written(parts.repartition("stripe").sortWithinPartitions("stripe").mapInArrow(filled, COUNTS_SQL), "pair-counts")


SUMS = {"block": pa.int64(), "docs": pa.binary(), "sums": pa.binary(), "bests": pa.binary()}
SUMS_SQL = "block long, docs binary, sums binary, bests binary"


def scored(links: DataFrame, counts: DataFrame, width: int, size: int) -> DataFrame:
    """(block, at, n_best, count_sum) of every document with links."""
    volume = links.groupBy("stripe").agg(F.sum(F.octet_length("pairs") + F.octet_length("times") + F.octet_length("docs")).alias("bytes"))
    slices = {r["stripe"]: -(-r["bytes"] // SLICE_BYTES) for r in volume.collect()}  # a row for each stripe
    several = {s: n for s, n in slices.items() if n > 1}
    number = F.lit(1)
    if several:
        number = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in several.items() for x in pair)), F.col("stripe")), F.lit(1))
    nothing = F.lit(None).cast("binary")
    own = links.select("stripe", F.pmod(F.xxhash64("block"), number).cast("int").alias("slice"), F.lit(1).alias("step"), "block", "docs", "pairs", "times", nothing.alias("counts"))
    known = counts.select("stripe", F.explode(F.sequence(F.lit(0), number.cast("int") - 1)).alias("slice"), F.lit(0).alias("step"), F.lit(None).cast("long").alias("block"), nothing.alias("docs"), "pairs", nothing.alias("times"), "counts")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense, best, now = np.zeros(0, np.int64), None, None
        for b in bounded(batches, "pairs", 256, 8 << 20):
            out: dict[str, list] = {name: [] for name in SUMS}
            for stripe, slice_, step, block, docs, pairs, times, counts_ in zip(*(b.column(i).to_pylist() for i in range(8)), strict=True):
                if (stripe, slice_) != now:
                    dense, best, now = np.zeros(size, np.int64), None, (stripe, slice_)
                at = np.frombuffer(pairs, "<u4")
                if step == 0:
                    dense[at] = np.frombuffer(counts_, "<i8")
                    continue
                if best is None:
                    best = dense.reshape(-1, width).max(axis=1)
                count, n = dense[at], np.frombuffer(times, "<u4").astype(np.int64)
                doc, place = np.unique(np.frombuffer(docs, "<u2"), return_inverse=True)
                sums, bests = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
                np.add.at(sums, place, count * n)
                np.add.at(bests, place, (count == best[at // width]) * n)
                for name, value in (("block", block), ("docs", doc.astype("<u2").tobytes()), ("sums", sums.tobytes()), ("bests", bests.tobytes())):
                    out[name].append(value)
            yield batch_of(SUMS, out)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"block": pa.int64(), "at": pa.int32(), "n_best": pa.int64(), "count_sum": pa.int64()}
        sums, bests, now = np.zeros(0, np.int64), np.zeros(0, np.int64), None

        def row() -> pa.RecordBatch:
            return batch_of(types, {"block": [now] * len(sums), "at": range(len(sums)), "n_best": bests, "count_sum": sums})

        for b in batches:
            for block, docs, s, t in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if block != now:
                    if now is not None:
                        yield row()
                    sums, bests, now = np.zeros(BLOCK_DOCS, np.int64), np.zeros(BLOCK_DOCS, np.int64), block
                at = np.frombuffer(docs, "<u2")
                np.add.at(sums, at, np.frombuffer(s, np.int64))
                np.add.at(bests, at, np.frombuffer(t, np.int64))
        if now is not None:
            yield row()

    met = known.unionByName(own).repartition("stripe", "slice").sortWithinPartitions("stripe", "slice", "step")
    sums = met.select("stripe", "slice", "step", "block", "docs", "pairs", "times", "counts").mapInArrow(score, SUMS_SQL)
    return sums.repartition("block").sortWithinPartitions("block").mapInArrow(added, "block long, at int, n_best long, count_sum long")


def alignment(documents: DataFrame, a_path: str | None = None, b_path: str | None = None, stripes: int = STRIPES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row."""
    a_path, b_path = a_path or default_paths()[0], b_path or default_paths()[1]
    docs, links = aligned(documents, a_path, b_path, stripes)
    width, height = vocabularies(a_path, b_path)
    size = -(-height // stripes) * width
    sums = scored(links, pair_counts(links, size), width, size)
    return docs.join(sums, ["block", "at"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", (F.col("n_a") + F.col("n_b") - F.col("n_groups")).alias("n_links"),
        F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256",
    )


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents"))
