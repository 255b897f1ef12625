"""BPE encoding and decoding with content-defined chunk reuse.

1. Each text is cut where a rolling hash of the last ``WINDOW`` bytes hits a fixed pattern, so equal
   passages give equal chunks wherever they stand. A document's compressed text is shuffled once;
   rows with equal id and text become one there, with their number.
2. Digests that occur more than once name the shared chunks. Each of these is encoded once, in the
   document that holds its first occurrence, and its ids go to all of its occurrences.
3. A document takes over the ids of its shared chunks between the first and the last safe cut in each
   and re-encodes what lies between, moving to the next safe cut until the token boundaries on both
   sides agree exactly. A safe cut is a single space between two visible characters, where this kind
   of vocabulary always splits. Chunks without such cuts are encoded in place.

The ids equal those of encoding the whole text. Decoding joins the tokens' bytes; broken UTF-8 becomes
U+FFFD as in the library.

Defined results: a null or empty text has no ids and decodes to the empty text; repeated rows are
encoded once and give a row each, written out in bounded batches; null doc_ids are kept; an empty table
gives no rows; extra columns are not read; a text of any length is encoded whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from extractlab.llm.common import batch_of, bounded, table
from extractlab.llm.tokens import Encoder, default_path, encoder

WINDOW = 32
#: A cut on average every so many bytes, and the shortest and longest chunk.
MEAN, LEAST, MOST = 1024, 256, 8192
#: Rows of a batch in which a repeated row's results are written out.
COPIES = 1000
STRIPE = 1 << 20
_FACTOR = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_POWER = np.cumprod(np.full(STRIPE + WINDOW, _FACTOR, np.uint64))
_INVERSE = np.cumprod(np.full(STRIPE + WINDOW, pow(_FACTOR, -1, 2**64), np.uint64))
_SAFE = re.compile(
    rb"(?:[\x21-\x7e]|[\xc3-\xdf][\x80-\xbf]|[\xe0\xe4-\xef][\x80-\xbf]{2}|[\xf0-\xf7][\x80-\xbf]{3})"
    rb"(?= [\x21-\x7e\xc3-\xe0\xe4-\xf7])"
)


def boundaries(data: bytes, mean: int = MEAN, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks of a UTF-8 text, on character boundaries; they depend on nearby bytes only."""
    n = len(data)
    if n <= 2 * least:
        return [n] if n else []
    raw = np.frombuffer(data, np.uint8)
    hits = []
    for start in range(0, n, STRIPE):
        own = raw[max(0, start - WINDOW) : start + STRIPE]
        if len(own) <= WINDOW:
            break
        total = np.cumsum(_TABLE[own] * _POWER[: len(own)])
        window = (total[WINDOW:] - total[:-WINDOW]) * _INVERSE[: len(own) - WINDOW]
        hits.append(np.flatnonzero((window >> np.uint64(40)) % np.uint64(mean - least) == 0) + max(0, start - WINDOW) + WINDOW + 1)
    ends, last = [], 0
    for hit in np.concatenate(hits).tolist() if hits else []:
        while hit - last > most:
            last = _aligned(data, last + most)
            ends.append(last)
        if hit - last >= least and n - hit >= least:
            last = _aligned(data, hit)
            ends.append(last)
    while n - last > most:
        last = _aligned(data, last + most)
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def _aligned(data: bytes, at: int) -> int:
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _first_safe(data: bytes, start: int, end: int) -> Iterator[int]:
    return (m.end() for m in _SAFE.finditer(data, start, end))


def _last_safe(data: bytes, start: int, end: int) -> Iterator[int]:
    reach, seen = 64, end
    while seen > start:
        low = max(start, end - reach)
        found = [m.end() for m in _SAFE.finditer(data, low, end) if m.end() < seen]
        yield from reversed(found)
        seen, reach = (min([seen, *found]) if low > start else start), reach * 4


def assemble(enc: Encoder, data: bytes, shared: dict[int, tuple[int, np.ndarray]]) -> np.ndarray:
    """The ids of a text, given those of some of its chunks: start to (size, ids) in bytes."""
    n, out, done = len(data), [], 0
    for at in sorted(shared):
        size, ids = shared[at]
        end = at + size
        ends_at = at + np.cumsum(enc.token_lengths[ids])

        def token(cut: int, ends_at=ends_at, at=at) -> int | None:
            """How many tokens end by this cut, if one ends just there."""
            k = int(np.searchsorted(ends_at, cut))
            return 0 if cut == at else k + 1 if k < len(ends_at) and ends_at[k] == cut else None

        left = [at] if at == 0 else _first_safe(data, at, end)
        right = [end] if end == n else _last_safe(data, at, end)
        lo = next((c for c in left if c >= done and token(c) is not None), None)
        hi = next((c for c in right if token(c) is not None), None)
        if lo is None or hi is None or lo >= hi:
            continue
        if lo > done:
            out.append(enc.encode(data[done:lo].decode()))
        out.append(ids[token(lo) : token(hi)])
        done = hi
    if done < n:
        out.append(enc.encode(data[done:].decode()))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def encode(documents: DataFrame, tokenizer: str | None = None, mean: int = MEAN) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit) and decoded text of every document."""
    return encoded_with(
        documents, {"ids": ("binary", pa.binary(), lambda enc, ids: ids.astype("<u4").tobytes()), "decoded": ("string", pa.string(), Encoder.decode)},
        tokenizer, mean,
    )


def encoded_with(documents: DataFrame, outputs: dict, tokenizer: str | None = None, mean: int = MEAN) -> DataFrame:
    """doc_id and what ``outputs`` makes of the ids: name to (SQL type, Arrow type, function of encoder and ids)."""
    path = tokenizer or default_path()
    least = mean // 4

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Equal rows have equal keys."""
        types = {"doc_id": pa.int64(), "doc_key": pa.binary(), "packed": pa.binary()}
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in bounded(batches, "text", 1000, 8 << 20):
            ids, texts = b.column(0).to_pylist(), [(t or "").encode() for t in b.column(1).to_pylist()]
            yield batch_of(types, {
                "doc_id": ids, "doc_key": [_digest(b"%r " % d + t) for d, t in zip(ids, texts, strict=True)], "packed": [pack(t) for t in texts],
            })

    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"doc_key": pa.binary(), "at": pa.int64(), "size": pa.int32(), "digest": pa.binary()}
        open_ = zstandard.ZstdDecompressor()
        for b in bounded(batches, "packed", 500, 4 << 20):
            out: dict[str, list] = {k: [] for k in types}
            for key, packed in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                data = open_.decompress(packed)
                ends = boundaries(data, mean, least)
                for s, e in zip([0, *ends], ends, strict=False):
                    for k, v in zip(types, (key, s, e - s, _digest(data[s:e])), strict=True):
                        out[k].append(v)
            yield batch_of(types, out)

    def encode_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, types = encoder(path), {"digest": pa.binary(), "ids": pa.binary()}
        open_ = zstandard.ZstdDecompressor()
        for b in bounded(batches, "packed", 500, 4 << 20):
            out: dict[str, list] = {"digest": [], "ids": []}
            for packed, own in zip(b.column(2).to_pylist(), b.column(4).to_pylist(), strict=True):
                data = open_.decompress(packed)
                for c in own:
                    ids = enc.encode(data[c["at"] : c["at"] + c["size"]].decode())
                    out["digest"].append(c["digest"])
                    out["ids"].append(ids.astype("<u2" if len(enc.token_bytes) <= 1 << 16 else "<u4").tobytes())
            yield batch_of(types, out)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        types = {"doc_id": pa.int64()} | {k: t for k, (_, t, _) in outputs.items()}
        width = "<u2" if len(enc.token_bytes) <= 1 << 16 else "<u4"
        open_ = zstandard.ZstdDecompressor()
        for b in bounded(batches, "packed", 500, 4 << 20):
            out: dict[str, list] = {k: [] for k in types}
            for doc, packed, copies, own in zip(*(b.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
                shared = {c["at"]: (c["size"], np.frombuffer(c["ids"], width).astype(np.uint32)) for c in own or []}
                ids = assemble(enc, open_.decompress(packed), shared)
                row = [doc, *(make(enc, ids) for _, _, make in outputs.values())]
                for k, v in zip(types, row, strict=True):
                    out[k].append(v)
                for at in range(1, copies, COPIES):
                    yield batch_of(types, {k: [v] * min(COPIES, copies - at) for k, v in zip(types, row, strict=True)})
            yield batch_of(types, out)

    # The one shuffle of the texts. All that follows reads it with equal columns and filters, so Spark
    # reuses the exchange.
    docs = documents.select("doc_id", "text").mapInArrow(squeeze, "doc_id bigint, doc_key binary, packed binary")
    docs = docs.where("doc_key IS NOT NULL").groupBy("doc_key").agg(
        F.first("doc_id").alias("doc_id"), F.first("packed").alias("packed"), F.count("*").alias("copies")
    )
    places = docs.mapInArrow(fingerprint, "doc_key binary, at bigint, size int, digest binary")
    repeated = (
        places.groupBy("digest")
        .agg(F.count("*").alias("n"), F.min(F.struct("doc_key", "at", "size")).alias("owner"))
        .where("n > 1")
    )
    owners = repeated.groupBy(F.col("owner.doc_key").alias("doc_key")).agg(
        F.collect_list(F.struct(F.col("owner.at").alias("at"), F.col("owner.size").alias("size"), "digest")).alias("own")
    )
    shared = docs.join(owners, "doc_key").select("doc_key", "doc_id", "packed", "copies", "own").mapInArrow(encode_shared, "digest binary, ids binary")
    reused = (
        places.join(shared, "digest")
        .groupBy("doc_key")
        .agg(F.collect_list(F.struct("at", "size", "ids")).alias("reused"))
    )
    return docs.join(reused, "doc_key", "left").select("doc_key", "doc_id", "packed", "copies", "reused").mapInArrow(
        finish, ", ".join(["doc_id bigint", *(f"{k} {sql}" for k, (sql, _, _) in outputs.items())])
    )


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    digests = {
        "n_tokens": ("bigint", pa.int64(), lambda enc, ids: len(ids)),
        "ids_sha256": ("string", pa.string(), lambda enc, ids: hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest()),
        "decoded_sha256": ("string", pa.string(), lambda enc, ids: hashlib.sha256(enc.decode(ids).encode()).hexdigest()),
    }
    return encoded_with(table(spark, sf_dir, "documents"), digests)
