"""Token-ID files: concatenated id arrays with Elias-Fano document boundaries.

``write_token_files`` range-partitions documents by id, encodes them and writes one file for each
bounded run of documents; ``read_token_files`` reads such files back. Each document's ids end with
``END_ID``.

File layout (little-endian): a fixed header, the document ids and the end offsets of the documents
as two Elias-Fano sequences, then the ids as uint16 where the vocabulary allows it, else uint32.
An Elias-Fano sequence of ``n`` ascending values below ``u`` keeps the low ``log2(u/n)`` bits of each
value packed, the high bits in unary, and the bit position of every 64th one as a select directory,
so ``select(i)`` reads one directory entry and a short stretch of the bit vector.

Defined results: a null text is an empty document (its end id only); null doc_ids come first;
repeated doc_ids keep all their rows, ordered by text hash (equal rows are alike); a very long text is one
document of one file; an empty table writes no file and reads
as no rows; extra columns are not read.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from extractlab.llm.common import batch_of, bounded, scratch_dir, table, written
from extractlab.llm.tokens import default_path, encoder

END_ID = 0
MAGIC = b"XLTOKEN1"
SAMPLE = 64
#: Values whose low bits are unpacked at once; a multiple of eight.
SLICE = 1 << 16
_HEAD = struct.Struct("<8sQQQQqBxxxxxxx")
_SEQ = struct.Struct("<QQBxxxxxxxQQ")


class EliasFano:
    """A non-decreasing sequence of non-negative integers in near-minimal space."""

    def __init__(self, n: int, universe: int, low_bits: int, low: np.ndarray, high: np.ndarray, directory: np.ndarray):
        self.n, self.universe, self.low_bits = n, universe, low_bits
        self.low, self.high, self.directory = low, high, directory

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n, universe = len(values), int(values[-1]) + 1 if len(values) else 0
        bits = max(0, (universe // n).bit_length() - 1) if n else 0
        low = values & np.uint64((1 << bits) - 1)
        packed = np.packbits(np.concatenate([  # slices of whole bytes bound what is unpacked at once
            ((low[s : s + SLICE, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).reshape(-1)
            for s in range(0, max(1, n), SLICE)
        ]), bitorder="little")
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, universe, bits, packed, np.packbits(high, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        at = i * self.low_bits
        for k in range(self.low_bits):
            out |= ((self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.int64) << k
            at = at + 1
        return out

    def select(self, i: int) -> int:
        """The i-th value, through the directory."""
        start = int(self.directory[i // SAMPLE])
        left, byte = i % SAMPLE, start >> 3
        word = int(self.high[byte]) >> (start & 7) << (start & 7)
        while (count := word.bit_count()) <= left:
            left, byte = left - count, byte + 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        position = byte * 8 + (word & -word).bit_length() - 1
        return ((position - i) << self.low_bits) | int(self._low(np.array([i]))[0])

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        index = np.arange(self.n)
        return ((ones - index) << self.low_bits) | self._low(index)

    def to_bytes(self) -> bytes:
        head = _SEQ.pack(self.n, self.universe, self.low_bits, len(self.low), len(self.high))
        return head + self.low.tobytes() + self.high.tobytes() + self.directory.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, at: int = 0) -> tuple[EliasFano, int]:
        """The sequence that begins at ``at``, and where it ends."""
        n, universe, bits, nl, nh = _SEQ.unpack_from(data, at)
        at += _SEQ.size
        low = np.frombuffer(data, np.uint8, nl, at)
        high = np.frombuffer(data, np.uint8, nh, at + nl)
        entries = -(-n // SAMPLE)
        directory = np.frombuffer(data, "<u4", entries, at + nl + nh)
        return cls(n, universe, bits, low, high, directory), at + nl + nh + 4 * entries


def file_bytes(doc_ids: list[int | None], ids: list[np.ndarray], wide: bool) -> bytes:
    """One file. ``doc_ids`` ascend, nulls first."""
    nulls = sum(d is None for d in doc_ids)
    known = np.array(doc_ids[nulls:], dtype=np.int64)
    base = int(known[0]) if len(known) else 0
    docs = EliasFano.build((known - base).astype(np.uint64)).to_bytes()
    ends = EliasFano.build(np.cumsum([len(x) for x in ids], dtype=np.uint64)).to_bytes()
    body = np.concatenate(ids).astype("<u4" if wide else "<u2").tobytes()
    return _HEAD.pack(MAGIC, len(doc_ids), nulls, len(docs), len(ends), base, 4 if wide else 2) + docs + ends + body


class TokenFile:
    """A file that has been read: document i's ids are ``ids[bounds(i)]``."""

    def __init__(self, data: bytes):
        magic, self.n, self.nulls, nd, ne, self.base, width = _HEAD.unpack_from(data, 0)
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.docs, _ = EliasFano.from_bytes(data, _HEAD.size)
        self.ends, at = EliasFano.from_bytes(data, _HEAD.size + nd)
        if at != _HEAD.size + nd + ne:
            raise ValueError("a token file's sections do not add up")
        self.ids = np.frombuffer(data, f"<u{width}", offset=at)

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + (self.docs.values() + self.base).tolist()

    def bounds(self, i: int) -> slice:
        return slice(self.ends.select(i - 1) if i else 0, self.ends.select(i))


def _filesystem(path: str):
    from pyarrow import fs

    path = re.sub("^s3[an]://", "s3://", path)  # Hadoop's names for one store
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _put(path: str, data: bytes) -> None:
    """Write whole or not at all: a task that runs twice replaces a file by an equal one."""
    files, place = _filesystem(path)
    draft = f"{place}.{uuid.uuid4().hex}.draft"
    with files.open_output_stream(draft) as f:
        f.write(data)
    files.move(draft, place)


def _get(path: str) -> bytes:
    files, place = _filesystem(path)
    with files.open_input_file(place) as f:
        return f.read()


MANIFEST = {
    "task": pa.int32(), "part": pa.int32(), "path": pa.string(), "n_docs": pa.int64(), "n_ids": pa.int64(),
}


def write_token_files(documents: DataFrame, folder: str, tokenizer: str | None = None, file_ids: int = 1 << 24, file_docs: int = 1 << 20) -> DataFrame:
    """Writes the files and returns their manifest with ``start``, the ids before each file.

    ``file_ids`` bounds the ids of a file (beyond its last document), ``file_docs`` its documents, and both
    together a task's memory.
    """
    path = tokenizer or default_path()
    spark = documents.sparkSession
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(place)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(path), TaskContext.get().partitionId()
        wide = len(enc.token_bytes) > 1 << 16
        docs, ids, total, part = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            name = f"{folder}/ids-{task:06d}-{part:05d}.xlt"
            _put(name, file_bytes(docs, ids, wide))
            return batch_of(MANIFEST, {"task": [task], "part": [part], "path": [name], "n_docs": [len(docs)], "n_ids": [total]})

        for b in bounded(batches, "text", 1000, 8 << 20):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = np.append(enc.encode(text or ""), np.uint32(END_ID))
                docs.append(doc)
                ids.append(own if wide else own.astype(np.uint16))
                total += len(own)
                if total >= file_ids or len(docs) >= file_docs:
                    yield flush()
                    docs, ids, total, part = [], [], 0, part + 1
        if docs:
            yield flush()

    files = (
        documents.select("doc_id", "text")
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .mapInArrow(write, "task int, part int, path string, n_docs bigint, n_ids bigint")
    )
    # One row for each file, so this order is over metadata, not over documents.
    before = Window.orderBy("task", "part").rowsBetween(Window.unboundedPreceding, -1)
    return written(written(files, "token-manifest").withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """A row for each document: doc_id, start, n_tokens and ids_crc32, from the files alone."""
    types = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start, n_docs in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                f = TokenFile(_get(path))
                if f.n != n_docs:
                    raise ValueError(f"{os.path.basename(path)} holds {f.n} documents, its manifest says {n_docs}")
                ends = f.ends.values()
                starts = np.concatenate(([0], ends[:-1]))
                crc = [zlib.crc32(f.ids[s:e].astype("<u4").tobytes()) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield batch_of(types, {"doc_id": f.doc_ids(), "start": starts + start, "n_tokens": ends - starts, "ids_crc32": crc})

    return (
        files.select("path", "start", "n_docs").repartition("path")
        .mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    )


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{scratch_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), folder))
