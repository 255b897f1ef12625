"""What the ten operators share: table readers, scratch tables and Arrow batch mapping.

Scratch tables live in the folder the cluster names in ``spark.checkpoint.dir``; a private folder is
made only where that setting is absent and Spark runs in one local process, as in tests. Models are
fitted in one task on a bounded sample, so that neither the sample nor its features pass the driver.
"""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables and files."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="extractlab-scratch-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the scratch folder and read it back: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_arrow(
    df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    return df.mapInArrow(fn, schema)


def fitted(sample: DataFrame, fit: Callable[[list[pa.RecordBatch]], object]):
    """What ``fit`` makes of a bounded sample, in one task; only the result comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(list(batches)))], pa.binary())], names=["model"])

    return pickle.loads(sample.repartition(1).mapInArrow(run, "model binary").first()[0])


def batch_of(types: dict[str, pa.DataType], columns: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[k], type=t) for k, t in types.items()], names=list(types)
    )


def bounded(batches: Iterator[pa.RecordBatch], column: str, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``rows`` rows and, beyond a single row, ``size`` bytes
    of ``column``: bounds what a worker holds as Python objects."""
    for b in batches:
        i = b.schema.get_field_index(column)
        lengths = pc.binary_length(b.column(i)).fill_null(0).to_pylist()
        start = total = 0
        for k, n in enumerate(lengths):
            if k > start and (k - start >= rows or total + n > size):
                yield b.slice(start, k - start)
                start, total = k, 0
            total += n
        if start < len(lengths):
            yield b.slice(start)


def reading(documents: DataFrame, keep: list[str]) -> tuple[DataFrame, str, int]:
    """The columns ``keep`` and the text, once; the text's name and its place."""
    if "text" in keep:
        return documents.select(*keep), "text", keep.index("text")
    return documents.select(*keep, "text"), "text", len(keep)


def sheltered(frame: DataFrame, own: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The frame with all columns but ``own`` under private names, so that a step's own columns can't meet them, and
    what gives a frame with these columns their names and order back."""
    names = [c if c in own else f"other{i}" for i, c in enumerate(frame.columns)]
    quoted = [f"`{n}`" for n in names]

    def back(found: DataFrame) -> DataFrame:
        return found.select(*(F.col(n).alias(c) for n, c in zip(quoted, frame.columns, strict=True)))

    return frame.toDF(*names), back


def fold(df: DataFrame, key: str, modulus: int) -> DataFrame:
    """Column ``fold``: crc32 of the key as text, modulo ``modulus``."""
    return df.withColumn("fold", F.crc32(F.col(key).cast("string").cast("binary")) % modulus)


def labelled_sample(labels: DataFrame, column: str, modulus: int, held_out: int, rows: int) -> DataFrame:
    """At most ``rows`` labelled (doc_id, label) outside the held-out fold, in the order of a hash of the
    id. Repeated ids take their largest label; null ids and labels are left out."""
    usable = fold(labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()), "doc_id", modulus)
    return (
        usable.where(F.col("fold") != held_out)
        .groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
