"""Typed JSON files as sources: frozen configurations and review decisions; and what is written once or only appended to.

Files are read by Spark, from any store that it reads, whole and where they lie; a shape (see
:mod:`extractlab.functions.shapes`) is held against each, and what does not fit has a fixed code. A table is written by
``write_new`` to a name that nobody has seen, read again, and only then given its own name, which must be free: a reader
sees all of it or nothing, and a failed write leaves nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from extractlab.functions.canonical import canonical_json
from extractlab.functions.shapes import Each, Flag, Like, Object, OneOf, Real, Text, Whole, entries, is_, items, text

_SHA256 = Like("[0-9a-f]{64}")
_MOMENT = Like(r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{1,6})?(?:Z|[+-][0-9]{2}:[0-9]{2})")
_UTC = Like(r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{1,6})?(?:Z|\+00:00)")
_COUNT = Whole(-(1 << 62))


def _one(own: Column, *names: str) -> Column:
    return is_(F.forall(F.array(*(F.try_variant_get(F.try_element_at(own, F.lit(n)), "$", "bigint") for n in names)), lambda x: x == 1))


def _kinds_once(own: Column) -> Column:
    kinds = F.transform(items(F.try_element_at(own, F.lit("page_times"))), lambda x: text(F.try_element_at(entries(x), F.lit("kind"))))
    return F.coalesce(F.size(F.array_distinct(kinds)) == F.size(kinds), F.lit(True))


#: Names and types of a frozen configuration.
FROZEN = Object(
    {
        "schema_version": Whole(1), "created_at": _UTC, "corpus_manifest_schema_version": Whole(1), "code_sha256": _SHA256,
        "runtime_artifacts": Object({"llama_cpp_build": OneOf(("b11221",)), "executable_sha256": _SHA256, "model_sha256": _SHA256, "projector_sha256": _SHA256}),
        "runtime_profile": Object({
            "context_tokens": _COUNT, "image_min_tokens": _COUNT, "image_max_tokens": _COUNT, "output_tokens": _COUNT, "pdf_dpi": _COUNT, "alternative_pdf_dpi": _COUNT, "vision_gpu": Flag(), "cache_type": Text(),
        }),
        "core": Object({
            "processing_budget_s": Real(), "image_long_side": _COUNT, "matching_long_side": _COUNT, "call_timeout_s": Real(), "release_timeout_s": Real(), "maximum_response_bytes": _COUNT,
            "top_logprobs": _COUNT, "max_pixels": _COUNT, "quota_bytes": _COUNT, "free_reserve_bytes": _COUNT,
        }),
        "prompt": Object({"version": Text(1), "sha256": _SHA256}),
        "policy": Object({"min_token_probability": Real(0, 1, null=True), "check_alternate_view": Flag(), "check_declared_format": Flag(), "matching_margin": Real(0, 1)}),
        "calibration": Object({"tuning_manifest_sha256": _SHA256, "calibration_report_sha256": _SHA256, "point_index": Whole(0), "selection_rule": Text(1)}),
        "dependencies": Object({n: Text() for n in ("python", "httpx", "pillow", "pypdfium2", "pydantic", "pydantic_core")}),
        "page_times": Each(Object({"kind": OneOf(("png", "jpeg", "pdf")), "count": Whole(1), "p5": Real(0), "p50": Real(0), "p95": Real(0)})),
    },
    ("page_times",), lambda own: _one(own, "schema_version", "corpus_manifest_schema_version") & _kinds_once(own),
)


def _cell_identity(own: Column) -> Column:
    said = lambda name: text(F.try_element_at(own, F.lit(name))).isNull()
    return said("row_key") == said("column_id")


#: Names and types of the decisions that a review gives.
DECISIONS = Object(
    {
        "schema_version": Whole(1), "manifest_sha256": _SHA256, "reviewer": Text(), "reviewer_attests_human_inspection": Flag(), "reviewed_at": _MOMENT,
        "cases": Each(Object(
            {
                "case_id": Text(1), "decision": OneOf(("verified", "rejected")), "method": OneOf(("script_reading", "glyph_sequence_comparison", "published_transcription"), null=True), "notes": Text(),
                "values": Each(Object(
                    {"field_id": Text(1), "row_key": Text(null=True), "column_id": Text(null=True), "visibility": OneOf(("legible", "not_legible"))}, ("row_key", "column_id"), _cell_identity
                )),
            },
            ("method", "values", "notes"),
        )),
    },
    (), lambda own: _one(own, "schema_version"),
)
#: The codes of what can't be used.
INVALID_FROZEN, INVALID_DECISIONS, INVALID_LEDGER = "invalid_frozen_configuration", "review_decisions_invalid", "benchmark_ledger_invalid"
LEDGER_EVENTS = ("started", "completed", "acknowledged")


class SourceError(ValueError):
    """What could not be read; the text is a fixed code."""


class SinkError(ValueError):
    """What could not be written; the text is a fixed code."""


def typed(contents: DataFrame, column: str, shape: Object, canonical: bool = False) -> DataFrame:
    """The rows with ``value`` (a VARIANT, null unless it fits) and ``problem``: why the text in ``column`` is none of this shape. A
    canonical one must be spelled in canonical bytes too: a copy that was edited or written anew is refused."""
    read = contents.withColumn("_c", canonical_json(F.col(column))).withColumn("_v", F.try_parse_json(F.col("_c.text")))
    value = F.col("_v")
    problem = F.when(F.col("_c.problem").isNotNull(), F.col("_c.problem")).when(~shape.fits(value), "other_shape")
    if canonical:
        problem = F.coalesce(problem, F.when(F.col(column) != F.col("_c.text"), "not_canonical"))
    out = read.withColumn("problem", problem)
    return out.withColumn("value", F.when(F.col("problem").isNull(), value)).drop("_c", "_v")


def read_typed(spark: SparkSession, path: str, shape: Object, code: str, canonical: bool = False) -> DataFrame:
    """(file, text, value) of every file at ``path``; reading raises ``code`` with the problem of one that can't be used. A text that
    isn't UTF-8 is one too, and so is an empty file, which Spark's reader would pass over."""
    place, store = _file_system(spark, path)
    found = [x for s in (store.globStatus(place) or []) for x in (store.listStatus(s.getPath()) if s.isDirectory() else [s])]
    if any(x.isFile() and not x.getLen() for x in found):
        raise SourceError(f"{code}: no_text")
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.try_validate_utf8(F.col("content").cast("string")).alias("text"))
    found = typed(files, "text", shape, canonical)
    wrong = F.raise_error(F.concat(F.lit(f"{code}: "), F.col("problem")))
    return found.select("file", "text", F.when(F.col("problem").isNull(), F.col("value")).otherwise(wrong.cast("variant")).alias("value"))


def read_frozen(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256, value) of frozen configurations in their canonical form; the digest is the file's own."""
    return read_typed(spark, path, FROZEN, INVALID_FROZEN, canonical=True).select("file", F.sha2("text", 256).alias("sha256"), "value")


def decided_values(decisions: DataFrame) -> DataFrame:
    """(case_id, decision, method, field_id, row_key, column_id, visibility) of decisions (value, null if it doesn't fit: no rows), a row for
    each value; a case without values has one row of nulls. The filter stands behind explode_outer, so that no value is read twice."""
    at = lambda m, name: text(F.try_element_at(m, F.lit(name)))
    cases = decisions.select(F.explode_outer(items(F.try_element_at(entries(F.col("value")), F.lit("cases")))).alias("c")).where("c IS NOT NULL").select(entries(F.col("c")).alias("m"))
    c = F.col("m")
    rows = cases.select(
        at(c, "case_id").alias("case_id"), at(c, "decision").alias("decision"), at(c, "method").alias("method"), F.explode_outer(items(F.try_element_at(c, F.lit("values")))).alias("v")
    ).withColumn("v", entries(F.col("v")))
    return rows.select("case_id", "decision", "method", *(at(F.col("v"), n).alias(n) for n in ("field_id", "row_key", "column_id", "visibility")))


def behavior_sha256(frozen: Column) -> Column:
    """What a run measures, of a configuration's text: its environment and policy, not when and from what it was frozen."""
    environment = ["code_sha256", "prompt", "runtime_artifacts", "runtime_profile", "core", "dependencies"]
    return F.sha2(canonical_json(frozen, {"environment": environment, "policy": "policy"})["text"], 256)


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _sums(df: DataFrame) -> tuple:
    """The number of rows and the sum of their hashes, in any order."""
    each = F.xxhash64(*(F.col(f"`{c}`").cast("string") for c in df.columns))
    return tuple(df.select(F.count("*"), F.sum(each.cast("decimal(38,0)"))).first())


def write_new(df: DataFrame, path: str, format_: str = "parquet") -> DataFrame:
    """Write a table to a name that must be free, verified: its rows are read again before the name is given to it. Raises
    ``output_exists``, or ``output_differs`` if other rows came back (the input isn't deterministic, or the store lost some)."""
    spark = df.sparkSession
    place, files = _file_system(spark, path)
    if files.exists(place):
        raise SinkError("output_exists")
    partial, _ = _file_system(spark, f"{path.rstrip('/')}.partial-{uuid.uuid4().hex}")
    try:
        df.write.mode("errorifexists").format(format_).save(partial.toString())
        again = spark.read.format(format_).schema(df.schema).load(partial.toString())
        if _sums(again) != _sums(df):
            raise SinkError("output_differs")
        # A rename onto a folder would move the table into it, so the name is asked for again.
        if files.exists(place) or not files.rename(partial, place):
            raise SinkError("output_exists")
    finally:
        files.delete(partial, True)
    return spark.read.format(format_).schema(df.schema).load(path)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The entries of an append-only ledger of JSON lines (value and event); one unknown or broken entry makes all of it invalid. A ledger
    that isn't there is empty."""
    place, files = _file_system(spark, path)
    if not files.exists(place):
        return spark.createDataFrame([], "value variant, event string")
    lines = spark.read.option("recursiveFileLookup", "true").text(path).where(F.trim("value") != "")
    value = F.try_parse_json("value")
    event = text(F.try_element_at(entries(value), F.lit("event")))
    wrong = F.raise_error(F.lit(INVALID_LEDGER))
    return lines.select(F.when(is_(event.isin(*LEDGER_EVENTS)), value).otherwise(wrong.cast("variant")).alias("value"), event.alias("event"))


def appended(path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: entries (any columns) go as JSON lines to a folder of their batch. A batch that is tried again after a
    failure replaces its own folder and no other, so every entry is there once."""

    def write(batch: DataFrame, number: int) -> None:
        lines = batch.select(F.to_json(F.struct(*sorted(batch.columns))).alias("value"))
        lines.write.mode("overwrite").text(f"{path.rstrip('/')}/batch-{number}")

    return write
