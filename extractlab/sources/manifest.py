"""Corpus manifests as sources: strict JSON of a declared schema, held against the files it names."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from extractlab.functions.scalar import safe_path
from extractlab.functions.strict import strict_json

#: A case of a manifest, as far as its files go.
MANIFEST = """schema_version int, split string, cases array<struct<case_id: string, delivery_path: string, input_artifact_ids: array<string>,
    artifacts: array<struct<id: string, path: string, sha256: string, kind: string>>>>"""


class ManifestError(ValueError):
    """A manifest that can't be used; the text is a fixed code."""


def read_manifest(spark: SparkSession, path: str, schema: str = MANIFEST) -> DataFrame:
    """(manifest, and the schema's columns) of each file at ``path``. A file that is not strict JSON, or has
    a value of another type, raises ``invalid_manifest``. Manifests are small; the corpora behind them are not."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("manifest"), "value")
    read = files.select("manifest", strict_json(F.col("value"))["problem"].alias("_problem"), "value")
    wrong = F.raise_error(F.lit("invalid_manifest"))
    checked = F.when(F.col("_problem").isNull(), F.from_json("value", schema, {"mode": "FAILFAST"})).otherwise(wrong.cast(f"struct<{_fields(schema)}>"))
    return read.select("manifest", checked.alias("m")).select("manifest", "m.*")


def _fields(ddl: str) -> str:
    """A DDL's columns as the fields of a struct."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).simpleString()[len("struct<"):-1]


def artifacts(manifests: DataFrame) -> DataFrame:
    """A row for each artifact of each case; ``is_input`` says whether the case reads it."""
    cases = manifests.select("manifest", F.explode("cases").alias("c"))
    each = cases.select("manifest", "c.case_id", "c.delivery_path", F.col("c.input_artifact_ids").alias("_inputs"), F.explode("c.artifacts").alias("a"))
    return each.select("manifest", "case_id", "delivery_path", "a.*", F.array_contains("_inputs", F.col("a.id")).alias("is_input"))


def unknown_inputs(manifests: DataFrame) -> DataFrame:
    """(manifest, case_id, id) of inputs that no artifact of their case has."""
    cases = manifests.select("manifest", F.explode("cases").alias("c"))
    return cases.select("manifest", "c.case_id", F.explode(F.array_except("c.input_artifact_ids", F.col("c.artifacts.id"))).alias("id"))


def file_digests(spark: SparkSession, root: str) -> DataFrame:
    """(path under the root, sha256) of every file below it; contents are hashed where they are read and not shuffled."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    scheme = "^[A-Za-z][A-Za-z0-9+.-]*:/*"
    above = len(re.sub(scheme, "/", root).rstrip("/")) + 1
    return found.select(F.substring(F.regexp_replace("path", scheme, "/"), above + 1, 1 << 30).alias("path"), F.sha2("content", 256).alias("found_sha256"))


def file_problems(artifacts: DataFrame, digests: DataFrame) -> DataFrame:
    """Artifacts whose file is outside the root, absent or different, or that are an input of another kind than their case's."""
    met = artifacts.join(digests, "path", "left")
    problem = (
        F.when(~F.coalesce(safe_path(F.col("path")), F.lit(False)), "unsafe_artifact_path").when(F.col("found_sha256").isNull(), "artifact_missing")
        .when(~F.col("found_sha256").eqNullSafe(F.col("sha256")), "artifact_hash_mismatch").when(F.col("is_input") & (F.col("kind") != F.col("delivery_path")), "primary_delivery_kind_mismatch")
    )
    return met.withColumn("problem", problem).where("problem IS NOT NULL").select("manifest", "case_id", "id", "path", "problem")
