"""The profile store as joins: owner scope, compare-and-swap, all-or-none saving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def owned(profiles: DataFrame, owner: int) -> DataFrame:
    return profiles.where(F.col("owner") == owner).orderBy("created", "id")


def outcomes(profiles: DataFrame, requests: DataFrame) -> DataFrame:
    """What each (id, owner, expected) request comes to; another owner's row is as good as none."""
    rows = requests.join(profiles.select("id", "owner", "version"), ["id", "owner"], "left")
    result = F.when(F.col("version").isNull(), "not_found").when(F.col("version") == F.col("expected"), "applied").otherwise("conflict")
    return rows.select("id", "owner", "expected", result.alias("result"))


def updated(profiles: DataFrame, requests: DataFrame) -> DataFrame:
    """The table after all requests that apply: their versions are one higher."""
    hits = requests.select("id", "owner", F.col("expected").alias("version")).distinct().withColumn("_hit", F.lit(1))
    rows = profiles.join(hits, ["id", "owner", "version"], "left")
    return rows.withColumn("version", F.col("version") + F.coalesce("_hit", F.lit(0))).select(profiles.columns)


def deleted(profiles: DataFrame, requests: DataFrame) -> DataFrame:
    hits = requests.select("id", "owner", F.col("expected").alias("version"))
    return profiles.join(hits, ["id", "owner", "version"], "left_anti")


def saved(profiles: DataFrame, drafts: DataFrame) -> DataFrame:
    """By batch: inserted if none of its ids exists, unchanged if all exist and are equal, else conflict."""
    there = profiles.select("id", F.col("name").alias("_name"), F.col("owner").alias("_owner"))
    rows = drafts.join(there, "id", "left")
    exists = F.col("_name").isNotNull()
    equal = exists & (F.col("name") == F.col("_name")) & (F.col("owner") == F.col("_owner"))
    out = rows.groupBy("batch").agg(F.bool_or(exists).alias("any"), F.bool_and(F.coalesce(equal, F.lit(False))).alias("same"), F.count("*").alias("drafts"))
    return out.select("batch", F.when(~F.col("any"), "inserted").when(F.col("same"), "unchanged").otherwise("conflict").alias("result"), "drafts")
