"""From raw documents to packed training sequences, in five stages.

Every stage reads what its predecessor wrote. Models are trained within their stage, on the stage's own
input. All stages but the last return the columns of their input; columns that a stage does not know pass through
whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from extractlab.llm import op03_pii, op04_packing, op05_quality, op07_language, op10_minhash
from extractlab.llm.common import sheltered, table, written

#: A document goes if its language is undetermined or less certain than this; as a winner of all its pairwise
#: votes has at least 0.25, that is one whose votes run in a circle.
LEAST_CERTAINTY = 0.2
#: Near copies share at least so many hundredths of their shingles (op10_minhash alone takes 85).
NEAR = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold, a score at the threshold included. Null and empty texts
    are scored like any other; very long texts whole; repeated rows all get one decision."""
    known, back = sheltered(docs, ("doc_id", "text", "n_chars"))
    model = op05_quality.train(known, table(spark, sf_dir, "labels"))
    return back(op05_quality.score(known, model, known.columns, "other_score").where(F.col("other_score") >= op05_quality.THRESHOLD))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was recognised. Texts that are null or have no letter go; very long texts are
    read whole; of equally likely languages the first one in order counts."""
    known, back = sheltered(docs, ("doc_id", "text", "lang"))
    names = ("other_language", "other_certainty")
    found = op07_language.predict(known, op07_language.train(known), known.columns, names)
    good = (F.col(names[0]) != op07_language.UNDETERMINED) & (F.col(names[1]) >= LEAST_CERTAINTY)
    return back(found.where(good))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the smallest id, of several texts with this id the one with the
    smallest hash, of equal rows any. Only near copies go: different texts that share an id are judged each by
    itself. Rows with null ids and texts without words stay; very long texts are compared whole."""
    known, back = sheltered(docs, ("doc_id", "text"))
    found = written(op10_minhash.near_duplicates(known, NEAR, apart=True).where("n_shingles > 0 AND doc_id IS NOT NULL"), "pipeline-found")
    # Texts by group: the first one of each stays. Those that go whole, and those that stay once of several equal rows.
    texts = found.groupBy("component_id", "doc_id", "text_hash").agg(F.count("*").alias("rows"))
    row = F.struct("doc_id", "text_hash")
    first = texts.groupBy("component_id").agg(F.min(row).alias("first"), F.sum("rows").alias("n")).where("n > 1")
    told = texts.join(first, "component_id").withColumn("stays", row == F.col("first")).where("NOT stays OR rows > 1")
    told = written(told.select(F.col("doc_id").alias("told_id"), F.col("text_hash").alias("told_hash"), "stays"), "pipeline-told")
    same = (F.col("doc_id") == F.col("told_id")) & (F.xxhash64("text") == F.col("told_hash"))
    kept = known.join(told, same, "left_anti")
    # Seldom any: only their rows are grouped.
    equal = known.join(told.where("stays"), same).groupBy("told_id", "told_hash").agg(F.first(F.struct(*known.columns)).alias("kept"))
    return back(kept.unionByName(equal.select("kept.*")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; null and empty texts stay, very long ones are read whole,
    repeated rows all change alike, and of spans that overlap the first names the kind."""
    return op03_pii.redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document: null and empty texts are one end token, very long ones are cut,
    repeated rows each get their own place."""
    return op04_packing.pack(written(op04_packing.pieces(docs), "pieces"))


STAGES = [
    ("quality", quality), ("language", language), ("near_duplicates", near_duplicates),
    ("personal_data", personal_data), ("packing", packing),
]

#: SQL can express neither the trained models nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
