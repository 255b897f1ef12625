"""Document fingerprints by I-Match over randomised lexicon subsets, in DataFrame functions only.

1. Terms are lower-cased runs of letters, marks and digits, known by a 64-bit hash. Their document frequencies are
   counted over all documents; the lexicon is the band of inverse document frequencies from ``ln 2`` (a term of at
   most half of all documents) to ``ln(N / 2)`` (of two documents at least).
2. The lexicon is dealt at random into ``2**level`` subsets, by the low bits of the hashes, at every level. A text uses
   the level at which its distinct terms spread at one to two for each subset, and the level above, and only the
   first ``SUBSETS`` subsets of each: a few dozen terms, however long the text. The terms that the lexicon holds are
   sorted, and those of each subset hashed together. The fingerprint is the level and both rows of hashes.
3. Two fingerprints are as alike as the share of equal hashes among the subsets, of levels which both have, that
   hold terms of either; without a level in common they are unlike.

``next_texts`` gives each document the text after it in descending doc_id: ids are dealt out by ranges, whose
first rows are also put at the end of the range before; one shuffle of the texts and one window for each range.

Terms of more than half of all documents (fewer than twice the mean number of terms of a document) are taken out
before the join with the lexicon; the joins are plain, so that Spark broadcasts what is small and splits
what is skewed.

Defined results: a null text is empty; a text without terms in the lexicon has its own hash as fingerprint, so that
it is like equal texts only; equal texts have equal fingerprints; of rows that share an id the one with the smaller
text hash comes first, equal rows in any order; null ids come after all others; a single document is its own next;
very long texts are read whole; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from extractlab.llm.common import table, written

SUBSETS = 32
LEAST_LEVEL = 5
LEAST_DOCUMENTS, MOST_SHARE = 2, 0.5
_BETWEEN = r"[^\p{L}\p{M}\p{N}]+"
#: What xxhash64 gives for an empty array: its seed.
_NOTHING = 42


def terms(text: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(F.lower(text), _BETWEEN)), "")


def level(found: Column) -> Column:
    """The level of a text with these distinct terms: so many bits that a subset holds one or two."""
    return F.greatest(F.lit(LEAST_LEVEL), F.length(F.bin(F.greatest(F.size(found) - 1, F.lit(0)))) - 1).cast("int")


def mask(bits: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bits.cast("int")) - 1


def subset_terms(found: Column, bits: Column) -> Column:
    """Hashes of the terms in the first subsets of a level."""
    return F.filter(F.transform(found, lambda t: F.xxhash64(t)), lambda h: h.bitwiseAND(mask(bits)) < SUBSETS)


def document_frequencies(documents: DataFrame) -> DataFrame:
    """(term, df) of terms in enough documents."""
    each = documents.select(F.explode(terms(F.coalesce("text", F.lit("")))).alias("t")).select(F.xxhash64("t").alias("term"))
    return each.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= LEAST_DOCUMENTS)


def ranges(documents: DataFrame) -> tuple[list[int], list[int]]:
    """Ascending limits of ranges of doc_id, about four for each shuffle partition, and ids that fill a whole range."""
    spark = documents.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    limits = documents.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n).alias("p")).first()["p"] or []
    return sorted(set(limits)), sorted({x for x, y in zip(limits, limits[1:], strict=False) if x == y})


def _longs(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def placed(documents: DataFrame) -> DataFrame:
    """doc_id, text, and the order by (``bucket``, ``key``, ``digest``): descending ids, then nulls."""
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    limits, heavy = ranges(own)
    bucket = F.lit(0)
    if limits:
        held = _longs(limits)
        steps = [1 << b for b in reversed(range(len(limits).bit_length()))]
        upto = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda n, s: F.when(F.get(held, n + s - 1) <= F.col("doc_id"), n + s).otherwise(n))
        bucket = F.lit(len(limits)) - upto
    own = own.withColumn("digest", F.xxhash64("text"))
    # A null or very frequent id is dealt out by the hash of the text; such an id is the last one of its range.
    split = F.col("doc_id").isNull()
    if heavy:
        split = split | F.coalesce(F.array_contains(_longs(heavy), F.col("doc_id")), F.lit(False))
    whole = F.when(F.col("doc_id").isNull(), F.lit(len(limits) + 1)).otherwise(bucket).cast("long") * 512
    part = F.when(split, F.call_function("shiftright", F.col("digest"), F.lit(56)) + 129).otherwise(F.lit(0))
    return own.withColumn("bucket", whole + part).withColumn("key", F.coalesce(F.bitwise_not("doc_id"), F.lit(0)))


def next_texts(documents: DataFrame) -> DataFrame:
    """doc_id, text, ``next_text`` in descending doc_id (the first one's after the last), and the numbers ``place`` and
    ``next_place`` of both documents."""
    rows = placed(documents)
    heads = rows.groupBy("bucket").agg(F.min(F.struct("key", "digest", "doc_id")).alias("head"))  # a row for each range
    around = Window.partitionBy(F.lit(1)).orderBy(F.col("bucket").desc())
    before = F.coalesce(F.lead("bucket").over(around), F.first("bucket").over(around))
    heads = heads.select(before.alias("before"), F.col("bucket").alias("h_bucket"), F.col("head.key").alias("h_key"), F.col("head.digest").alias("h_digest"))
    same = (F.col("bucket") == F.col("h_bucket")) & (F.col("key") == F.col("h_key")) & (F.col("digest") == F.col("h_digest"))
    ends = rows.join(F.broadcast(heads), same).groupBy("before", "h_bucket").agg(F.first("text").alias("text"))
    null = lambda t: F.lit(None).cast(t)
    both = rows.select("bucket", F.lit(0).alias("end"), "key", "digest", "doc_id", "text", F.col("bucket").alias("home")).unionByName(
        ends.select(F.col("before").alias("bucket"), F.lit(1).alias("end"), F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("digest"), null("long").alias("doc_id"), "text", F.col("h_bucket").alias("home"))
    )
    order = Window.partitionBy("bucket").orderBy("end", "key", "digest")
    found = both.select(
        "end", "doc_id", "text", "bucket", F.row_number().over(order).alias("number"),
        F.lead("text").over(order).alias("next_text"), F.lead("home").over(order).alias("next_home"), F.lead("end").over(order).alias("next_end"),
    ).where("end = 0")
    number = F.when(F.col("next_end") == 1, F.lit(1)).otherwise(F.col("number") + 1)
    place = lambda b, n: F.call_function("shiftleft", b, F.lit(32)) + n
    return found.select("doc_id", "text", "next_text", place(F.col("bucket"), F.col("number")).alias("place"), place(F.col("next_home"), number).alias("next_place"))


def in_lexicon(pairs: DataFrame, frequencies: DataFrame, total: int) -> DataFrame:
    """Rows whose ``term`` is in the band."""
    frequent = frequencies.where(F.col("df") > total * MOST_SHARE).select("term")
    lexicon = frequencies.where(F.col("df") <= total * MOST_SHARE).select("term")
    return pairs.join(frequent, "term", "left_anti").join(lexicon, "term", "left_semi")


def fingerprint(held: Column, bits: Column, digest: Column) -> Column:
    """Of sorted terms: ``level|hashes|hashes``; without terms ``=`` and the text's hash."""

    def hashes(more: int) -> Column:
        each = F.transform(
            F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda j: F.xxhash64(F.filter(held, lambda t: t.bitwiseAND(mask(bits + more)) == j.cast("long")))
        )
        said = F.transform(each, lambda h: F.when(h == _NOTHING, F.lit("")).otherwise(F.lpad(F.hex(h.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")))
        return F.array_join(said, ",")

    whole = F.concat_ws("|", bits.cast("string"), hashes(0), hashes(1))
    return F.when(F.coalesce(F.size(held), F.lit(0)) > 0, whole).otherwise(F.concat(F.lit("="), F.lower(F.hex(digest))))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets of common levels with terms of either text."""
    x, y = F.split(a, r"\|"), F.split(b, r"\|")
    apart = F.get(y, F.lit(0)).try_cast("int") - F.get(x, F.lit(0)).try_cast("int")

    def part(own: Column, higher: int) -> Column:
        low, high = F.split(F.get(own, F.lit(1)), ","), F.split(F.get(own, F.lit(2)), ",")
        return F.when(apart == 0, F.concat(low, high)).when(apart == higher, high).when(apart == -higher, low)

    met = F.zip_with(part(x, 1), part(y, -1), lambda p, q: F.when((p == "") & (q == ""), 0).when(p == q, 2).otherwise(1))
    some, equal = F.size(F.filter(met, lambda v: v > 0)), F.size(F.filter(met, lambda v: v == 2))
    return F.when(a == b, F.lit(1.0)).when(met.isNotNull() & (some > 0), equal / some).otherwise(F.lit(0.0))


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints and both likenesses of every row."""
    frequencies = written(document_frequencies(documents), "imatch-frequencies")
    total = documents.count()
    pairs = next_texts(documents).withColumn("n_chars", F.length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substring("next_text", F.lit(1), third))
    read = pairs.select("doc_id", "n_chars", "place", "next_place", "text", edited.alias("edited")).select(
        "doc_id", "n_chars", "place", "next_place", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        F.xxhash64("text").alias("digest"), F.xxhash64("edited").alias("edited_digest"), terms(F.col("text")).alias("own"), terms(F.col("edited")).alias("other"),
    ).withColumns({"level": level(F.col("own")), "edited_level": level(F.col("other"))})
    read = written(
        read.withColumns({"own": subset_terms(F.col("own"), F.col("level")), "other": subset_terms(F.col("other"), F.col("edited_level"))}), "imatch-terms"
    )
    sides = F.array_contains("own", F.col("term")).cast("byte") + F.array_contains("other", F.col("term")).cast("byte") * F.lit(2).cast("byte")
    each = read.select("place", "own", "other", F.explode(F.array_union("own", "other")).alias("term")).select("place", "term", sides.cast("byte").alias("sides"))
    held = in_lexicon(each, frequencies, total).groupBy("place").agg(F.sort_array(F.collect_list(F.struct("term", "sides"))).alias("held"))
    of = lambda side: F.filter("held", lambda h: h["sides"].bitwiseAND(F.lit(side).cast("byte")) > 0)["term"]
    found = read.drop("own", "other").join(held, "place", "left").withColumns({"own": of(1), "other": of(2)})
    found = written(
        found.select(
            "doc_id", "n_chars", "place", "next_place", "edited_sha256", fingerprint(F.col("own"), F.col("level"), F.col("digest")).alias("fingerprint"),
            fingerprint(F.col("other"), F.col("edited_level"), F.col("edited_digest")).alias("edited_fingerprint"),
        ),
        "imatch-fingerprints",
    )
    after = found.select(F.col("place").alias("next_place"), F.col("fingerprint").alias("next_fingerprint"))
    near = lambda other: likeness(F.col("fingerprint"), F.col(other))
    return found.join(after, "next_place", "left").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("edited_fingerprint").alias("near_edited"), near("next_fingerprint").alias("near_next")
    )


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
