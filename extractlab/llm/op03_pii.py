"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

1. One scan of the texts finds, for each kind, the matches of its pattern with the words around them,
   and identifier-like strings that no kind's pattern accepts (candidates).
2. Accepted matches are the seed entities. The words around them induce lexical patterns; a pattern and
   the entities seen in it are the nodes of a bipartite graph, one edge for each distinct pair.
3. Round by round a pattern's confidence is the mean score of its instances, and a candidate's score the
   noisy-or of its reliable patterns. Candidates that reach the threshold join the entities, so their
   own patterns count in the next round. Scores only grow; the rounds end when none does any more.

A context is whole words, however long, up to the match before the previous one of the same pattern; an
earlier match in it stands as its kind. Candidates are digit runs (7 to 15 digits as phone, 16 to 19 as
card) and address-like strings: contexts of IP addresses are scored too, but propose nothing.

The regular expressions are the kinds' definitions with possessive repeats and look-behinds that keep
Java's matcher linear and iterative on long runs; they accept the same spans. Positions are code
points. A document's matches are numbered and summed in windows over its own rows.

Defined results: a null or empty text has no spans; repeated rows each get their own result; of a base
span and a candidate that touch, the base span stays; of discovered spans that overlap, the one that starts
(then ends) first; a very long text is read whole in one pass for each pattern; null
doc_ids are kept; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from extractlab.llm.common import sheltered, table, written

KINDS = ("email", "ip", "card", "phone")
#: The kinds' base patterns, then the looser ones whose matches are candidates.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "number": r"(?<![0-9A-Za-z+.])[0-9](?:[\x20().-]{0,2}+[0-9])++",
    "address": r"(?<!\S)[^\s@\[(]++(?:@|\[at\]|\(at\))[^\s@]++",
}
#: A cheap condition that every match implies.
NEEDS = {
    "email": lambda t: t.contains("@"),
    "address": lambda t: t.contains("@") | t.contains("[at]") | t.contains("(at)"),
    "phone": lambda t: t.contains("+"),
}
MIN_SUPPORT = 3
CONFIDENCE = 0.8
#: Scores that grow by less than this in sum count as unchanged.
SETTLED = 1e-6

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def accepted(kind: Column, value: Column) -> Column:
    """Whether a match of a kind's pattern counts."""
    n = F.length(digits(value))
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
        .when(kind == "card", n.between(16, 19) & F.call_function("luhn_check", F.when(n.between(16, 19), digits(value)).otherwise("1")))
        .when(kind == "phone", n.between(8, 15))
        .otherwise(False)
    )


def matches(text: Column, name: str) -> Column:
    """array<struct<gap, value, before, after>>: a pattern's leftmost non-overlapping matches, each with
    the length of the text since the one before and the words around it."""
    pattern = PATTERNS[name]
    # Up to three whole words at either end of what lies between; those at the end are read backwards.
    pieces = F.transform(
        F.split(text, pattern, -1),
        lambda p: F.struct(
            F.length(p).alias("size"), F.reverse(F.regexp_extract(F.reverse(p), r"^\s*+(\S++(?:\s++\S++){0,2}+)", 1)).alias("tail"),
            F.regexp_extract(p, r"^\s*+(\S++)", 1).alias("head"),
        ),
    )
    between = F.transform(
        pieces,
        lambda p, i: F.struct(
            p["size"].alias("size"), p["head"].alias("head"),
            F.when(i > 0, F.concat_ws(" ", F.get(pieces, i - 1)["tail"], F.lit(f"<{name}>"), p["tail"])).otherwise(p["tail"]).alias("tail"),
        ),
    )
    pairs = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"),
        between.alias("left"),
        F.slice(between, F.lit(2), F.greatest(F.size(between) - 1, F.lit(0))).alias("right"),
    )
    needs = NEEDS[name](text) & text.rlike(pattern) if name in NEEDS else text.rlike(pattern)
    return F.when(
        needs,
        F.transform(
            F.filter(pairs, lambda z: z["value"].isNotNull()),
            lambda z: F.struct(
                F.lit(name).alias("pattern"), z["left"]["size"].alias("gap"), z["value"].alias("value"),
                z["left"]["tail"].alias("before"), z["right"]["head"].alias("after"),
            ),
        ),
    )


def scan(documents: DataFrame) -> DataFrame:
    """One row for each document: row_id, doc_id, text_hash and all its matches. Must be written before use, as
    row ids are given by partition."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = F.flatten(F.array_compact(F.array(*(matches(text, k) for k in PATTERNS))))
    return documents.select(
        F.monotonically_increasing_id().alias("row_id"), "doc_id", F.xxhash64("text").alias("text_hash"), found.alias("found")
    )


def spans(scanned: DataFrame) -> DataFrame:
    """Base spans and candidates that touch none: row_id, kind, start, end, value, seed, before, after."""
    within = Window.partitionBy("row_id", "pattern").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = scanned.select("row_id", F.posexplode("found").alias("pos", "m")).select("row_id", "pos", "m.*")
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.length("value")).over(within)).withColumn(
        "start", F.col("end") - F.length("value")
    )
    n = F.length(digits(F.col("value")))
    kind = (
        F.when(F.col("pattern").isin(*KINDS), F.col("pattern"))
        .when(F.col("pattern") == "address", "email")
        .when(n.between(7, 15), "phone")
        .when(n.between(16, 19), "card")
    )
    named = placed.withColumn("kind", kind).withColumn("seed", accepted(F.col("pattern"), F.col("value")))
    kept = named.where(F.col("kind").isNotNull() & (F.col("seed") | ~F.col("pattern").isin(*KINDS)))
    order = Window.partitionBy("row_id").orderBy("start", F.col("seed").desc())
    reach = F.max(F.when(F.col("seed"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    # From the end backwards: a frame that runs to the last row would cost the square of the rows.
    back = Window.partitionBy("row_id").orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, 0)
    ahead = F.min(F.when(F.col("seed"), F.col("start"))).over(back)
    clear = (F.coalesce(reach, F.lit(0)) <= F.col("start")) & (F.coalesce(ahead, F.col("end")) >= F.col("end"))
    return kept.withColumn("clear", clear).where("seed OR clear").select(
        "row_id", "kind", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "value", "seed", "before", "after"
    )


def contexts() -> Column:
    """Lexical patterns of a span: the three or two words before it, and the words on both sides."""
    words = F.regexp_extract_all(F.lower("before"), F.lit(r"\S+"), F.lit(0))
    n = F.size(words)
    right = F.regexp_extract(F.lower("after"), r"^\s*(\S+)", 1)
    last = F.when(n >= 1, F.element_at(words, -1))
    return F.array_compact(
        F.array(
            F.when(n >= 3, F.concat(F.lit("LLL "), F.concat_ws(" ", F.slice(words, -3, 3)))),
            F.when(n >= 2, F.concat(F.lit("LL "), F.concat_ws(" ", F.slice(words, -2, 2)))),
            F.when((n >= 1) & (right != ""), F.concat(F.lit("LR "), last, F.lit(" "), right)),
        )
    )


def bootstrap(found: DataFrame, confidence: float = CONFIDENCE, support: int = MIN_SUPPORT) -> DataFrame:
    """(kind, value) of the candidates that reliable patterns discover. ``found`` must be a written table."""
    edges = written(
        found.select("kind", "value", "seed", F.explode(contexts()).alias("context"))
        .groupBy("kind", "context", "value").agg(F.max("seed").alias("seed")),
        "pii-edges",
    )
    scores = edges.where("NOT seed").select("kind", "value").distinct().withColumn("score", F.lit(0.0))
    before = (0, 0.0)
    while True:
        scored = edges.join(scores, ["kind", "value"], "left").withColumn(
            "score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("score", F.lit(0.0)))
        )
        reliable = (
            scored.groupBy("kind", "context")
            .agg(F.avg("score").alias("confidence"), F.sum(F.when(F.col("score") >= confidence, 1).otherwise(0)).alias("known"))
            .where((F.col("known") >= support) & (F.col("confidence") >= confidence))
        )
        doubt = F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9))))
        scores = written(
            edges.where("NOT seed").join(reliable, ["kind", "context"])
            .groupBy("kind", "value").agg((1 - F.exp(doubt)).alias("score"))
            .where(F.col("score") >= confidence),
            "pii-scores",
        )
        now = scores.select(F.count("*"), F.coalesce(F.sum("score"), F.lit(0.0))).first()
        if now[0] == before[0] and now[1] <= before[1] + SETTLED:
            break
        before = now
    return scores.select("kind", "value").distinct()


def find_pii(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The scanned rows (row_id, doc_id) and all spans (row_id, kind, start, end, value, seed)."""
    scanned = written(scan(documents), "pii-scan")
    found = written(spans(scanned), "pii-spans")
    wanted = bootstrap(found)
    seeds = found.where("seed")
    order = Window.partitionBy("row_id").orderBy("start", "end")
    # Discovered spans of two kinds may overlap: the first one stays.
    new = (
        found.where("NOT seed").join(wanted, ["kind", "value"], "left_semi")
        .withColumn("reach", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
        .where(F.col("reach").isNull() | (F.col("reach") <= F.col("start"))).drop("reach")
    )
    return scanned, seeds.unionByName(new.select(seeds.columns))


def rank(kind: Column) -> Column:
    return F.array_position(F.array(*(F.lit(k) for k in KINDS)), kind)


def listed(items: Column) -> Column:
    """Spans as text, by kind and start."""
    return F.concat_ws(",", F.transform(F.array_sort(items), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned, found = find_pii(table(spark, sf_dir, "documents"))
    span = F.struct(rank(F.col("kind")).alias("rank"), "start", "end", "kind")
    counts = [F.sum(F.when(F.col("seed") & (F.col("kind") == k), 1).otherwise(0)).alias(f"n_{k}") for k in KINDS]
    by_row = found.groupBy("row_id").agg(
        *counts, F.collect_list(F.when(F.col("seed"), span)).alias("base"), F.collect_list(span).alias("all")
    )
    none = F.array().cast("array<struct<rank:bigint,start:bigint,end:bigint,kind:string>>")
    return scanned.select("row_id", "doc_id").join(by_row, "row_id", "left").select(
        "doc_id",
        *(F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in KINDS),
        F.sha2(listed(F.coalesce("base", none)), 256).alias("base_sha256"),
        listed(F.coalesce("all", none)).alias("spans"),
    )


def redact(documents: DataFrame, block: int = 1000) -> DataFrame:
    """Every span replaced by its kind in brackets; all other columns stay as they are, whatever their names, and
    n_chars follows the text.

    Texts are cut into blocks of ``block`` characters first, so a replacement costs a block, not the text.
    Overlapping spans are replaced together, under the kind of the first.
    """
    documents, back = sheltered(documents, ("doc_id", "text", "n_chars"))
    scanned, found = find_pii(documents)
    order = Window.partitionBy("row_id").orderBy("start", "end", "kind")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (reach <= F.col("start")), 1).otherwise(0)
    merged = (
        found.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("row_id", "island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "end")).alias("kind"))
    )
    marks = merged.select("row_id", F.struct("start", "end", "kind").alias("mark"))
    # Rows with the same id and text have the same spans, so they may share one list.
    by_text = (
        marks.join(scanned.select("row_id", "doc_id", "text_hash"), "row_id")
        .groupBy(F.col("doc_id").alias("found_id"), F.col("text_hash").alias("found_hash"))
        .agg(F.array_sort(F.collect_set("mark")).alias("marks"))
    )
    blocks = F.regexp_extract_all("text", F.lit("(?s).{1,%d}" % block), F.lit(0))

    def part(blocks: Column, a: Column, b: Column) -> Column:
        lo, hi = F.floor(a / block).cast("int"), F.floor(b / block).cast("int")
        return F.substring(F.array_join(F.slice(blocks, lo + 1, hi - lo + 1), ""), (a % block + 1).cast("int"), (b - a).cast("int"))

    def rebuilt(blocks: Column, marks: Column, size: Column) -> Column:
        pieces = F.transform(
            marks,
            lambda m, i: F.concat(
                part(blocks, F.when(i > 0, F.get(marks, i - 1)["end"]).otherwise(F.lit(0).cast("long")), m["start"]),
                F.lit("["), F.upper(m["kind"]), F.lit("]"),
            ),
        )
        return F.concat(F.array_join(pieces, ""), part(blocks, F.element_at(marks, -1)["end"], size))

    joined = documents.withColumn("pii_hash", F.xxhash64("text")).join(
        by_text, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("pii_hash") == F.col("found_hash")), "left"
    )
    size = F.length("text").cast("long")
    text = F.when(F.col("marks").isNull(), F.col("text")).otherwise(rebuilt(F.col("blocks"), F.col("marks"), size))
    out = joined.withColumn("blocks", F.when(F.col("marks").isNotNull(), blocks)).withColumn("text", text)
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(F.col("marks").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return back(out)
