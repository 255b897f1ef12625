"""Lists against their truth where they are dealt out: no shuffle after the first, and the same counters as by joins of cells."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from extractlab import catalog
from extractlab.operators import alignment, report, structure
from extractlab.plans import alignments

SF = "/root/testdata/sf0.001"
LIST = list(alignment.LIST)
ACTUAL = "case_id long, list_id string, pos int, field_id string, status string, value string, pages array<int>, row_pages array<int>"
EXPECTED = "case_id long, list_id string, ix int, field_id string, truth_status string, truth_values array<string>, truth_pages array<int>, truth_row_pages array<int>, present boolean"


@pytest.mark.parametrize("name", ["align_rows", "list_counts"])
def test_what_is_dealt_out_by_case_stays(spark, name):
    """Every table is shuffled when it is dealt out, and the matched pairs once; not a cell is shuffled again for a join or a grouping."""
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ENSURE_REQUIREMENTS") == 0 and "REPARTITION_BY_NUM" in plan


def test_the_report_shuffles_only_its_sums(spark):
    """The counters of cases are summed by label: one shuffle more than for the counters themselves."""
    plan = catalog.queries()["list_report"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ENSURE_REQUIREMENTS") == 1


def tables(spark, seed, fields):
    """Lists with wrong, blank, absent and foreign cells, null values and no pages, on one or two lists of a case."""
    r = random.Random(seed)
    pages = lambda: r.choice([[1], [2], [1, 2], [1], []])
    actual, expected = [], []
    for case in range(60):
        for name in ("l", "m")[: r.choice([1, 1, 2])]:
            for pos in range(r.choice([0, 1, 3, 5, 15])):
                own, blank = pages(), r.random() < 0.3
                for f in r.choice(fields):
                    status = r.choice(["missing", "missing", "unreadable"] if blank else ["extracted", "extracted", "missing"])
                    actual.append((case, name, pos, f, status, r.choice(["x", "y", None]) if status == "extracted" else None, pages() if status == "extracted" else [], own))
            for ix in range(r.choice([0, 1, 3, 5, 15])):
                own = r.choice([[1], [1, 2], [1, 2]])
                for f in r.choice(["ab", "ab", "a"]):
                    status = r.choice(["extracted", "extracted", "missing"])
                    expected.append((case, name, ix, f, status, r.choice([["x"], ["x", "y"], ["y", "y", None]]) if status == "extracted" else None, own, own, status == "extracted" or r.random() < 0.3))
    return spark.createDataFrame(actual, ACTUAL), spark.createDataFrame(expected, EXPECTED)


@pytest.mark.parametrize("seed", range(3))
def test_weighed_rows_are_those_of_joins(spark, seed):
    actual, expected = tables(spark, seed, ["ab", "ab", "a", "abb", "abc"])
    own = alignment.weighed(alignment.actual_rows(actual), alignment.expected_rows(expected))
    wanted = {tuple(r) for r in alignment.row_weights(actual, expected).collect()}
    assert {tuple(r) for r in own.select(*LIST, "actual", "expected", "correct", "missing").collect()} == wanted and len(wanted) > 100


@pytest.mark.parametrize("seed", range(3))
def test_counters_by_row_are_those_by_cell(spark, seed):
    # No field twice in a row: by cell that would count its true value twice, which the SQL counts once.
    actual, expected = tables(spark, seed, ["ab", "ab", "a", "abc"])
    cases = spark.range(60).selectExpr(
        "id AS case_id", *(f"'x' AS {d}" for d in report.DIMENSIONS if d != "quality"), "IF(id % 2 = 0, 'readable', 'difficult') AS quality", "IF(id % 7 = 0, 'failed', 'completed') AS execution_state", "'matched' AS expected_matching",
        "'matched' AS actual_matching", "1L AS expected_profile", "IF(id % 5 = 0, 2L, 1L) AS selected_profile", "true AS automatic", "true AS consistent", "'complete' AS expected_outcome", "'complete' AS actual_outcome", "id % 11 > 0 AS recognised")
    scalars = cases.selectExpr(
        "case_id", "'scalar' AS kind", "'t' AS identity", "0 AS pos", "'extracted' AS status", "'a' AS value", "array(1) AS pages", "'extracted' AS truth_status", "'a' AS truth_value", "array('a') AS allowed", "array(1) AS truth_pages", "true AS present")
    shapes = cases.selectExpr("case_id", "array('l') AS wanted", "IF(case_id % 9 = 0, array('l', 'l'), array('l')) AS given", "false AS row")
    # A list in three isn't the truth's; the second list of a case is told of only for some.
    lists = cases.where("case_id % 4 > 0").selectExpr("case_id", "explode(array('l', 'm')) AS list_id", "IF(case_id % 2 = 0, 'complete', 'partial') AS status", "case_id % 3 > 0 AS wanted", "IF(case_id % 3 > 0, 'complete', NULL) AS expected_status")
    got = alignments._counted(cases, scalars, shapes, lists, actual, expected, 8, ("a", "b"))

    under = cases.withColumns(report.context_columns()).select("case_id", "context")
    pairs = alignment.align_rows(alignment.row_weights(actual, expected), LIST).join(under.where("context").select("case_id"), "case_id", "left_semi")
    rows = actual.groupBy(*LIST, "pos").agg(F.bool_or(F.col("status") == "extracted").alias("accepted"), F.first("row_pages").alias("pages"), F.collect_list(F.when(F.col("status") == "missing", F.col("field_id"))).alias("absent"), F.collect_list("field_id").alias("given"))
    matched = rows.join(pairs.select(*LIST, F.col("actual").alias("pos"), F.col("expected").alias("matched")), [*LIST, "pos"], "left")
    truth = expected.groupBy(*LIST, "ix").agg(F.first("truth_row_pages").alias("pages"), F.collect_list(F.when(F.col("present"), F.col("field_id"))).alias("present"))
    told = lists.join(truth.groupBy(*LIST).agg(F.count("*").alias("expected_rows")), LIST, "left").withColumn("expected_rows", F.when(F.col("wanted"), F.coalesce("expected_rows", F.lit(0)))).join(under, "case_id")
    values = scalars.unionByName(alignment.cell_values(actual, expected, pairs))
    ids = shapes.unionByName(rows.select("case_id", F.array(F.lit("a"), F.lit("b")).alias("wanted"), "given", F.lit(True).alias("row")))
    by_cell = report.counted(cases, values, ids, structure.structure(told, matched, truth))
    wanted = {r["case_id"]: r.asDict() for r in by_cell.collect()}
    assert {r["case_id"]: r.asDict() for r in got.collect()} == wanted
    for name in ("list_cell_known_values_recovered", "false_missing_values", "schema_errors", "list_structure_errors", "list_cell_incorrect_accepted_values"):
        assert sum(w[name] for w in wanted.values()) > 0, name


def test_short_lists_in_a_table_are_the_best_chains():
    """Many lists at once, short and long, against one at a time; a list may go over several batches."""
    r = random.Random(4)
    lists = [sorted((i, j, r.randrange(3), r.randrange(1, 3)) for i in range(n) for j in range(m) if r.random() < 0.4) for n, m in ((r.choice([1, 3, 7, 14]), r.choice([1, 3, 7, 14])) for _ in range(300))]
    lists = [x for x in lists if x]
    flat = [(k, i + 1, *p) for k, own in enumerate(lists) for i, p in enumerate(own)]
    table = pa.table({n: pa.array(c, pa.int32()) for n, c in zip(("k", "_place", "actual", "expected", "correct", "missing"), zip(*flat))})
    out = pa.schema([("k", pa.int32()), ("actual", pa.int32()), ("expected", pa.int32())])
    got = {}
    for b in alignment._matched(table, out):
        for k, a, e in zip(*(c.to_pylist() for c in b.columns)):
            got.setdefault(k, []).append((a, e))
    assert {k: sorted(x) for k, x in got.items()} == {k: alignment.best_chain(x) for k, x in enumerate(lists)}
    assert any(max(max(p[:2]) for p in x) >= alignment.SHORT for x in lists) and np.mean([max(max(p[:2]) for p in x) < alignment.SHORT for x in lists]) > 0.5


def test_a_list_over_several_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        pairs = spark.range(50).selectExpr("1L AS case_id", "'l' AS list_id", "int(id) AS actual", "int(id) AS expected", "1L AS correct", "0L AS missing").unionByName(
            spark.range(5).selectExpr("2L AS case_id", "'l' AS list_id", "int(id) AS actual", "int(id) AS expected", "1L AS correct", "0L AS missing"))
        assert alignment.align_rows(pairs, LIST).groupBy("case_id").count().orderBy("case_id").collect() == [(1, 50), (2, 5)]
        assert alignment.align_rows(pairs.where("case_id = 3"), LIST).collect() == []
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
