"""What a reply costs: cells of the right types and dates are read at once, and faults are told apart as before."""

import json

import pytest
from pyspark.sql import functions as F

from extractlab import catalog
from extractlab.functions import strict
from extractlab.operators import replies

from .test_replies import cell, parsed, reply, row, shapes  # noqa: F401


def test_typed_cells_and_others_are_read_alike(spark, shapes):  # noqa: F811
    """A cell that reads at once and its like that must be read part by part have the same results, null pages and doubled ones included."""
    got = parsed(spark, shapes, [reply(c) for c in (
        cell(v="1"), cell(p=(), v=None, s="missing"), cell(v="1", p=(None,)), cell(v="1", p=(1, None)), cell(v="1", p=("1",)), cell(v="1", p=(2, 2)), cell(v={"a": 1}), cell(v=[1]), cell(s=True), cell(v=1.5), {"s": "missing", "v": None, "p": [], "q": 1}, "x")])
    assert [g["problem"] for g in got] == [None, None, "wire_value_type", "wire_value_type", "wire_value_type", "pages_invalid", "wire_value_type", "wire_value_type", "wire_value_type", "wire_value_type", "wire_object_keys", "wire_object_keys"]
    assert [f["pages"] for g in got[:2] for f in g["fields"][:1]] == [[1], []]


FORMS = [["%d/%m/%Y", "%m/%d/%Y"], ["%d.%m.%Y"], ["%m/%Y"], ["%d %d %m %Y"], ["(%Y) +%m*%d"], []]
TEXTS = ["03/04/2024", "25/12/2024", "2024-02-30", "2024-02-29", "2023-02-29", "2024-1-5", "1.2.2024", "31.04.2024", "00.01.2024", "0000-01-01", "9999-12-31", "01/2024", "5 5 6 2024", "(2024) +3*4", "2024", "2024-01", " 2024-01-05", "2024-13-01", "x", ""]


def by_formatter(raw, formats):
    """Each format as Spark's formatter reads it."""
    def read(form):
        quoted = F.regexp_replace(form, r"([\\.^$|?*+()\[\]{}])", r"\\$1")
        pattern = F.replace(F.replace(F.replace(quoted, F.lit("%Y"), F.lit("[0-9]{4}")), F.lit("%d"), F.lit("[0-9]{1,2}")), F.lit("%m"), F.lit("[0-9]{1,2}"))
        spelled = F.replace(F.replace(F.replace(form, F.lit("%Y"), F.lit("yyyy")), F.lit("%d"), F.lit("d")), F.lit("%m"), F.lit("M"))
        return F.when(F.regexp_like(raw, F.concat(F.lit(r"\A"), pattern, F.lit(r"\z"))), F.date_format(F.try_to_timestamp(raw, spelled), "yyyy-MM-dd"))

    return F.array_distinct(F.array_compact(F.transform(F.array_distinct(F.concat(F.array(F.lit("%Y-%m-%d")), formats)), read)))


def test_dates_are_those_of_the_formatter(spark):
    df = spark.createDataFrame([(t, f) for t in TEXTS for f in FORMS], "raw string, formats array<string>")
    df = df.withColumn("forms", replies.date_forms(F.col("formats")))
    got = df.select("raw", "formats", replies.date_readings(F.col("raw"), F.col("forms")).alias("own"), by_formatter(F.col("raw"), F.col("formats")).alias("wanted")).collect()
    assert [(r["raw"], r["formats"], r["own"]) for r in got] == [(r["raw"], r["formats"], r["wanted"]) for r in got]
    assert sum(len(r["own"]) for r in got) > 20
    # Signs that a formatter takes for its own are plain text, too.
    one = spark.range(1).select(replies.date_readings(F.lit("[2024] 3{4"), replies.date_forms(F.array(F.lit("[%Y] %m{%d")))).alias("own")).first()
    assert one["own"] == ["2024-03-04"]


def test_declared_formats_are_made_ready_once(spark):
    """Patterns of dates belong to the declarations; no reply makes them anew, and the formatter is left for formats that lack a part."""
    plan = catalog.queries()["parsed_replies"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    read = next(line for line in plan.splitlines() if "_values#" in line and "_found#" in line and "regexp" in line.lower())
    assert "[0-9]{4}" not in read and "yyyy" not in read.replace("yyyy-MM-dd", "")


@pytest.mark.parametrize("text", [
    '{"a":1,"a":2}', '{"a":1,"a":2', '{"a":1,"a":2} x', '{"a":1,"a":NaN}', '{"a":{"b":1,"b":2},"c":[1,]}', '[{"a":1,"a":2},', '{"a":1} {}', '{"a":1}}', "1 2", "1,", '{"a":1}\u00a0', "[" * 33 + "]" * 33 + "x", '{"a":1,"a":' + "[" * 40 + "]" * 40 + "}", "-1 -", '"a" "',
])
def test_problem_by_the_standard_parser(text):
    assert strict.problem(text) == strict.spans(text)[0]


def test_plain_faults_skip_the_slow_reader(monkeypatch):
    monkeypatch.setattr(strict, "spans", None)
    whole = json.dumps(reply(rows=[row()]))
    assert strict.problem(whole[:-1] + ',"fields":1}') == "duplicate_key" and strict.problem(whole + " {}") == "trailing_content"
