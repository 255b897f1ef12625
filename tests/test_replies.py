"""Replies of several shapes against literal results, one fault at a time."""

import json

import pytest
from pyspark.sql import functions as F

from extractlab import catalog
from extractlab.functions import strict
from extractlab.functions.shapes import Each, Object, OneOf, Text, Union, Whole
from extractlab.operators import replies

DECLARED = [(1, None, "total", "number", None, 0), (1, None, "day", "date", ["%d/%m/%Y", "%m/%d/%Y"], 1), (1, None, "paid", "boolean", None, 2), (1, "items", "code", "text", None, 3), (1, "items", "qty", "number", None, 4), (2, None, "note", "text", None, 0)]


def cell(s="extracted", v="x", p=(1,)):
    return {"s": s, "v": v, "p": list(p)}


def row(code=None, qty=None, pages=(1,), before=False, after=False):
    return {"cells": {"code": code or cell(), "qty": qty or cell(v="1")}, "pages": list(pages), "continues_previous": before, "continues_next": after}


def reply(total=None, day=None, paid=None, rows=(), status="complete", whole=True, reason=None, **more):
    return {
        "fields": {"total": total or cell(v="+01.50"), "day": day or cell(v="25/12/2024"), "paid": paid or cell(v=True)},
        "lists": {"items": {"status": status, "enumeration_complete": whole, "reason": reason, "rows": list(rows)}}, "membership": {"1": "yes", "2": "no"}, **more,
    }


@pytest.fixture(scope="module")
def shapes(spark):
    return replies.profile_shapes(spark.createDataFrame(DECLARED, "profile int, list_id string, field_id string, kind string, formats array<string>, place int"))


def parsed(spark, shapes, given, profile=1):
    texts = [g if g is None or isinstance(g, str) else json.dumps(g) for g in given]
    df = spark.createDataFrame([(i, profile, [1, 2], t) for i, t in enumerate(texts)], "reply int, profile int, pages array<int>, text string")
    return [r.asDict(recursive=True) for r in replies.parsed_batches(df, shapes, "reply").orderBy("reply").collect()]


def test_results(spark, shapes):
    got = parsed(spark, shapes, [reply(rows=[row(), row(cell(v="Ü"), cell("missing", None, ()), after=True)])])[0]
    assert got["problem"] is None
    assert {f["field_id"]: (f["status"], f["raw"], f["normalized"]) for f in got["fields"]} == {"total": ("extracted", "+01.50", "1.5"), "day": ("extracted", "25/12/2024", "2024-12-25"), "paid": ("extracted", "true", None)}
    assert [m["status"] for m in got["membership"]] == ["yes", "no"]


def test_failed_normal_forms_are_no_errors(spark, shapes):
    good, bad = row(), row(qty=cell(v="many"))
    got = parsed(spark, shapes, [
        reply(cell(v="1,5"), cell(v="03/04/2024"), cell(v="yes")), reply(day=cell(v="soon"), rows=[good, bad]), reply(rows=[row(cell(v=True), cell(v="many"))]), reply(cell(v=None), rows=[good]),
    ])
    assert [g["problem"] for g in got] == [None] * 4
    assert [f["status"] for f in got[0]["fields"]] == ["invalid"] * 3 and got[0]["fields"][1]["raw"] == "03/04/2024"
    assert (got[1]["fields"][1]["status"], got[1]["fields"][1]["normalized"]) == ("extracted", None)
    assert [(x["lists"][0]["status"], x["lists"][0]["reason"]) for x in got] == [("complete", None), ("partial", None), ("unresolved", "invalid"), ("complete", None)]
    assert got[3]["fields"][0]["status"] == "invalid" and got[1]["lists"][0]["rows"][1]["source_key"] == "batch:1:row:1"


FAULTS = [
    ("wire_object_keys", reply(extra=1)), ("wire_object_keys", reply(total={"s": "missing", "v": None})), ("wire_object_keys", reply(rows=[{"cells": {}}])), ("wire_object_keys", [1]),
    ("wire_pages_type", reply(total={"s": "missing", "v": None, "p": 1})), ("wire_rows_type", {**reply(), "lists": {"items": {"status": "complete", "enumeration_complete": True, "reason": None, "rows": {}}}}),
    ("wire_value_type", reply(cell("found"))), ("wire_value_type", reply(cell(v=12))), ("wire_value_type", reply(cell(p=(1.0,)))), ("wire_value_type", reply(whole="yes")), ("wire_value_type", reply(reason="lost")),
    ("wire_value_type", {**reply(), "membership": {"1": "yes", "2": "perhaps"}}), ("wire_value_type", reply(rows=[row(after="true")])),
    ("pages_invalid", reply(cell(v="1", p=(1, 1)))), ("pages_invalid", reply(cell(v="1", p=(0,)))), ("raw_required", reply(rows=[row(cell(v=None, p=()))])), ("raw_forbidden", reply(cell("missing", "1"))),
    ("pages_required", reply(cell(v="1", p=()))), ("pages_required", reply(rows=[row(cell("missing", None, ()), cell("missing", None, ()), pages=())])), ("cell_pages_outside_row", reply(rows=[row(cell(p=(2,)))])),
    ("complete_needs_enumeration_and_cells", reply(whole=False)), ("partial_needs_accepted_cell", reply(status="partial", whole=False)), ("unresolved_has_accepted_cell", reply(status="unresolved", rows=[row()], reason="missing")),
    ("unresolved_needs_reason", reply(status="unresolved")), ("reason_forbidden", reply(reason="missing")), ("partial_is_complete", reply(status="partial", rows=[row()])),
    ("pages_unavailable", reply(cell(v="1", p=(9,)))), ("boundary_flags", reply(rows=[row(after=True), row()])), ("boundary_flags", reply(rows=[row(), row(before=True)])),
    ("no_text", None), ("duplicate_key", '{"fields":{},"fields":{}}'), ("trailing_content", json.dumps(reply()) + "x"), ("incomplete_json", "{"), ("invalid_json", '{"a":NaN}'),
]


def test_faults(spark, shapes):
    got = parsed(spark, shapes, [f for _, f in FAULTS])
    assert [g["problem"] for g in got] == [code for code, _ in FAULTS]
    assert all(g["fields"] is None and g["lists"] is None for g in got)


def test_profiles_of_other_shapes_and_none(spark, shapes):
    note = {"fields": {"note": cell(v="ok")}, "lists": {}, "membership": {"1": "yes", "2": "yes"}}
    got = parsed(spark, shapes, [note, reply()], profile=2)
    assert got[0]["problem"] is None and got[0]["fields"][0]["raw"] == "ok" and got[0]["lists"] == [] and got[1]["problem"] == "wire_object_keys"
    assert parsed(spark, shapes, [note], profile=3) == [] and parsed(spark, shapes, []) == []


@pytest.mark.parametrize(("text", "wanted"), [
    ('{"status":"matched","profile_index":2}', (None, "matched", 20)), ('{"status":"matched","profile_index":3}', ("profile_index_outside_snapshots", None, None)), ('{"status":"matched","profile_index":null}', ("profile_index_required", None, None)),
    ('{"status":"mixed","profile_index":1}', ("profile_index_forbidden", None, None)), ('{"status":"mixed"}', (None, "mixed", None)), ('{"status":"no_profile","type_description":" "}', ("type_description_required", None, None)),
    ('{"status":"no_profile","type_description":"an invoice"}', (None, "no_profile", None)), ('{"status":"mixed","x":1}', ("wire_object_keys", None, None)), ('{"status":"matched","profile_index":true}', ("wire_value_type", None, None)),
])
def test_matching(spark, text, wanted):
    df = spark.createDataFrame([(1, text, [10, 20])], "reply int, text string, snapshots array<int>")
    assert tuple(replies.parsed_matching(df, "reply").first())[1:] == wanted


def test_shapes(spark):
    shape = Union("kind", {"a": Object({"kind": Text(), "n": Whole(1, null=True), "t": Text(1)}, ("t",)), "b": Object({"kind": Text(), "each": Each(OneOf(("x", "y")), 1, 2)})})
    good = ['{"kind":"a","n":1}', '{"kind":"a","n":null,"t":"z"}', '{"kind":"b","each":["x"]}']
    bad = ['{"kind":"a"}', '{"kind":"a","n":0}', '{"kind":"a","n":1.0}', '{"kind":"a","n":true}', '{"kind":"a","n":1,"t":""}', '{"kind":"a","n":1,"u":1}', '{"kind":"b","each":[]}', '{"kind":"b","each":["x","y","x"]}', '{"kind":"b","each":["z"]}', '{"kind":"b","each":"x"}', '{"kind":"c"}', "[]", "null", '{"kind":1,"n":1}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "i int, t string")
    got = [r["f"] for r in df.select("i", shape.fits(F.try_parse_json("t")).alias("f")).orderBy("i").collect()]
    assert got == [True] * len(good) + [False] * len(bad)


def test_drafts_or_questions(spark):
    field = {"type": "date", "id": "f", "label": "F", "description": "d"}
    draft = {"name": "N", "description": "d", "scalar_fields": [field], "lists": [], "source_index": None}

    def both(status, drafts, questions):
        return json.dumps({"status": status, "drafts": drafts, "questions": questions})

    iso = {**field, "validator": {"kind": "iso_code", "allowlist": []}}
    texts = [both("drafts", [draft], []), both("questions", [], ["Which?"]), both("drafts", [draft], ["x"]), both("questions", [], [" "]), both("drafts", [{**draft, "scalar_fields": []}], []), both("drafts", [{**draft, "scalar_fields": [iso]}], []), "{"]
    df = spark.createDataFrame(list(enumerate(texts)), "reply int, text string")
    got = replies.draft_replies(df, "reply").orderBy("reply").collect()
    assert [r["status"] for r in got] == ["drafts", "questions"] + ["refused"] * 5 and got[0]["drafts"][0]["scalars"] == 1 and got[1]["questions"] == ["Which?"]


def test_every_reply_is_read_once_and_by_many_tasks(spark):
    sf = "/root/testdata/sf0.001"
    for name in ("parsed_replies", "parsed_cells", "parsed_lists", "parsed_membership", "draft_replies"):
        df = catalog.queries()[name](spark, sf)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and plan.count("RepartitionByExpression") == 1, name


@pytest.mark.parametrize("text", [
    "", " ", "1", '"a"', "{}", "[]", "[1,]", '{"a":1,"a":2}', '{"a":[{"b":1,"b":1}]}', '{"a":1} x', "{} {}", '{"a":', "NaN", "[Infinity]", "-", "01", "1.", '"\\ud800"', '"\t"', "﻿1", " 1", "１",
    "[" * 32 + "1" + "]" * 32, "[" * 33 + "1" + "]" * 33, "[" * 33 + "]" * 33, "[" * 34 + "]" * 34, "[" * 5000, "[" + "[]," * 40 + "1]", "9" * 5000, "1e999", '{"a":"[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[[["}',
])
def test_problem_of_a_text_is_that_of_its_spans(text):
    assert strict.problem(text) == strict.spans(text)[0]
