"""Strict JSON, manifests and the structure of lists, on literal cases and against plain walks."""

import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from extractlab.functions import strict
from extractlab.operators import structure
from extractlab.sources import manifest

values = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(st.characters(exclude_categories=["Cs"])), lambda x: st.lists(x) | st.dictionaries(st.text(st.characters(exclude_categories=["Cs"])), x), max_leaves=12)


def at(value, pointer):
    for step in pointer.split("/")[1:]:
        value = value[int(step)] if isinstance(value, list) else value[step.replace("~1", "/").replace("~0", "~")]
    return value


def count(value):
    return 1 + sum(map(count, value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()))


@settings(max_examples=150, deadline=None)
@given(values, st.booleans(), st.sampled_from([None, 2]))
def test_spans_cut_out_every_value(value, ascii_only, indent):
    text = json.dumps(value, ensure_ascii=ascii_only, indent=indent)
    problem, found = strict.spans(f" {text}\n")
    data = f" {text}\n".encode()
    assert problem is None and len(found) == len({p for p, _, _ in found}) == count(value)
    assert all(json.loads(data[a:b]) == at(value, p) for p, a, b in found)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from('{}[]:,"a1 -.e\\ntruefalsn'), max_size=14))
def test_what_a_strict_parser_refuses_is_refused(text):
    def names(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError
        return dict(pairs)

    try:
        json.loads(text, object_pairs_hook=names, parse_constant=lambda c: json.loads("x"))
        good = True
    except ValueError:
        good = False
    assert (strict.spans(text)[0] is None) == good


@pytest.mark.parametrize("text,problem", [
    ("", "incomplete_json"), ("[1", "incomplete_json"), ("NaN", "invalid_json"), ("[1,]", "invalid_json"), ('{"a":1,}', "invalid_json"), ('{"a":1,"\\u0061":2}', "duplicate_key"), ("{} 1", "trailing_content"), ("{} x", "trailing_content"),
    ("[" * 33 + "]" * 33, None), ("[" * 34 + "]" * 34, "nesting_limit"), ('"\x01"', "invalid_json"), ("01", "trailing_content"), ("[-Infinity]", "invalid_json"),
])
def test_problems(text, problem):
    assert strict.spans(text)[0] == problem


def test_nulls_and_long_texts(spark):
    long = '"' + "é" * 3_000_000 + '"'
    got = spark.createDataFrame([(1, None), (2, long)], "i int, t string").select("i", strict.strict_json(F.col("t")).alias("r")).select("i", "r.problem", F.col("r.spans.right").alias("right")).collect()
    assert {r["i"]: (r["problem"], r["right"]) for r in got} == {1: ("no_text", []), 2: (None, [6_000_002])}


def test_manifest(spark, tmp_path):
    root = tmp_path / "corpus"
    (root / "a").mkdir(parents=True)
    (root / "a" / "one two+%.jpg").write_bytes(b"one")
    (root / "b.pdf").write_bytes(b"two")
    (root / "unlisted").write_bytes(b"x")
    sha = {n: hashlib.sha256(n.encode()).hexdigest() for n in ("one", "two", "other")}
    files = [("i1", "a/one two+%.jpg", "one", "photo"), ("i2", "b.pdf", "two", "pdf"), ("i3", "b.pdf", "other", "photo"), ("i4", "none.jpg", "one", "photo"), ("i5", "../b.pdf", "two", "photo")]
    data = {"schema_version": 1, "split": "tuning", "cases": [{"case_id": "c", "delivery_path": "photo", "input_artifact_ids": ["i1", "i2", "i9"], "artifacts": [{"id": i, "path": p, "sha256": sha[s], "kind": k} for i, p, s, k in files]}]}
    path = tmp_path / "manifest.json"
    path.write_text(json.dumps(data))
    read = manifest.read_manifest(spark, str(path))
    found = manifest.file_problems(manifest.artifacts(read), manifest.file_digests(spark, str(root))).collect()
    assert {(r["id"], r["problem"]) for r in found} == {("i2", "primary_delivery_kind_mismatch"), ("i3", "artifact_hash_mismatch"), ("i4", "artifact_missing"), ("i5", "unsafe_artifact_path")}
    assert [r["id"] for r in manifest.unknown_inputs(read).collect()] == ["i9"]
    for bad in ('{"schema_version":1,"schema_version":1}', '{"schema_version":"x"}', "{"):
        path.write_text(bad)
        with pytest.raises(Exception, match="invalid_manifest|MALFORMED"):
            manifest.read_manifest(spark, str(path)).collect()


def test_blank_rows_pair_within_their_gap(spark):
    # By position: blank, matched 1, blank, accepted but wrong, blank, blank (beyond the gap), matched 4, blank on another page, blank.
    rows = [(1, False, [1], None), (2, True, [1], 1), (3, False, [1], None), (4, True, [1], None), (5, False, [1], None), (6, False, [1], None), (7, True, [1], 4), (8, False, [9], None), (9, False, [1], None)]
    actual = spark.createDataFrame([("c", "l", p, a, g, ["x", "y"], m) for p, a, g, m in rows], "case_id string, list_id string, pos int, accepted boolean, pages array<int>, absent array<string>, matched int")
    truth = spark.createDataFrame([("c", "l", i, [1, 2], ["x"]) for i in range(7)], "case_id string, list_id string, ix int, pages array<int>, present array<string>")
    assert sorted((r["pos"], r["ix"]) for r in structure.blank_row_pairs(actual, truth).collect()) == [(1, 0), (3, 2), (5, 3), (9, 6)]
    lists = spark.createDataFrame([("c", "l", "partial", True, True, "complete", 7), ("d", "l", "complete", True, True, "complete", 0), ("e", "l", "partial", True, False, None, None)], "case_id string, list_id string, status string, context boolean, wanted boolean, expected_status string, expected_rows int")
    got = {r["case_id"]: r[1:] for r in structure.structure(lists, actual, truth).collect()}
    assert got == {"c": (1, 0, 4), "d": (0, 1, 0), "e": (1, 0, 0)}
