"""Files, shapes and sinks: good and bad files, canonical bytes, writing once, and ledgers."""

import hashlib
import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from extractlab import catalog
from extractlab.functions.canonical import canonical_json, canonical_sha256
from extractlab.sources import typed

H = "a" * 64
FROZEN = {
    "schema_version": 1, "created_at": "2024-01-02T03:04:05Z", "corpus_manifest_schema_version": 1, "code_sha256": H,
    "runtime_artifacts": {"llama_cpp_build": "b11221", "executable_sha256": H, "model_sha256": H, "projector_sha256": H},
    "runtime_profile": {"context_tokens": 1, "image_min_tokens": 1, "image_max_tokens": 1, "output_tokens": 1, "pdf_dpi": 1, "alternative_pdf_dpi": 1, "vision_gpu": True, "cache_type": "q8"},
    "core": {"processing_budget_s": 300.0, "image_long_side": 1, "matching_long_side": 1, "call_timeout_s": 1.5, "release_timeout_s": 1e-3, "maximum_response_bytes": 1, "top_logprobs": 1, "max_pixels": 1, "quota_bytes": 1, "free_reserve_bytes": 1},
    "prompt": {"version": "p1", "sha256": H}, "policy": {"min_token_probability": None, "check_alternate_view": False, "check_declared_format": True, "matching_margin": 0.5},
    "calibration": {"tuning_manifest_sha256": H, "calibration_report_sha256": H, "point_index": 0, "selection_rule": "r"}, "dependencies": {n: "1" for n in ("python", "httpx", "pillow", "pypdfium2", "pydantic", "pydantic_core")},
    "page_times": [{"kind": "png", "count": 1, "p5": 0.1, "p50": 0.2, "p95": 0.3}],
}


def canonical(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def problem(spark, text, shape=typed.FROZEN, **more):
    return typed.typed(spark.createDataFrame([(text,)], "text string"), "text", shape, **more).first()["problem"]


def changed(path, value, drop=False):
    copy = json.loads(json.dumps(FROZEN))
    *above, last = path
    place = copy
    for step in above:
        place = place[step]
    if drop:
        del place[last]
    else:
        place[last] = value
    return canonical(copy)


def test_frozen_shape(spark):
    assert problem(spark, canonical(FROZEN), canonical=True) is None
    assert problem(spark, json.dumps(FROZEN), canonical=True) == "not_canonical" and problem(spark, json.dumps(FROZEN)) is None
    assert problem(spark, changed(["page_times"], None, drop=True)) is None and problem(spark, changed(["policy", "min_token_probability"], 0.25)) is None
    bad = [
        changed(["schema_version"], 2), changed(["schema_version"], True), changed(["created_at"], "2024-01-02T03:04:05"), changed(["code_sha256"], "A" * 64), changed(["core", "call_timeout_s"], 1), changed(["core", "image_long_side"], 1.0),
        changed(["policy", "matching_margin"], 1.5), changed(["calibration", "point_index"], -1), changed(["prompt", "version"], ""), changed(["extra"], 1), changed(["dependencies", "httpx"], 1), changed(["policy"], None, drop=True),
        changed(["page_times"], FROZEN["page_times"] * 2), changed(["page_times", 0, "count"], 0), changed(["runtime_artifacts", "llama_cpp_build"], "b1"), "[]", "null",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(bad)], "i int, text string")
    assert [r["problem"] for r in typed.typed(df, "text", typed.FROZEN).orderBy("i").collect()] == ["other_shape"] * len(bad)
    for text, code in (("{", "invalid_json"), ('{"a":1,"a":2}', "duplicate_key"), ('{"a":1e999}', "non_finite_number"), (None, "no_text")):
        assert problem(spark, text) == code


def test_frozen_files(spark, tmp_path):
    text = canonical(FROZEN)
    (tmp_path / "good.json").write_bytes(text.encode())
    got = typed.read_frozen(spark, str(tmp_path / "good.json")).select("sha256").first()[0]
    assert got == hashlib.sha256(text.encode()).hexdigest()
    for name, data in (("spaced", text.encode() + b"\n"), ("latin", text.replace("p1", "\xff").encode("latin-1")), ("empty", b"")):
        (tmp_path / f"{name}.json").write_bytes(data)
        with pytest.raises((PySparkException, typed.SourceError), match="invalid_frozen_configuration"):
            typed.read_frozen(spark, str(tmp_path / f"{name}.json")).collect()


def test_behavior_leaves_out_when_it_was_frozen(spark):
    environment = {k: FROZEN[k] for k in ("code_sha256", "prompt", "runtime_artifacts", "runtime_profile", "core", "dependencies")}
    wanted = hashlib.sha256(canonical({"environment": environment, "policy": FROZEN["policy"]}).encode()).hexdigest()
    rows = [canonical(FROZEN), changed(["created_at"], "2025-01-02T03:04:05Z"), changed(["policy", "matching_margin"], 0.25), "{}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = [r["d"] for r in df.select("i", typed.behavior_sha256(F.col("t")).alias("d")).orderBy("i").collect()]
    assert got[0] == got[1] == wanted and got[2] not in (None, wanted) and got[3] is None


def test_canonical_bytes_of_nested_values(spark):
    values = [{"b": [1, {"z": None, "a": "é😀\n"}], "a": {"y": 1.5, "x": True}}, [], "x", {"k": {}}, 10**20]
    df = spark.createDataFrame([(i, json.dumps(v, indent=2)) for i, v in enumerate(values)], "i int, t string")
    got = df.select("i", canonical_json(F.col("t"))["text"].alias("t"), canonical_sha256(F.col("t")).alias("d")).orderBy("i").collect()
    assert [r["t"] for r in got] == [canonical(v) for v in values]
    assert [r["d"] for r in got] == [hashlib.sha256(canonical(v).encode()).hexdigest() for v in values]


def test_written_once(spark, tmp_path):
    path = str(tmp_path / "table")
    df = spark.range(100).withColumn("t", F.col("id").cast("string"))
    assert typed.write_new(df, path).count() == 100
    with pytest.raises(typed.SinkError, match="output_exists"):
        typed.write_new(df, path)
    assert spark.read.parquet(path).count() == 100 and os.listdir(tmp_path) == ["table"]
    other = str(tmp_path / "other")
    with pytest.raises(typed.SinkError, match="output_differs"):  # every reading has its own time
        typed.write_new(df.withColumn("r", F.current_timestamp()), other)
    with pytest.raises(PySparkException):
        typed.write_new(df.withColumn("r", F.raise_error(F.lit("lost")).cast("string")), other)
    assert os.listdir(tmp_path) == ["table"]


def test_ledgers(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert typed.ledger(spark, path).count() == 0
    write = typed.appended(path)
    first = spark.createDataFrame([("started", "r1"), ("completed", "r1")], "event string, run_id string")
    write(first, 0)
    write(first, 0)  # tried again after a failure
    write(spark.createDataFrame([("started", "r2")], "event string, run_id string"), 1)
    assert sorted(r["event"] for r in typed.ledger(spark, path).collect()) == ["completed", "started", "started"]
    write(spark.createDataFrame([("paused", "r3")], "event string, run_id string"), 2)
    with pytest.raises(PySparkException, match="benchmark_ledger_invalid"):
        typed.ledger(spark, path).collect()


def test_ledger_stream(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "ledger")
    source.mkdir()
    (source / "a.json").write_text('{"event":"started","run_id":"r1"}\n{"event":"completed","run_id":"r1"}\n')
    stream = spark.readStream.schema("event string, run_id string").json(str(source))
    stream.writeStream.foreachBatch(typed.appended(path)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert typed.ledger(spark, path).count() == 2


def test_decisions_are_read_by_many_tasks_and_once(spark):
    sf = "/root/testdata/sf0.001"
    assert catalog.queries()["decision_files"](spark, sf).rdd.getNumPartitions() == 8
    plan = catalog.queries()["decided_values"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("parseJson") == 1
