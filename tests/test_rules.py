"""The smaller rules on literal cases."""

from pyspark.sql import functions as F

from extractlab.operators import rules


def units(text):
    return len(text.encode("utf-16-le")) // 2


def test_previews_never_split_a_pair(spark):
    texts = ["", "short", "x" * 3900, "x" * 3901, "x" * 3899 + "😀" + "y", "😀" * 4000, "a\nb" * 2000]
    got = {r["t"]: r["p"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", rules.preview_parts(F.col("t")).alias("p")).collect()}
    for t in texts[1:]:
        parts = got[t]
        bodies = parts if len(parts) == 1 else [p.split("\n", 1)[1] for p in parts]
        assert "".join(bodies) == t and all(units(b) <= 3900 for b in bodies)
        assert len(parts) == 1 or [p.split("\n", 1)[0] for p in parts] == [f"Preview part {i}/{len(parts)}" for i in range(1, len(parts) + 1)]
    assert got[""] == [] and [units(p.split("\n", 1)[1]) for p in got[texts[4]]] == [3899, 3]


def test_usable_probabilities(spark):
    cases = [([0.0, 1.0], True), ([], False), ([0.5, float("nan")], False), ([1.1], False), ([-0.1], False), ([None], False), (None, False)]
    rows = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(cases)], "i int, v array<double>").select("i", rules.usable_probabilities(F.col("v")).alias("ok")).collect()
    assert {r["i"]: r["ok"] for r in rows} == {i: ok for i, (_, ok) in enumerate(cases)}


def test_freeze_gate(spark):
    from extractlab.operators import verify

    got = spark.createDataFrame([(0, 0, 0.95), (1, 0, 0.95), (0, 1, 0.95), (0, 0, 0.5), (0, 0, None)], "w long, p long, c double").select(verify.freeze_gate(F.col("w"), F.col("p"), F.col("c"), 0.9).alias("g")).collect()
    assert [r["g"] for r in got] == ["selectable", "calibration_point_has_errors", "calibration_point_has_errors", "calibration_completeness_below_target", "calibration_completeness_below_target"]
