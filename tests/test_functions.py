"""Value functions on literal cases."""

import pytest
from pyspark.sql import functions as F

from extractlab.functions import scalar as fn
from extractlab.operators import contracts


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "normal"), [
    ("0010.00", "10"), ("-0", "0"), ("0.00", "0"), ("+7", "7"), ("-1.50", "-1.5"), ("1.", None), ("1e3", None), ("", None),
    ("123456789012345678901234567890123456789012.10", "123456789012345678901234567890123456789012.1"), ("1\n", None),
])
def test_number(spark, raw, normal):
    assert value(spark, fn.normal_number(F.lit(raw))) == normal


@pytest.mark.parametrize(("raw", "normal"), [
    ("2024-02-29", "2024-02-29"), ("13/01/2024", "2024-01-13"), ("01/02/2024", None), ("02/02/2024", "2024-02-02"), ("31/02/2024", "31/02/2024"), ("soon", "soon"),
])
def test_date(spark, raw, normal):
    assert value(spark, fn.normal_date(F.lit(raw), ["%d/%m/%Y", "%m/%d/%Y"])) == normal


@pytest.mark.parametrize(("text", "good"), [("79927398713", True), ("79927398710", False), ("0", False), ("00", True), ("7992 7398713", False)])
def test_luhn(spark, text, good):
    assert value(spark, fn.luhn(F.lit(text))) is good


@pytest.mark.parametrize(("text", "good"), [("GB82 WEST 1234 5698 7654 32", True), ("GB82 WEST 1234 5698 7654 33", False), ("de89370400440532013000", True), ("DE", False)])
def test_iban(spark, text, good):
    assert value(spark, fn.iban(F.lit(text))) is good


def test_measures(spark):
    assert value(spark, fn.utf16_length(F.lit("a😀é"))) == 4
    assert value(spark, fn.label(F.lit("x" * 49))) == "x" * 47 + "…"
    assert value(spark, fn.html_escaped(F.lit("<a href='&\">"))) == "&lt;a href=&#x27;&amp;&quot;&gt;"
    assert value(spark, F.round(fn.zero_error_bound(F.lit(85), F.lit(0)), 6)) == 0.034630
    assert value(spark, F.round(fn.zero_error_bound(F.lit(16), F.lit(0)), 6)) == 0.170750
    assert value(spark, fn.zero_error_bound(F.lit(16), F.lit(1))) is None


@pytest.mark.parametrize(("path", "good"), [("a/b.png", True), ("../a", False), ("/a", False), ("a//b", False), ("c:/a", False), ("a\\b", False), (".", False), ("", False)])
def test_path(spark, path, good):
    assert value(spark, fn.safe_path(F.lit(path))) is good


@pytest.mark.parametrize(("hexed", "kind"), [("89504E470D0A1A0A00", "png"), ("FFD8FFE0", "jpeg"), ("6A756E6B255044462D31", "pdf"), ("00", None)])
def test_kind(spark, hexed, kind):
    assert value(spark, fn.media_kind(F.unhex(F.lit(hexed)))) == kind


def test_owner(spark):
    assert [value(spark, fn.owner_id(F.lit(x))) for x in ("7", "0", "-1", "9223372036854775807", "9223372036854775808", "1.0")] == [7, None, None, 2**63 - 1, None, None]


def test_failure_states(spark):
    assert [value(spark, contracts.failure_state(F.lit(x))) for x in ("runtime_timeout", "pixel_limit", "crash")] == ["timeout", "input_refused", "failed"]
