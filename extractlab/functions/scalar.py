"""Exact value functions: normalisation, declared formats, text measures, paths, boxes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The date formats' spellings, as a pattern of the raw text and Spark's format.
DATE_FORMATS = {
    "%Y-%m-%d": (r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", "yyyy-M-d"),
    "%d/%m/%Y": (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "d/M/yyyy"),
    "%m/%d/%Y": (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "M/d/yyyy"),
    "%d.%m.%Y": (r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}$", "d.M.yyyy"),
}


def normal_number(raw: Column) -> Column:
    """An exact decimal string in normal form, null if it is none. Never cast: precision is unbounded."""
    whole = F.regexp_replace(raw, r"^(?:\+|(-))?0*(?=[0-9])", "$1")
    size = F.regexp_replace(whole, r"\.0*$|(\.[0-9]*[1-9])0+$", "$1")
    return F.when(raw.rlike(r"\A[+-]?[0-9]+(\.[0-9]+)?\z"), F.regexp_replace(size, "^-0$", "0"))


def date_readings(raw: Column, formats: list[str]) -> Column:
    """The distinct ISO dates that a text can mean, ISO itself included."""
    ways = list(dict.fromkeys(["%Y-%m-%d", *formats]))
    read = [
        F.when(raw.rlike(DATE_FORMATS[w][0]), F.date_format(F.try_to_timestamp(raw, F.lit(DATE_FORMATS[w][1])), "yyyy-MM-dd"))
        for w in ways
    ]
    return F.array_distinct(F.array_compact(F.array(*read)))


def normal_date(raw: Column, formats: list[str]) -> Column:
    """One reading: its ISO form; none: the raw text; several: null, an error."""
    read = date_readings(raw, formats)
    return F.when(F.size(read) == 1, read[0]).when(F.size(read) == 0, raw)


def luhn(value: Column) -> Column:
    """At least two digits with a valid check digit."""
    plain = value.rlike(r"\A[0-9]{2,}\z")
    return plain & F.call_function("luhn_check", F.when(plain, value).otherwise("1"))


def iban(value: Column) -> Column:
    """Shape and remainder of an account number; the remainder digit by digit, so nothing overflows."""
    text = F.upper(F.replace(value, F.lit(" "), F.lit("")))
    turned = F.concat(F.substring(text, 5, 64), F.substring(text, 1, 4))
    codes = F.transform(F.split(turned, ""), lambda c: F.when(c.rlike("[A-Z]"), (F.ascii(c) - 55).cast("string")).otherwise(c))
    rest = F.aggregate(F.split(F.array_join(codes, ""), ""), F.lit(0), lambda r, d: (r * 10 + d.try_cast("int")) % 97)
    return text.rlike(r"\A[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\z") & F.coalesce(rest == 1, F.lit(False))


def utf16_length(text: Column) -> Column:
    return (F.length(F.encode(text, "UTF-16LE")) / 2).cast("long")


def label(text: Column, most: int = 48) -> Column:
    """A text of at most ``most`` characters, the last one an ellipsis if it was longer."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 1), F.lit("…")))


def html_escaped(text: Column) -> Column:
    #: The five characters and their entities, the ampersand first.
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def safe_path(path: Column) -> Column:
    """A canonical relative path: no backslash, drive, root, parent or empty step."""
    steps = F.split(path, "/")
    return (
        ~path.contains("\\") & ~path.contains(":") & ~path.startswith("/") & (path != "") & (path != ".")
        & ~F.exists(steps, lambda s: (s == "..") | (s == "") | (s == "."))
    )


def media_kind(content: Column) -> Column:
    """png, jpeg or pdf by the first 1024 bytes, else null."""
    head = F.hex(F.substring(content, 1, 8))
    return (
        F.when(head == "89504E470D0A1A0A", "png").when(head.startswith("FFD8FF"), "jpeg")
        .when(F.decode(F.substring(content, 1, 1024), "ISO-8859-1").contains("%PDF-"), "pdf")
    )


def iou(a: Column, b: Column) -> Column:
    """Overlap of two boxes (left, top, right, bottom) over their union; 0 without a union."""
    def side(box: Column, low: str, high: str) -> Column:
        return F.greatest(F.lit(0.0), box[high] - box[low])

    wide = F.greatest(F.lit(0.0), F.least(a["right"], b["right"]) - F.greatest(a["left"], b["left"]))
    tall = F.greatest(F.lit(0.0), F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"]))
    both = wide * tall
    union = side(a, "left", "right") * side(a, "top", "bottom") + side(b, "left", "right") * side(b, "top", "bottom") - both
    return F.when(union > 0, both / union).otherwise(0.0)


def owner_id(text: Column) -> Column:
    """A positive 64-bit id written in plain digits, else null."""
    value = text.try_cast("bigint")
    return F.when(text.rlike(r"\A[0-9]+\z") & (value >= 1), value)


def zero_error_bound(n: Column, errors: Column, confidence: float = 0.95) -> Column:
    """Exact upper bound of an error rate of which no case was seen; null with errors or without cases."""
    return F.when((errors == 0) & (n > 0), -F.expm1(F.log(F.lit(1 - confidence)) / n))
