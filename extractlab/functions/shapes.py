"""Shapes of JSON values as data: a table of declarations becomes one boolean expression over a VARIANT column.

Types are exact: a number is no text, true is no number, and 1.0 is no whole number. Names that a shape doesn't
declare are refused, as are missing ones unless they are optional.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def entries(value: Column) -> Column:
    """An object as a map of its names to values; null if it is none."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def items(value: Column) -> Column:
    """An array's values; null if it is none."""
    return F.try_variant_get(value, "$", "array<variant>")


def kind(value: Column) -> Column:
    """STRING, BOOLEAN, BIGINT (whole numbers), VOID (JSON null) and others; null without a value."""
    return F.schema_of_variant(value)


def text(value: Column) -> Column:
    """A string's text; null for all else."""
    return F.when(kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """What an expression makes of a value that is worked out once, however often the expression names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


@dataclass(frozen=True)
class Text:
    """A string of at least so many characters; ``visible``: not only white space."""

    least: int = 0
    visible: bool = False
    null: bool = False

    def fits(self, value: Column) -> Column:
        own = text(value)
        fine = is_(F.length(own) >= self.least)
        if self.visible:
            fine = fine & is_(own.rlike(r"(?U)[^\s\x1c-\x1f]"))
        return (fine | is_(F.is_variant_null(value))) if self.null else fine


@dataclass(frozen=True)
class OneOf:
    names: tuple[str, ...]
    null: bool = False

    def fits(self, value: Column) -> Column:
        fine = is_(text(value).isin(*self.names))
        return (fine | is_(F.is_variant_null(value))) if self.null else fine


@dataclass(frozen=True)
class Whole:
    least: int
    null: bool = False

    def fits(self, value: Column) -> Column:
        fine = is_((kind(value) == "BIGINT") & (F.try_variant_get(value, "$", "bigint") >= self.least))
        return (fine | is_(F.is_variant_null(value))) if self.null else fine


@dataclass(frozen=True)
class Flag:
    """true or false."""

    null: bool = False

    def fits(self, value: Column) -> Column:
        fine = is_(kind(value) == "BOOLEAN")
        return (fine | is_(F.is_variant_null(value))) if self.null else fine


@dataclass(frozen=True)
class Real:
    """A number with a fraction or exponent (1 is none), finite and within bounds."""

    least: float | None = None
    most: float | None = None
    null: bool = False

    def fits(self, value: Column) -> Column:
        own = F.try_variant_get(value, "$", "double")
        fine = is_((kind(value) == "DOUBLE") | kind(value).startswith("DECIMAL")) & is_(F.abs(own) < float("inf"))
        for bound, low in ((self.least, True), (self.most, False)):
            if bound is not None:
                fine = fine & is_(own >= bound if low else own <= bound)
        return (fine | is_(F.is_variant_null(value))) if self.null else fine


@dataclass(frozen=True)
class Like:
    """A string that a pattern matches as a whole."""

    pattern: str

    def fits(self, value: Column) -> Column:
        return is_(text(value).rlike(rf"\A(?:{self.pattern})\z"))


@dataclass(frozen=True)
class Each:
    """An array of so many values of one shape."""

    shape: object
    least: int = 0
    most: int | None = None

    def fits(self, value: Column) -> Column:
        own = items(value)
        fine = is_(F.size(own) >= self.least) & own.isNotNull() & is_(F.forall(own, self.shape.fits))
        return fine if self.most is None else fine & is_(F.size(own) <= self.most)


@dataclass(frozen=True)
class Object:
    """Names and their shapes; ``optional`` ones may be absent. ``also`` sees the map and adds a rule of the whole."""

    names: dict[str, object]
    optional: tuple[str, ...] = ()
    also: Callable[[Column], Column] | None = None
    null: bool = False

    def fits(self, value: Column) -> Column:
        fine = bound(entries(value), self._names_fit)
        return (fine | is_(F.is_variant_null(value))) if self.null else fine

    def _names_fit(self, own: Column) -> Column:
        keys = F.map_keys(own)
        known = F.array(*(F.lit(n) for n in self.names))
        needed = [n for n in self.names if n not in self.optional]
        fine = own.isNotNull() & is_(F.size(F.array_except(keys, known)) == 0)
        for name, shape in self.names.items():
            has = is_(F.array_contains(keys, name))
            fits = shape.fits(F.try_element_at(own, F.lit(name)))
            fine = fine & ((has & fits) if name in needed else (~has | fits))
        if self.also is not None:
            fine = fine & is_(self.also(own))
        return fine


@dataclass(frozen=True)
class Union:
    """Objects told apart by the text under one name."""

    tag: str
    shapes: dict[str, Object]

    def fits(self, value: Column) -> Column:
        said = text(F.try_element_at(entries(value), F.lit(self.tag)))
        fine = F.lit(False)
        for name, shape in self.shapes.items():
            fine = fine | (is_(said == name) & shape.fits(value))
        return fine
