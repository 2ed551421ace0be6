"""Absolute and relative tolerances: global values with overrides by column."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What applies if neither tolerance is given on the command line.
DEFAULT_ABSOLUTE, DEFAULT_RELATIVE = 1e-15, 1e-12


@dataclass(frozen=True)
class Tolerance:
    """absolute and relative hold for all columns; a column's own value, if any, replaces that one of the two."""

    absolute: float | None = None
    relative: float | None = None
    column_absolute: Mapping[str, float] = field(default_factory=dict)
    column_relative: Mapping[str, float] = field(default_factory=dict)

    def absolute_of(self, column: str) -> float | None:
        return self.column_absolute.get(column, self.absolute)

    def relative_of(self, column: str) -> float | None:
        return self.column_relative.get(column, self.relative)

    def named(self) -> set[str]:
        return {*self.column_absolute, *self.column_relative}

    def __bool__(self) -> bool:
        return self.absolute is not None or self.relative is not None or bool(self.named())

    def merged(self, other: Tolerance) -> Tolerance:
        """This one's global values, where it has any, and the other's column values, where both name a column."""
        pick = lambda mine, theirs: theirs if mine is None else mine
        return Tolerance(
            pick(self.absolute, other.absolute),
            pick(self.relative, other.relative),
            {**self.column_absolute, **other.column_absolute},
            {**self.column_relative, **other.column_relative},
        )


def _number(text: str, what: str) -> float:
    try:
        return float(text)
    except ValueError:
        raise ValueError(f"{what}: {text!r} is not a number") from None


def _parse(spec: str | None, what: str) -> tuple[float | None, dict[str, float]]:
    """One number for all columns, or column:number pairs with commas between."""
    if spec is None or not spec.strip():
        return None, {}
    if ":" not in spec:
        return _number(spec.strip(), what), {}
    columns = {}
    for pair in filter(None, map(str.strip, spec.split(","))):
        name, colon, value = pair.partition(":")
        if not colon or ":" in value or not name.strip():
            raise ValueError(f"{what}: {pair!r} is not of the form column:number")
        columns[name.strip()] = _number(value.strip(), what)
    return None, columns


def parse(absolute: str | None = None, relative: str | None = None) -> Tolerance:
    (a, by_a), (r, by_r) = _parse(absolute, "tolerance"), _parse(relative, "relative tolerance")
    return Tolerance(a, r, by_a, by_r)


def from_options(absolute: str | None, relative: str | None) -> Tolerance:
    """Command-line rule: with neither given the defaults hold; a literal "0" turns that one off; one given leaves the other off."""
    if absolute is None and relative is None:
        return Tolerance(DEFAULT_ABSOLUTE, DEFAULT_RELATIVE)
    off = lambda spec: None if spec == "0" else spec
    return parse(off(absolute), off(relative))


def within(a: Column, b: Column, absolute: float | None, relative: float | None) -> Column:
    """Never null. Both null: true; one null: false; else either bound (inclusive) suffices; no bound: true.

    The relative difference is to the larger magnitude. Where the test has no answer (both zero with a relative bound
    alone), equal values are within.
    """
    if absolute is None and relative is None:
        return F.lit(True)
    size = F.abs(a - b)
    tests = []
    if absolute is not None:
        tests.append(size <= absolute)
    if relative is not None:
        tests.append(F.try_divide(size, F.greatest(F.abs(a), F.abs(b))) <= relative)
    either = tests[0] if len(tests) == 1 else tests[0] | tests[1]
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(either, a.eqNullSafe(b))).otherwise(a.isNull() & b.isNull())
