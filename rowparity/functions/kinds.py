"""How each kind of column compares: equality, tolerance, differences and statistics, as Column expressions.

A kind is one strategy object. To compare a type in another way, register a kind of your own for it in KINDS.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import arrays, geo, sketches, tolerance
from .tolerance import Tolerance


@dataclass(frozen=True)
class Settings:
    """What a comparison's expressions depend on beside the columns.

    overflow: what a difference of whole numbers beyond 64 bits gives, an "error" or "null" (a summary then
    warns). "auto": null in summaries, an error in diffs.
    hot_rows: keys with so many rows, or pairs of rows, are dealt out over parts of the join; None: no key is.
    """

    tolerance: Tolerance = Tolerance()
    sketch_absolute: float = 0.0
    sketch_relative: float = 0.05
    overflow: str = "auto"
    hot_rows: int | None = None

    def __post_init__(self) -> None:
        if self.overflow not in ("auto", "error", "null"):
            raise ValueError("overflow must be auto, error or null")


class Kind:
    """A kind without differences: equality alone. The short names of the kinds are fixed values of the reports."""

    name, short = "OTHER", "?"

    def equal(self, a: Column, b: Column, how: Settings, struct: bool = False) -> Column:
        return a.eqNullSafe(b)

    def toleranced(self, column: str, how: Settings) -> bool:
        return False

    def within(self, a: Column, b: Column, column: str, how: Settings, struct: bool = False) -> Column:
        return self.equal(a, b, how, struct)

    def shown(self, a: Column, struct: bool = False) -> Column:
        """The value as a diff shows it."""
        return a

    def deltas(self, a: Column, b: Column, how: Settings, struct: bool = False) -> dict[str, Column]:
        """Suffix -> difference."""
        return {}

    def stats(self, d: dict[str, Column], differs: Column) -> dict[str, Column]:
        """Suffix -> aggregate over rows in both tables; d: the deltas, differs: whether this column does."""
        return {}


class Numeric(Kind):
    """Delta, its size, and its share of b."""

    def difference(self, a: Column, b: Column, how: Settings) -> tuple[Column, Column]:
        """(a - b, what it is a share of)"""
        return (F.try_subtract(a, b) if how.overflow == "null" else a - b), b

    def deltas(self, a, b, how, struct=False):
        delta, base = self.difference(a, b, how)
        return {"delta": delta, "abs_delta": F.abs(delta), "rel_delta": F.try_divide(delta.cast("double"), base.cast("double"))}

    def stats(self, d, differs):
        size, share = d["abs_delta"].cast("double"), F.abs(d["rel_delta"])
        return {"max_abs": F.max(size), "max_rel": F.max(share), "avg_abs": F.avg(size), "sum_rel": F.sum(share)}


class Integer(Numeric):
    """Differences in 64 bits, whatever the column's width."""

    name, short = "INTEGER", "INT"

    def difference(self, a, b, how):
        return super().difference(a.cast("bigint"), b.cast("bigint"), how)

    def deltas(self, a, b, how, struct=False):
        found = super().deltas(a, b, how, struct)
        delta = found["delta"]
        minus = F.try_subtract(F.lit(0).cast("bigint"), delta) if how.overflow == "null" else -delta
        return found | {"abs_delta": F.when(delta < 0, minus).otherwise(delta)}


class Float(Numeric):
    name, short = "FLOAT", "FLT"

    def toleranced(self, column, how):
        t = how.tolerance
        return t.absolute_of(column) is not None or t.relative_of(column) is not None

    def within(self, a, b, column, how, struct=False):
        return tolerance.within(a, b, how.tolerance.absolute_of(column), how.tolerance.relative_of(column))


class Boolean(Numeric):
    name, short = "BOOLEAN", "BOOL"

    def difference(self, a, b, how):
        return a.cast("bigint") - b.cast("bigint"), b.cast("bigint")


class Timestamp(Numeric):
    """Microseconds, and their share of b's microseconds since 1970: here of timestamps without a time zone."""

    name, short = "TIMESTAMP", "TS"

    def difference(self, a, b, how):
        a, b = a.cast("timestamp_ntz"), b.cast("timestamp_ntz")
        return F.timestamp_diff("MICROSECOND", b, a), F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), b)


class Instant(Timestamp):
    """Timestamps with the session's time zone are instants: their differences don't depend on the zone."""

    def difference(self, a, b, how):
        return F.unix_micros(a) - F.unix_micros(b), F.unix_micros(b)


class Date(Numeric):
    """Days, and their share of b's days since 1970."""

    name, short = "DATE", "DATE"

    def difference(self, a, b, how):
        return F.datediff(a, b), F.unix_date(b)


class String(Kind):
    name, short = "STRING", "STR"

    def deltas(self, a, b, how, struct=False):
        same = self.equal(a, b, how, struct)
        return {"match": same, "mismatch": ~same}

    def stats(self, d, differs):
        return {"mismatches": F.count_if(differs)}


class Array(Kind):
    name, short = "ARRAY", "ARR"

    def equal(self, a, b, how, struct=False):
        return arrays.equal(a, b)

    def shown(self, a, struct=False):
        return arrays.canonical(a)

    def deltas(self, a, b, how, struct=False):
        return {"len_delta": arrays.length_difference(a, b), "mismatch": ~arrays.equal(a, b)}

    def stats(self, d, differs):
        size = F.abs(d["len_delta"])
        return {"mismatches": F.count_if(differs), "max_len_delta": F.max(size), "avg_len_delta": F.avg(size)}


class Sketch(Kind):
    def __init__(self, name: str, short: str, suffix: str):
        self.name, self.short, self.suffix = name, short, suffix

    def equal(self, a, b, how, struct=False):
        return sketches.equal(a, b, self.suffix, how.sketch_absolute, how.sketch_relative)

    def shown(self, a, struct=False):
        return sketches.median(a, self.suffix)

    def deltas(self, a, b, how, struct=False):
        return {"max_abs_value_diff": sketches.largest_difference(a, b, self.suffix), "mismatch": ~self.equal(a, b, how)}

    def stats(self, d, differs):
        size = d["max_abs_value_diff"]
        return {"mismatches": F.count_if(differs), "max_value_diff": F.max(size), "avg_value_diff": F.avg(size)}


class Geography(Kind):
    name, short = "GEOGRAPHY", "GEO"

    def equal(self, a, b, how, struct=False):
        return geo.equal(a, b, struct)

    def toleranced(self, column, how):
        return how.tolerance.absolute_of(column) is not None

    def within(self, a, b, column, how, struct=False):
        return geo.within(a, b, how.tolerance.absolute_of(column), struct)

    def shown(self, a, struct=False):
        return geo.text(a, struct)

    def deltas(self, a, b, how, struct=False):
        return {"distance_meters": geo.spheroid_distance(a, b, struct)}

    def stats(self, d, differs):
        return {"max_meters": F.max(d["distance_meters"]), "avg_meters": F.avg(d["distance_meters"])}


class Unsupported(Kind):
    name, short = "UNSUPPORTED", "-"


KINDS: dict[str, Kind] = {
    k.name: k for k in (
        Integer(),
        Float(),
        String(),
        Timestamp(),
        Date(),
        Boolean(),
        Geography(),
        Array(),
        Sketch("KLL_FLOAT64", "KLLf", "double"),
        Sketch("KLL_INT64", "KLLi", "bigint"),
        Unsupported(),
    )
}
#: Kinds for one of several types of a kind.
KINDS["TIMESTAMP timestamp"] = Instant()
SKETCHES = ("KLL_FLOAT64", "KLL_INT64")
