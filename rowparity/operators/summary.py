"""Everything that is counted about two tables, in one pass over their full outer join."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column as Expr
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import Settings
from ..sources.schema import Column
from .align import Pair, align, all_of, any_of, excusable


@dataclass(frozen=True)
class Layers:
    """Aligned rows with a flag for each column and, for one, whether the row as a whole is within tolerance.

    rows: all that are not identical; pairs: the value columns; excused: None without toleranced columns.
    """

    rows: DataFrame
    pairs: list[Pair]
    excused: Expr | None

    @property
    def both(self) -> Expr:
        return F.col("in_a") & F.col("in_b")


def layers(a: DataFrame, b: DataFrame, keys: Sequence[Column], values: Sequence[Column], how: Settings = Settings()) -> Layers:
    pairs = [Pair(v, how) for v in values]
    flagged = align(a, b, keys, values, how.hot_rows).withColumns({f"{p.column.alias}__eq": p.equal for p in pairs} or {"__none": F.lit(None)})
    same = all_of([F.col(f"{p.column.alias}__eq") for p in pairs])
    rows = flagged.where(~(F.col("in_a") & F.col("in_b") & same))
    return Layers(rows, pairs, excusable(pairs))


def row_counts(found: Layers) -> dict[str, Expr]:
    both = found.both
    return {
        "rows_only_in_a": F.count_if(F.col("in_a") & ~F.col("in_b")),
        "rows_only_in_b": F.count_if(F.col("in_b") & ~F.col("in_a")),
        "rows_in_both_diff": F.count_if(both),
    } | {f"{p.column.alias}__diff_count": F.count_if(both & ~F.col(f"{p.column.alias}__eq")) for p in found.pairs}


def statistics(found: Layers, legacy: bool = False) -> dict[str, Expr]:
    """Statistics of every column over the rows in both tables that differ in any column.

    legacy: statistics over the rows that tolerance does not excuse, counts within and outside over all differing rows.
    """
    both = found.both
    counted = both & ~found.excused if legacy and found.excused is not None else both
    out: dict[str, Expr] = {}
    for p in found.pairs:
        name = p.column.alias
        if legacy and p.kind.name in ("ARRAY", "KLL_FLOAT64", "KLL_INT64"):
            continue
        equal = F.col(f"{name}__eq")
        deltas = {k: F.when(counted, d) for k, d in p.deltas.items()}
        out |= {f"{name}__{k}": x for k, x in p.kind.stats(deltas, counted & ~equal).items()}
        if p.toleranced:
            rows = both if legacy else both & ~equal
            out |= {f"{name}__within": F.count_if(rows & p.within), f"{name}__outside": F.count_if(rows & ~p.within)}
    if found.excused is not None:
        out["rows_in_both_diff_post_tolerance"] = F.count_if(both & ~found.excused)
    return out


def overflowed(found: Layers) -> Expr:
    """Rows of which a difference of whole numbers is beyond 64 bits, and so null."""
    lost = [p.a.isNotNull() & p.b.isNotNull() & p.deltas["delta"].isNull() for p in found.pairs if p.kind.name == "INTEGER" and p.how.overflow == "null"]
    return F.count_if(found.both & any_of(lost))


def summarize(found: Layers, legacy: bool = False, flags_only: bool = False, more: Mapping[str, Expr] | None = None) -> DataFrame:
    """One row. flags_only: what the breaker needs, without differences; more: further aggregates."""
    wanted = row_counts(found) | ({} if flags_only else statistics(found, legacy)) | (more or {})
    return found.rows.agg(*[x.alias(name) for name, x in wanted.items()])
