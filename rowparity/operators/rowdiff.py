"""The rows that differ, with both values and their differences."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import Settings
from ..sources.schema import Column
from .align import Pair, align, any_of, excusable


def differing(aligned: DataFrame, pairs: Sequence[Pair], columns: Collection[str] | None = None, use_tolerance: bool = True) -> DataFrame:
    """Aligned rows that are in one table only or differ in one of the columns (all, if None).

    With tolerance, a row in both goes if all its columns, chosen or not, are within tolerance or equal.
    """
    chosen = [p for p in pairs if columns is None or p.column.name in columns]
    both = F.col("in_a") & F.col("in_b")
    rows = aligned.where(~both | any_of([~p.equal for p in chosen]))
    excuse = excusable(pairs) if use_tolerance else None
    return rows if excuse is None else rows.where(~(both & excuse))


def diff(
    a: DataFrame,
    b: DataFrame,
    keys: Sequence[Column],
    values: Sequence[Column],
    how: Settings = Settings(),
    columns: Collection[str] | None = None,
) -> DataFrame:
    """keys, in_a, in_b, then for every chosen column a__, b__, its differences and, with a tolerance, __within_tolerance."""
    pairs = [Pair(v, how) for v in values]
    rows = differing(align(a, b, keys, values, how.hot_rows), pairs, columns)
    out = [F.col(k.alias) for k in keys] + [F.col("in_a"), F.col("in_b")]
    for p in pairs:
        if columns is not None and p.column.name not in columns:
            continue
        name = p.column.alias
        out += [x.alias(f"{side}__{name}") for side, x in zip("ab", p.shown)]
        out += [x.alias(f"{name}__{suffix}") for suffix, x in p.deltas.items() if suffix != "mismatch" or p.kind.name != "STRING"]
        if p.toleranced:
            out.append(p.within.alias(f"{name}__within_tolerance"))
    return rows.select(*out)


def first_rows(rows: DataFrame, keys: Sequence[Column], n: int) -> DataFrame:
    return rows.orderBy(*[F.col(k.alias).asc_nulls_first() for k in keys]).limit(n)


def count(a: DataFrame, b: DataFrame, keys: Sequence[Column], values: Sequence[Column], how: Settings = Settings()) -> DataFrame:
    """One row: diff_rows."""
    return differing(align(a, b, keys, values, how.hot_rows), [Pair(v, how) for v in values]).agg(F.count("*").alias("diff_rows"))
