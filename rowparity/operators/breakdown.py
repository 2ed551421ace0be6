"""Differences by the values of a dimension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import Numeric, Settings
from ..sources.schema import Column
from .align import Pair, align
from .rowdiff import diff, differing


def breakdown(
    a: DataFrame,
    b: DataFrame,
    keys: Sequence[Column],
    values: Sequence[Column],
    dimension: str,
    delta_column: str | None = None,
    limit: int | None = None,
    how: Settings = Settings(),
) -> DataFrame:
    """dimension, only_in_a, only_in_b, in_both_diff, total and, for a numeric delta column, max_abs_delta and max_rel_delta.

    dimension: a column of the diff (a key, in_a, a__col, ...), or a value column, of which A's value counts where it has
    one. A delta column that is unknown or not numeric is ignored.
    """
    aliases = {v.name: v.alias for v in values}
    if dimension in aliases:
        c = aliases[dimension]
        rows = differing(align(a, b, keys, values, how.hot_rows), [Pair(v, how) for v in values]).withColumn("dimension", F.coalesce(f"a__{c}", f"b__{c}"))
        measured = next((Pair(v, how) for v in values if v.name == delta_column and isinstance(v.strategy, Numeric)), None)
        deltas = measured.deltas if measured else {}
    else:
        rows = diff(a, b, keys, values, how)
        rows = rows.withColumn("dimension", F.col(dimension.replace(".", "__")))
        measured = next((v for v in values if v.name == delta_column and isinstance(v.strategy, Numeric)), None)
        deltas = {s: F.col(f"{measured.alias}__{s}") for s in ("abs_delta", "rel_delta")} if measured else {}
    in_a, in_b = F.col("in_a"), F.col("in_b")
    wanted = [
        F.count_if(in_a & ~in_b).alias("only_in_a"),
        F.count_if(in_b & ~in_a).alias("only_in_b"),
        F.count_if(in_a & in_b).alias("in_both_diff"),
        F.count("*").alias("total"),
    ]
    if deltas:
        wanted += [F.max(deltas["abs_delta"]).cast("double").alias("max_abs_delta"), F.max(F.abs(deltas["rel_delta"])).alias("max_rel_delta")]
    out = rows.groupBy("dimension").agg(*wanted).orderBy(F.col("dimension").asc_nulls_first())
    return out if limit is None else out.limit(limit)


def totals(buckets: DataFrame) -> DataFrame:
    """Sums over the buckets that were returned, so a limit also limits these."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return buckets.agg(*map(zero, ("only_in_a", "only_in_b", "in_both_diff", "total")))
