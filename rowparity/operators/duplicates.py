"""Rows of a table and keys that are not unique."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.schema import Column
from .align import leaves


def key_counts(df: DataFrame, keys: Sequence[Column], side: str) -> DataFrame:
    """One row: total rows, keys that occur more than once, the rows that have them, the most for one key, rows with a null key."""
    names = [k.alias for k in keys]
    none = F.greatest(*[F.col(n).isNull() for n in names]) if len(names) > 1 else F.col(names[0]).isNull()
    groups = leaves(df, keys).groupBy(*names).agg(F.count("*").alias("n")).withColumn("none", none)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    again = F.col("n") > 1
    return groups.agg(
        zero(F.sum("n")).alias(f"total_rows_{side}"),
        F.count_if(again).alias(f"duplicate_keys_{side}"),
        zero(F.sum(F.when(again, F.col("n")))).alias(f"duplicate_rows_{side}"),
        zero(F.max(F.when(again, F.col("n")))).alias(f"max_multiplicity_{side}"),
        zero(F.sum(F.when(F.col("none"), F.col("n")))).alias(f"null_key_rows_{side}"),
    )


def duplicate_check(a: DataFrame, b: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """Both tables' counts as one row: a join of two single rows."""
    return key_counts(a, keys, "a").crossJoin(key_counts(b, keys, "b"))
