"""An independent check: set differences of the columns that were found identical."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.schema import Column
from .align import leaves

#: Kinds whose equality is not the equality of their values.
NOT_BY_VALUE = ("GEOGRAPHY", "KLL_FLOAT64", "KLL_INT64")


def verify(a: DataFrame, b: DataFrame, keys: Sequence[Column], values: Sequence[Column], differing: Collection[str] = ()) -> DataFrame:
    """which (missing_in_a or missing_in_b), keys and columns of the distinct rows that only the other table has.

    Columns known to differ drop out, with the whole struct they are in; so do sketches and places. Arrays are sorted.
    """
    parents = {n.split(".")[0] for n in differing if "." in n}
    kept = [v for v in values if v.name not in differing and v.name.split(".")[0] not in parents and v.kind not in NOT_BY_VALUE]
    columns = [*keys, *kept]
    names = [f"`{c.alias}`" for c in columns]
    sides = []
    for here, df in (("b", a), ("a", b)):  # a row of a may be missing in b
        flat = leaves(df, columns).select(*[F.array_sort(n).alias(c.alias) if c.kind == "ARRAY" else F.col(n) for n, c in zip(names, columns)])
        sides.append(flat.select(*names, F.lit(f"missing_in_{here}").alias("which")))
    # one aggregate by the whole row: it is in one table only if all its copies say the same
    rows = sides[0].unionAll(sides[1]).groupBy(*names).agg(F.min("which").alias("which"), F.max("which").alias("__other"))
    only = rows.where(F.col("which") == F.col("__other")).select("which", *names)
    return only.orderBy(*[F.col(f"`{k.alias}`").asc_nulls_first() for k in keys], "which")
