"""Rows of two tables side by side: one full outer join on the keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column as Expr
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import Settings
from ..sources.schema import Column
from .skew import dealt, hot_keys


def all_of(conditions: Sequence[Expr]) -> Expr:
    return reduce(lambda x, y: x & y, conditions, F.lit(True)) if conditions else F.lit(True)


def any_of(conditions: Sequence[Expr]) -> Expr:
    return reduce(lambda x, y: x | y, conditions) if conditions else F.lit(False)


def leaves(df: DataFrame, columns: Sequence[Column], prefix: str = "") -> DataFrame:
    """The columns, fields of structs included, under their aliases."""
    return df.select(*[F.col(c.path).alias(prefix + c.alias) for c in columns])


def spread(side: DataFrame, keys: Sequence[Column], name: str) -> DataFrame:
    """With a column "<name> spread": 0 where no key is null, else a hash of the row."""
    none = any_of([F.col(f"{name}__{k.alias}").isNull() for k in keys])
    return side.withColumn(f"{name} spread", F.when(none, F.xxhash64(*[F.col(f"`{c}`") for c in side.columns])).otherwise(F.lit(0).cast("long")))


def align(a: DataFrame, b: DataFrame, keys: Sequence[Column], values: Sequence[Column], hot_rows: int | None = None) -> DataFrame:
    """keys, in_a, in_b, and a__<column>, b__<column> for every value.

    Keys match by plain equality, so a null key matches nothing. A row is in a table if its first key there is not null.
    Rows with a null key only pass through the join; a part of the key made of their values deals them out over all tasks.
    hot_rows: keys with so many rows, or pairs of rows, are dealt out as well, at the cost of reading the keys before.
    """
    columns = [*keys, *values]
    left, right = spread(leaves(a, columns, "a__"), keys, "a"), spread(leaves(b, columns, "b__"), keys, "b")
    parts = [F.col(f"a__{k.alias}") == F.col(f"b__{k.alias}") for k in keys] + [F.col("a spread") == F.col("b spread")]
    if hot_rows is not None:
        hot = hot_keys(leaves(a, keys), leaves(b, keys), [k.alias for k in keys], hot_rows)
        left, right = (dealt(x, n, [f"{n}__{k.alias}" for k in keys], hot) for x, n in ((left, "a"), (right, "b")))
        parts.append(F.col("a part") == F.col("b part"))
    joined = left.join(right, all_of(parts), "full_outer")
    first = keys[0].alias
    if hot_rows is not None:  # a repeated row has its partner in another part
        alone = F.col(f"a__{first}").isNull() | F.col(f"b__{first}").isNull()
        joined = joined.where(~(alone & F.coalesce("a hot", "b hot")))
    merged = [F.coalesce(f"a__{k.alias}", f"b__{k.alias}").alias(k.alias) for k in keys]
    present = [F.col(f"{side}__{first}").isNotNull().alias(f"in_{side}") for side in "ab"]
    return joined.select(*merged, *present, *[F.col(f"{side}__{v.alias}") for v in values for side in "ab"])


class Pair:
    """The two sides of a column in an aligned row, and the expressions over them."""

    def __init__(self, column: Column, how: Settings):
        self.column, self.how, self.kind = column, how, column.strategy
        self.a, self.b = F.col(f"a__{column.alias}"), F.col(f"b__{column.alias}")

    @property
    def equal(self) -> Expr:
        return self.kind.equal(self.a, self.b, self.how, self.column.struct)

    @property
    def toleranced(self) -> bool:
        return self.kind.toleranced(self.column.name, self.how)

    @property
    def within(self) -> Expr:
        return self.kind.within(self.a, self.b, self.column.name, self.how, self.column.struct)

    @property
    def deltas(self) -> dict[str, Expr]:
        return self.kind.deltas(self.a, self.b, self.how, self.column.struct)

    @property
    def shown(self) -> tuple[Expr, Expr]:
        return self.kind.shown(self.a, self.column.struct), self.kind.shown(self.b, self.column.struct)

    @property
    def passes(self) -> Expr:
        """Within tolerance where there is one, else equal."""
        return self.within if self.toleranced else self.equal


def excusable(pairs: Sequence[Pair]) -> Expr | None:
    """Whether all columns of a row pass; None without a toleranced column, for then only equal rows do."""
    return all_of([p.passes for p in pairs]) if any(p.toleranced for p in pairs) else None
