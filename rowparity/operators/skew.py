"""Keys with very many rows: found by a sketch, then dealt out over several parts of the full outer join.

A full outer join is not split at run time, so all rows of a key meet in one task. Here such a key gets parts: the rows
of the side that has more of them are dealt out, those of the other side go to every part. Where a key has rows on both
sides, every row has a partner in some part, and a row without one in its own part is dropped; where it has rows on one
side only, these are dealt out and no row is repeated. So the joined rows are those of the plain join, each once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column as Expr
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How many frequent keys a sketch gives, and how many it tracks to find them: both bound what is broadcast.
FREQUENT, TRACKED = 256, 1 << 14
#: Rows of a key, or pairs of its rows, that one part of the join should get.
HOT_ROWS = 1_000_000


def key_hash(df: DataFrame, keys: Sequence[str]) -> Expr:
    """A hash that keys have in common if they are equal: of whole numbers in 64 bits, of other numbers as doubles, -0.0 as 0.0."""

    def plain(name: str) -> Expr:
        kind = df.schema[name].dataType
        if isinstance(kind, T.IntegralType):
            return F.col(f"`{name}`").cast("bigint")
        return F.col(f"`{name}`").cast("double") + F.lit(0.0) if isinstance(kind, T.NumericType) else F.col(f"`{name}`")

    return F.xxhash64(*map(plain, keys))


def _known(keys: Sequence[Expr]) -> Expr:
    return reduce(lambda x, y: x & y, [k.isNotNull() for k in keys])


def candidates(side: DataFrame, keys: Sequence[str], least: int) -> DataFrame:
    """h: hashes of the keys that the sketch counts at least half as often as `least`: at most FREQUENT rows, without a shuffle of keys."""
    cols = [F.col(k) for k in keys]
    sketch = F.call_function("approx_top_k", key_hash(side, keys), F.lit(FREQUENT), F.lit(TRACKED))
    return side.where(_known(cols)).agg(sketch.alias("top")).select(F.explode("top").alias("one")).where(F.col("one.count") * 2 >= least).select(F.col("one.item").alias("h"))


def hot_keys(a: DataFrame, b: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """The keys, hot parts (how many) and hot side (which one is dealt out) of at most 2 * FREQUENT keys, counted exactly.

    a, b: the keys' columns alone, under the same names.
    """
    wanted = F.broadcast(candidates(a, keys, hot_rows).union(candidates(b, keys, hot_rows)).distinct())
    cols = [F.col(k) for k in keys]
    counted = []
    for name, df in (("a", a), ("b", b)):
        rows = df.where(_known(cols)).withColumn("h", key_hash(df, keys)).join(wanted, "h", "left_semi")
        counted.append(rows.groupBy(*keys).agg(*[(F.count("*") if name == n else F.lit(0).cast("long")).alias(f"n_{n}") for n in "ab"]))
    both = counted[0].unionByName(counted[1]).groupBy(*keys).agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"))
    n_a, n_b = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    more = F.greatest(n_a, n_b)
    parts = F.least(F.ceil(F.greatest(n_a + n_b, n_a * n_b) / hot_rows), F.ceil(more)).cast("int")
    found = both.where(F.greatest(more, n_a * n_b) >= hot_rows)
    side = F.when(n_a >= n_b, "a").otherwise("b")
    return found.select(*keys, parts.alias("hot parts"), side.alias("hot side"), ((n_a > 0) & (n_b > 0)).alias("hot both"))


def dealt(side: DataFrame, name: str, keys: Sequence[str], hot: DataFrame) -> DataFrame:
    """The side with "<name> part", 0 for keys that are not hot, and "<name> hot": whether the key is hot on both sides.

    keys: the columns of the side, in the order of the keys of `hot`.
    """
    known = hot.select(*[F.col(f"`{c}`").alias(f"hot {i}") for i, c in enumerate(hot.columns[: len(keys)])], "hot parts", "hot side", "hot both")
    on = reduce(lambda x, y: x & y, [F.col(k) == F.col(f"`hot {i}`") for i, k in enumerate(keys)])
    joined = side.join(F.broadcast(known), on, "left")
    parts = F.coalesce("`hot parts`", F.lit(1))
    # by the row and the partition it comes from: a repeated task deals alike, and copies of a row are not all in one part
    own = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in side.columns], F.spark_partition_id()), parts).cast("int")
    repeated = F.coalesce("`hot both`", F.lit(False)) & (F.col("`hot side`") != name)
    every = F.when(repeated, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(own))
    kept = [F.col(f"`{c}`") for c in side.columns]
    return joined.select(*kept, F.coalesce("`hot both`", F.lit(False)).alias(f"{name} hot"), F.explode(every).alias(f"{name} part"))
