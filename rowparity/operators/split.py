"""The rows of each source table that differ, as they are there."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column as Expr
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.schema import Column
from .align import all_of
from .skew import key_hash
from .summary import Layers

#: Bits of the filter of keys: a broadcast of at most 4 MB, however many keys there are.
FILTER_BITS = 1 << 25


def marked(found: Layers, keys: Sequence[Column]) -> DataFrame:
    """The keys of the differing rows, and whether they are wanted for a and for b.

    With tolerance, rows in both that it excuses are left out. Rows with a null key are no keys.
    """
    out = []
    for which, other in (("a", "b"), ("b", "a")):
        wanted = F.col(f"in_{which}")
        if found.excused is not None:
            wanted &= ~F.col(f"in_{other}") | ~found.excused
        out.append(wanted.alias(f"for_{which}"))
    return found.rows.select(*[F.col(k.alias).alias(f"__key_{k.alias}") for k in keys], *out).where("for_a or for_b")


def _place(df: DataFrame, names: Sequence[str]) -> Expr:
    return F.pmod(key_hash(df, names), F.lit(FILTER_BITS)) + 1


def key_filter(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """bucket, bits: a bitmap of the keys' hashes, in pieces."""
    at = _place(rows, names)
    return rows.select(
        F.bitmap_bucket_number(at).alias("__bucket"),
        F.bitmap_bit_position(at).alias("bit"),
    ).groupBy("__bucket").agg(F.bitmap_construct_agg("bit").alias("__bits"))


def may_match(source: DataFrame, hashed: Expr, bits: DataFrame) -> DataFrame:
    """The rows whose key's bit is set: none with a wanted key is lost, few others stay while the keys are few."""
    bit = F.bitmap_bit_position(hashed)
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked_bit = F.call_function("shiftright", byte, (bit % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return source.join(F.broadcast(bits), (F.bitmap_bucket_number(hashed) == F.col("__bucket")) & marked_bit, "left_semi")


def side(source: DataFrame, keys: Sequence[Column], which: str, wanted: DataFrame) -> DataFrame:
    """Rows of the source whose key is marked for it, joined with the distinct keys, so duplicate keys don't multiply.

    A filter of the keys, broadcast, drops most other rows before the source is shuffled. (A semi-join would be planned
    below the filter's join, which would then come too late.)
    """
    names = [f"__key_{k.alias}" for k in keys]
    mine = wanted.where(f"for_{which}").select(*[F.col(f"`{n}`") for n in names]).distinct()
    own = source.withColumns({f"__own_{k.alias}": F.col(k.path) for k in keys})
    own_names = [f"__own_{k.alias}" for k in keys]
    known = own.where(all_of([F.col(f"`{n}`").isNotNull() for n in own_names]))
    left = may_match(known, _place(known, own_names), key_filter(mine, names))
    on = all_of([F.col(f"`{o}`") == F.col(f"`{n}`") for o, n in zip(own_names, names)])
    return left.join(mine, on).select(*[F.col(f"`{c}`") for c in source.columns])
