"""KLL quantile sketches compared by the quantiles they answer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Where sketches are probed.
PROBES = (0.1, 0.25, 0.5, 0.75, 0.9)
MEDIAN = PROBES.index(0.5)
#: The probes as shares of so many.
SHARES = 20
#: Into how many parts a sketch splits its group where exact answers are sought.
PARTS = 100


def quantiles(sketch: Column, suffix: str) -> Column:
    """The quantiles at the probes, by one call; null for a null sketch, nulls for an empty one. suffix: double or bigint."""
    if suffix not in ("double", "bigint"):
        raise ValueError(f"no such sketch: {suffix}")
    count = F.call_function(f"kll_sketch_get_n_{suffix}", sketch)
    found = F.call_function(f"kll_sketch_get_quantile_{suffix}", sketch, F.array(*map(F.lit, PROBES)))
    empty = F.array(*[F.lit(None).cast(suffix)] * len(PROBES))
    return F.when(sketch.isNull(), F.lit(None)).when(count > 0, found).otherwise(empty)


def median(sketch: Column, suffix: str) -> Column:
    return F.get(quantiles(sketch, suffix), MEDIAN)


def equal(a: Column, b: Column, suffix: str, absolute: float, relative: float) -> Column:
    """Every probe is within the absolute or the relative tolerance; null quantiles agree with null ones only."""

    def near(x: Column, y: Column) -> Column:
        size = F.abs(x - y)
        ok = (size <= absolute) | F.coalesce(F.try_divide(size.cast("double"), F.greatest(F.abs(x), F.abs(y)).cast("double")) <= relative, F.lit(False))
        return F.when(x.isNotNull() & y.isNotNull(), ok).otherwise(x.isNull() & y.isNull())

    probes = F.forall(F.zip_with(quantiles(a, suffix), quantiles(b, suffix), near), lambda ok: ok)
    return F.when(a.isNotNull() & b.isNotNull(), probes).otherwise(a.isNull() & b.isNull())


def largest_difference(a: Column, b: Column, suffix: str) -> Column:
    """The largest difference between quantiles; null unless every probe has both."""
    sizes = F.zip_with(quantiles(a, suffix), quantiles(b, suffix), lambda x, y: F.abs(x - y).cast("double"))
    return F.when(F.forall(sizes, lambda s: s.isNotNull()), F.array_max(sizes))


def exact(rows: DataFrame, keys: Sequence[str], value: str, suffix: str) -> DataFrame:
    """keys, sketch: for each group a sketch that answers the probes exactly, however many rows the group has.

    A sketch of more rows than it keeps answers about right. So its quantiles only split the group's range of values into
    PARTS, the rows of a part are counted, and in the parts that the probes fall into the value of the wanted rank is
    looked up. The answers are sketched, each as often as the probes' shares tell, so that other quantiles are not in it.
    A part is one task's at most; nulls and NaN count as nothing, as in a sketch.
    """
    x = F.col(value).cast(suffix)
    known = rows.where(x.isNotNull() & ~F.isnan(x.cast("double"))).select(*keys, x.alias("x"))
    made = rows.groupBy(*keys).agg(F.call_function(f"kll_sketch_agg_{suffix}", x).alias("s"), F.count(F.when(~F.isnan(x.cast("double")), x)).alias("n"))
    at = F.array(*[F.lit(i / PARTS) for i in range(1, PARTS)])
    splits = made.where("n > 0").select(*keys, "n", F.call_function(f"kll_sketch_get_quantile_{suffix}", "s", at).alias("splits"))
    part = F.size(F.filter("splits", lambda q: q < F.col("x")))
    counted = _beside(known, splits, keys).groupBy(*keys, part.alias("part")).agg(F.count("*").alias("size"), F.first("n").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    upto = F.sum("size").over(Window.partitionBy(*keys).orderBy("part"))
    ranks = F.array(*[F.struct(F.lit(i).alias("probe"), F.expr(f"(n * {round(p * SHARES)} + {SHARES - 1}) div {SHARES}").alias("rank")) for i, p in enumerate(PROBES)])
    inside = lambda upto, size: F.filter("ranks", lambda r: (r["rank"] > F.col(upto) - F.col(size)) & (r["rank"] <= F.col(upto)))
    wanted = counted.select(*keys, "lo", "hi", "size", upto.alias("upto"), ranks.alias("ranks")).withColumn("ranks", inside("upto", "size")).where(F.size("ranks") > 0)
    # A sketch drawn again splits otherwise: from here on a part is its range, below which there are so many rows.
    bounds = wanted.select(*keys, "lo", "hi", (F.col("upto") - F.col("size")).alias("before"), "ranks")
    each = _beside(known, bounds, keys, also=F.col("x").between(F.col("lo"), F.col("hi"))).groupBy(*keys, "lo", "x").agg(F.count("*").alias("times"), F.first("before").alias("before"), F.first("ranks").alias("ranks"))
    last = F.col("before") + F.sum("times").over(Window.partitionBy(*keys, "lo").orderBy("x"))
    found = each.withColumn("last", last).select(*keys, "x", F.explode(inside("last", "times")).alias("at"))
    ends = [round(p * SHARES) for p in PROBES]
    often = F.array(*map(F.lit, [y - x for x, y in zip([0, *ends], [*ends[:-1], SHARES])]))
    repeated = found.select(*keys, "x", F.explode(F.array_repeat(F.lit(0), F.get(often, F.col("at.probe")))))
    answers = repeated.groupBy(*keys).agg(F.call_function(f"kll_sketch_agg_{suffix}", "x").alias("answers"))
    return _beside(made, answers, keys, "left").select(*keys, F.coalesce("answers", "s").alias("sketch"))


def _beside(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", also: Column | None = None) -> DataFrame:
    """left joined with right, which has other columns but for the keys; null keys are equal."""
    renamed = right.withColumnsRenamed({k: f"right {k}" for k in keys})
    same = F.lit(True) if also is None else also
    for k in keys:
        same &= left[k].eqNullSafe(renamed[f"right {k}"])
    return left.join(renamed, same, how).drop(*[f"right {k}" for k in keys])
