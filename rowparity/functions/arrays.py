"""Arrays as multisets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def equal(a: Column, b: Column) -> Column:
    """Order does not count, multiplicity does; a null array is not an empty one."""
    return F.array_sort(a).eqNullSafe(F.array_sort(b))


def canonical(a: Column) -> Column:
    """JSON text with the elements in the order of their own JSON texts; a null array reads []."""
    text = lambda x: F.to_json(F.array(x), {"ignoreNullFields": "false"})
    one = F.transform(a, lambda x: F.substr(text(x), F.lit(2), F.length(text(x)) - 2))
    return F.coalesce(F.concat(F.lit("["), F.array_join(F.array_sort(one), ","), F.lit("]")), F.lit("[]"))


def length_difference(a: Column, b: Column) -> Column:
    return F.array_size(a) - F.array_size(b)
