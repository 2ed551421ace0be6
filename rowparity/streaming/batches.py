"""Comparing a stream with a table, one micro-batch at a time (an extension: the compared tables are otherwise batch)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from ..functions.kinds import Settings
from ..plans.compare import Comparison
from ..plans.result import Summary


def comparer(
    expected: DataFrame,
    keys: Sequence[str],
    sink: Callable[[int, Summary], None],
    settings: Settings = Settings(),
) -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch: compares every batch with the rows of expected that have its keys."""

    def compare(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # read for the keys and for the comparison
        try:
            wanted = expected.join(batch.select(*keys).distinct(), list(keys), "left_semi")
            sink(number, Comparison(batch, wanted, keys, settings, "batch", "expected").summary())
        finally:
            batch.unpersist()

    return compare
