"""A comparison of two tables: what to read, what to run, and what comes out.

    from rowparity.plans.compare import Comparison
    c = Comparison.of_tables(spark, "db.a", "db.b", ["id"], absolute="1e-9")
    c.summary(); c.diff(); c.breakdown("day"); c.verify()

All frames are lazy. A summary is one action: one full outer join, whose counts and statistics are a single row, beside
one aggregate of the keys of each side. The breaker is decided from that row. A split adds one narrow table of the keys
that differ, kept while both sides are written. (Counts taken on the way, as observed metrics, would be cheaper still,
but count rows of repeated stages twice, so executors could not be lost.)
"""

from __future__ import annotations

from collections.abc import Collection, Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.kinds import Settings
from ..functions.tolerance import Tolerance, from_options
from ..operators import breakdown as breakdowns
from ..operators import duplicates, rowdiff, split, summary, verify
from ..operators.skew import HOT_ROWS
from ..sources import tables
from ..sources.schema import Column, Intersection, alias_of, check_tolerances, describe, intersect
from .result import ColumnFound, SideCounts, Summary


@dataclass
class Comparison:
    a: DataFrame
    b: DataFrame
    keys: Sequence[str]
    settings: Settings = Settings()
    name_a: str = "a"
    name_b: str = "b"
    filter_a: str | None = None
    filter_b: str | None = None
    sketches: Collection[str] = ()
    int_sketches: Collection[str] = ()
    geography: Collection[str] = ()
    coerce_numeric: bool = False
    warnings: list[str] = field(default_factory=list)

    @classmethod
    def of_tables(
        cls,
        spark: SparkSession,
        a: str,
        b: str,
        keys: Sequence[str],
        absolute: str | None = None,
        relative: str | None = None,
        require_partition_filter: bool = False,
        sketch_absolute: float = 0.0,
        sketch_relative: float = 0.05,
        filter_a: str | None = None,
        filter_b: str | None = None,
        overflow: str = "auto",
        hot_rows: int | None = HOT_ROWS,
        **more,
    ) -> Comparison:
        """Tables by name or path, tolerances as on the command line; overflow and hot_rows as in Settings."""
        frames = [tables.scan(spark, t, f, require_partition_filter) for t, f in ((a, filter_a), (b, filter_b))]
        how = Settings(from_options(absolute, relative), sketch_absolute, sketch_relative, overflow, hot_rows)
        return cls(*frames, keys=list(keys), settings=how, name_a=a, name_b=b, filter_a=filter_a, filter_b=filter_b, **more)

    @cached_property
    def schema(self) -> Intersection:
        sides = []
        for df in (self.a, self.b):
            known = {f.name for f in df.schema.fields} | {c.name for c in describe(df.schema)}
            pick = lambda names, known=known: [n for n in names if n in known]
            sides.append(describe(df.schema, pick(self.sketches), pick(self.int_sketches), pick(self.geography)))
        for name in {*self.sketches, *self.int_sketches, *self.geography}:
            if not any(c.name == name for side in sides for c in side):
                raise ValueError(f"no such column: {name}")
        found = intersect(*sides, list(self.keys), self.coerce_numeric)
        if any(c.kind == "GEOGRAPHY" for c in found.columns):
            geo.allow(self.a.sparkSession)
        check_tolerances(found.columns, self.settings)
        return found

    @property
    def key_columns(self) -> list[Column]:
        known = {c.name: c for c in self.schema.columns}
        return [known[k] for k in self.keys]

    @property
    def values(self) -> list[Column]:
        return [c for c in self.schema.values if c.name not in self.keys]

    # --- frames

    def layers(self, settings: Settings | None = None) -> summary.Layers:
        return summary.layers(self.a, self.b, self.key_columns, self.values, settings or self.settings)

    def duplicate_check(self) -> DataFrame:
        return duplicates.duplicate_check(self.a, self.b, self.key_columns)

    def summary_frame(self, legacy: bool = False) -> DataFrame:
        """The summary's counts and statistics as one row."""
        return summary.summarize(self.layers(), legacy).crossJoin(self.duplicate_check())

    def diff(self, columns: Collection[str] | None = None, limit: int | None = None) -> DataFrame:
        rows = rowdiff.diff(self.a, self.b, self.key_columns, self.values, self.settings, columns)
        return rows if limit is None else rowdiff.first_rows(rows, self.key_columns, limit)

    def count(self) -> DataFrame:
        return rowdiff.count(self.a, self.b, self.key_columns, self.values, self.settings)

    def breakdown(self, dimension: str, delta_column: str | None = None, limit: int | None = None) -> DataFrame:
        return breakdowns.breakdown(self.a, self.b, self.key_columns, self.values, dimension, delta_column, limit, self.settings)

    def split_side(self, which: str, wanted: DataFrame | None = None) -> DataFrame:
        """wanted: the marked keys, if they are at hand."""
        keys = self.key_columns
        return split.side(self.a if which == "a" else self.b, keys, which, split.marked(self.layers(), keys) if wanted is None else wanted)

    def verify(self, differing: Collection[str] | None = None) -> DataFrame:
        """differing: by default, the columns that differ before tolerance, which costs a job."""
        names = self.differing_columns() if differing is None else differing
        return verify.verify(self.a, self.b, self.key_columns, self.values, names)

    def differing_counts(self) -> DataFrame:
        """column_name, diff_rows of the columns that differ before tolerance."""
        counts = F.array(*[F.struct(F.lit(v.name).alias("column_name"), F.col(f"{v.alias}__diff_count").alias("diff_rows")) for v in self.values])
        return summary.summarize(self.layers(), flags_only=True).select(F.inline(counts)).where("diff_rows > 0")

    # --- jobs

    def differing_columns(self) -> list[str]:
        row = summary.summarize(self.layers(), flags_only=True).first()
        return [v.name for v in self.values if row[f"{v.alias}__diff_count"]]

    def diff_of_differing(self, limit: int | None = None) -> DataFrame | None:
        """The diff of the columns that differ at all; None if none does."""
        names = self.differing_columns()
        return self.diff(names, limit) if names else None

    def summary(
        self,
        breaker: float = 1.0,
        legacy: bool = False,
        split_to: tuple[str, str] | None = None,
        split_mode: str = "error",
        split_expiry_hours: float = tables.SPLIT_EXPIRY_HOURS,
    ) -> Summary:
        """Run it, in one action. breaker: above this fraction of the larger table's rows differing, no statistics are given.

        split_to: tables to which each side's differing rows are written, in either case: both, or on a failure neither.
        """
        if legacy and split_to:
            raise ValueError("the legacy mode writes no split")
        how = self.settings
        found = self.layers(replace(how, overflow="null") if how.overflow == "auto" else how)
        counted = summary.summarize(found, legacy, more={"overflowed_rows": summary.overflowed(found)})
        row = counted.select(F.struct("*").alias("counts")).crossJoin(self.duplicate_check().select(F.struct("*").alias("sides"))).first()
        counts, sides = row["counts"].asDict(), row["sides"].asDict()
        aborted = counts["rows_in_both_diff"] > breaker * max(sides["total_rows_a"], sides["total_rows_b"])
        lost = counts.pop("overflowed_rows")
        noted = [] if aborted or not lost else [f"{lost:,} rows have a difference of whole numbers beyond 64 bits, which counts as null"]
        if split_to:
            wanted = split.marked(found, self.key_columns).persist()
            try:
                tables.commit({name: self.split_side(which, wanted) for which, name in zip("ab", split_to)}, split_mode, split_expiry_hours or None)
            finally:
                wanted.unpersist()
        return self._result(counts, sides, found, aborted, legacy, noted)

    def _result(self, got: dict, sides: dict, found: summary.Layers, aborted: bool, legacy: bool, noted: list[str]) -> Summary:
        columns = []
        for p in found.pairs:
            name = p.column.alias
            mine = {k.removeprefix(f"{name}__"): v for k, v in got.items() if k.startswith(f"{name}__") and f"{name}__" == alias_prefix(k, found)}
            columns.append(
                ColumnFound(
                    p.column.name,
                    p.column.kind,
                    p.column.type,
                    mine.pop("diff_count"),
                    p.toleranced,
                    *[None if aborted else x for x in (mine.pop("within", None), mine.pop("outside", None))],
                    {} if aborted else mine,
                )
            )
        side = lambda s: SideCounts(
            **{k: sides[f"{k}_{s}"] for k in ("total_rows", "duplicate_keys", "duplicate_rows", "max_multiplicity", "null_key_rows")}
        )
        t: Tolerance = self.settings.tolerance
        used = [p.column.name for p in found.pairs if p.toleranced]
        return Summary(
            self.name_a, self.name_b, list(self.keys), side("a"), side("b"), got["rows_only_in_a"], got["rows_only_in_b"], got["rows_in_both_diff"],
            None if aborted else got.get("rows_in_both_diff_post_tolerance"), columns, [list(x) for x in self.schema.excluded], [
                *self.warnings,
                *self.schema.warnings(),
                *noted,
            ], self.filter_a, self.filter_b,
            {n: v for n in used if (v := t.absolute_of(n)) is not None}, {n: v for n in used if (v := t.relative_of(n)) is not None}, aborted, legacy,
        )

    def explain(self) -> str:
        """The plan of the diff, for a dry run."""
        return self.diff()._jdf.queryExecution().toString()


def alias_prefix(name: str, found: summary.Layers) -> str:
    """Of the columns' prefixes that a name begins with the longest: a struct's field may begin like another column."""
    fits = [f"{p.column.alias}__" for p in found.pairs if name.startswith(f"{p.column.alias}__")]
    return max(fits, key=len, default=alias_of(name))
