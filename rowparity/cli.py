"""Command line: diff, count, summary, format, verify-query and breakdown. Differences do not change the exit code, unless asked."""

from __future__ import annotations

import argparse
import os
import tempfile
import time
from collections.abc import Iterator, Sequence
from pathlib import Path

from pyspark.sql import Row, SparkSession

from . import report
from .operators.breakdown import totals
from .operators.skew import HOT_ROWS
from .plans.compare import Comparison
from .plans.result import Summary, cache_path
from .sources import tables
from .sources.schema import split_names


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="rowparity", description="Compare two tables.")
    verbs = top.add_subparsers(dest="verb", required=True)
    common = argparse.ArgumentParser(add_help=False)
    for name in ("--table-a", "--table-b", "--keys"):
        common.add_argument(name, required=True)
    for name in ("--tolerance", "--rel-tolerance", "--partition-filter-a", "--partition-filter-b", "--kll-cols", "--kll-int-cols", "--geo-cols"):
        common.add_argument(name)
    common.add_argument("--kll-abs-tol", type=float, default=0.0)
    common.add_argument("--kll-rel-tol", type=float, default=0.05)
    common.add_argument("--detect-partitions", action="store_true")
    common.add_argument("--coerce-numeric", action="store_true")
    common.add_argument("--overflow", choices=["auto", "error", "null"], default="auto")
    common.add_argument("--hot-rows", type=int, default=HOT_ROWS, help="keys with so many rows are dealt out over several tasks; 0: none")
    common.add_argument("--fail-on-diff", action="store_true")
    shown = argparse.ArgumentParser(add_help=False)
    shown.add_argument("--format", choices=sorted(report.FORMATS), default="verbose")
    shown.add_argument("--sort-columns", choices=["alphabetical", "significance"], default="alphabetical")

    diff = verbs.add_parser("diff", parents=[common])
    diff.add_argument("--dry-run", action="store_true")
    diff.add_argument("--limit", type=int, default=100)
    diff.add_argument("--output-table")
    diff.add_argument("--write-mode", choices=["replace", "if_not_exists"], default="replace")
    diff.add_argument("--expiration-hours", type=int)
    diff.add_argument("--only-diffs", action="store_true")
    diff.add_argument("--max-display-rows", type=int, default=20)
    verbs.add_parser("count", parents=[common])
    summary = verbs.add_parser("summary", parents=[common, shown])
    summary.add_argument("--max-diff-pct", type=float, default=100.0)
    summary.add_argument("--legacy", action="store_true")
    summary.add_argument("--write-diffs", action="store_true")
    summary.add_argument("--diff-table-a")
    summary.add_argument("--diff-table-b")
    summary.add_argument("--diff-write-mode", choices=["error", "replace"], default="error")
    summary.add_argument("--diff-expiration-hours", type=float, default=tables.SPLIT_EXPIRY_HOURS)
    summary.add_argument("--output-json")
    form = verbs.add_parser("format", parents=[shown])
    form.add_argument("json")
    verify = verbs.add_parser("verify-query", parents=[common])
    verify.add_argument("--json")
    verify.add_argument("--limit", type=int, default=100)
    breakdown = verbs.add_parser("breakdown", parents=[common])
    breakdown.add_argument("--dimension", required=True)
    breakdown.add_argument("--delta-col")
    breakdown.add_argument("--limit", type=int, default=1000, help="buckets to show, the first by the dimension; the totals are of all")
    return top


def comparison(spark: SparkSession, o: argparse.Namespace) -> Comparison:
    return Comparison.of_tables(
        spark, o.table_a, o.table_b, split_names(o.keys) or [], o.tolerance, o.rel_tolerance, o.detect_partitions, o.kll_abs_tol, o.kll_rel_tol, o.partition_filter_a, o.partition_filter_b,
        sketches=split_names(o.kll_cols) or [], int_sketches=split_names(o.kll_int_cols) or [], geography=split_names(o.geo_cols) or [], coerce_numeric=o.coerce_numeric, overflow=o.overflow, hot_rows=o.hot_rows or None,
    )


def run_diff(c: Comparison, o: argparse.Namespace) -> bool:
    columns = None
    if o.only_diffs and not (columns := c.differing_columns()):
        print("no column differs")
        return False
    if o.dry_run:
        print(c.explain())
        return False
    if o.output_table:
        n = tables.persist(c.diff(columns), o.output_table, o.write_mode, o.expiration_hours)
        print(f"{n:,} rows in {o.output_table}")
        return n > 0
    rows = c.diff(columns, o.limit)
    n, path = show(rows.toLocalIterator(), o.max_display_rows)
    print(f"{n:,} differing rows (limit {o.limit:,})")
    if path:
        print(f"... all {n:,} rows are in {path}")
    return n > 0


def show(rows: Iterator[Row], most: int) -> tuple[int, Path | None]:
    """Print the first rows; if there are more, all go to a file as they come, so that only a partition's are held. (rows, the file)"""
    n, path, out = 0, None, None
    first: list[str] = []
    try:
        for row in rows:
            n += 1
            line = report.rows_text([row])[0]
            if n <= most:
                first.append(line)
                print(line)
                continue
            if out is None:
                handle, name = tempfile.mkstemp(prefix=f"rowparity_diff_{time.strftime('%Y%m%d_%H%M%S')}_", suffix=".txt")
                path, out = Path(name), os.fdopen(handle, "w")
                out.writelines(f"{x}\n" for x in first)
            out.write(line + "\n")
    finally:
        if out is not None:
            out.close()
    return n, path


def run_summary(c: Comparison, o: argparse.Namespace) -> bool:
    targets = tables.split_targets(
        o.table_a,
        o.table_b,
        o.diff_table_a,
        o.diff_table_b,
        o.diff_write_mode,
    ) if o.write_diffs or o.diff_table_a or o.diff_table_b else None
    found = c.summary(o.max_diff_pct / 100, o.legacy, targets, o.diff_write_mode, o.diff_expiration_hours)
    print(report.render(found, o.format, o.sort_columns))
    path = Path(o.output_json) if o.output_json else cache_path(o.table_a, o.table_b, c.keys)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(found.to_json())
    return not found.identical


def run_breakdown(c: Comparison, o: argparse.Namespace) -> bool:
    buckets = c.breakdown(o.dimension, o.delta_col).persist()
    try:
        all_ = totals(buckets).first()
        rows = buckets.limit(o.limit).collect()
        n = buckets.count()
    finally:
        buckets.unpersist()
    print(report.breakdown(o.dimension, rows, all_))
    if n > len(rows):
        print(f"  ... the first {len(rows):,} of {n:,} buckets (--limit)")
    return bool(all_["total"])


def run_verify(c: Comparison, o: argparse.Namespace) -> bool:
    differing = [x.name for x in Summary.from_json(Path(o.json).read_text()).differing] if o.json else None
    rows = c.verify(differing).limit(o.limit).collect()
    print(f"{len(rows):,} rows (limit {o.limit:,})", *report.rows_text(rows), sep="\n")
    return bool(rows)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    o = parser().parse_args(argv)
    if o.verb == "format":
        print(report.render(Summary.from_json(Path(o.json).read_text()), o.format, o.sort_columns))
        return 0
    spark = spark or SparkSession.builder.appName("rowparity").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    c = comparison(spark, o)
    for w in c.schema.warnings():
        print(f"!  {w}")
    if c.schema.excluded:
        print("!  not compared: " + ", ".join(f"{n} ({t})" for n, t in c.schema.excluded))
    if o.verb == "count":
        n = c.count().first()[0]
        print(f"{n:,} differing rows")
        found = n > 0
    else:
        found = {"diff": run_diff, "summary": run_summary, "breakdown": run_breakdown, "verify-query": run_verify}[o.verb](c, o)
    return int(found and o.fail_on_diff)


if __name__ == "__main__":
    raise SystemExit(main())
