"""Text reports of summaries, breakdowns and rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Row

from .functions.kinds import KINDS
from .plans.result import ColumnFound, Summary

WIDTH = 100
STATS = [
    ("max_abs", "max abs"),
    ("max_rel", "max rel"),
    ("avg_abs", "avg abs"),
    ("sum_rel", "sum rel"),
    ("mismatches", "mismatches"),
    ("max_len_delta", "max length delta"),
    ("avg_len_delta", "avg length delta"),
    ("max_value_diff", "max quantile diff"),
    ("avg_value_diff", "avg quantile diff"),
    ("max_meters", "max metres"),
    ("avg_meters", "avg metres"),
]


def number(value: float | int | None) -> str:
    """Whole numbers grouped by thousands; others with two decimals, or one in scientific notation if small or large."""
    if value is None:
        return "-"
    if isinstance(value, int):
        return f"{value:,}"
    return f"{value:.2f}" if 1e-3 <= abs(value) < 1e4 else f"{value:.1e}"


def percent(share: float | None) -> str:
    if share is None:
        return "-"
    p = 100 * share
    return "0%" if not p else f"{p:.1f}%" if p >= 10 else f"{p:.2f}%" if p >= 0.01 else f"{p:.1e}%"


def ordered(columns: Sequence[ColumnFound], sort: str) -> list[ColumnFound]:
    """alphabetical, or significance: by the sum of relative differences, largest first, none as 0."""
    if sort not in ("alphabetical", "significance"):
        raise ValueError(f"no such order: {sort}")
    return sorted(columns, key=lambda c: (-(c.stats.get("sum_rel") or 0) if sort == "significance" else 0, c.name))


def notices(s: Summary) -> list[str]:
    out = []
    for name, side in (("A", s.side_a), ("B", s.side_b)):
        if side.duplicate_keys:
            out.append(
                f"!! DUPLICATE KEYS in {name}: {side.duplicate_keys:,} keys in {side.duplicate_rows:,} rows, up to {side.max_multiplicity:,} times; "
                "the counts below are not reliable"
            )
        if side.null_key_rows:
            out.append(f"!! {side.null_key_rows:,} rows of {name} have a null in their key and match nothing")
    if s.aborted:
        out.append("!! STOPPED: more rows differ than the limit allows; statistics and tolerance were not computed")
    if s.excluded:
        out.append("!! NOT COMPARED: " + ", ".join(f"{n} ({t})" for n, t in sorted(map(tuple, s.excluded))))
    return out + [f"!  {w}" for w in s.warnings]


def tolerance_text(s: Summary) -> str:
    text = lambda values: "none" if not values else str(next(iter(values.values()))) if len(set(values.values())) == 1 else "by column"
    return f"tolerance: {text(s.absolute)} absolute, {text(s.relative)} relative" if s.absolute or s.relative else "no tolerance"


def row_lines(s: Summary) -> list[str]:
    out = [
        f"rows: {s.side_a.total_rows:,} in A, {s.side_b.total_rows:,} in B",
        f"matched: {s.rows_matched:,} | only in A: {s.rows_only_in_a:,} | only in B: {s.rows_only_in_b:,}",
    ]
    post = s.rows_in_both_diff_post_tolerance
    text = f"different: {s.rows_in_both_diff:,} before tolerance" if post is not None or s.aborted else f"different: {s.rows_in_both_diff:,}"
    return out + [text + (f", {post:,} after it" if post is not None else "") + f" | identical: {s.rows_identical:,}"]


def verdict(s: Summary) -> str:
    return " STOPPED " if s.aborted else " IDENTICAL " if s.identical else " DIFFERENCES FOUND "


def verbose(s: Summary, sort: str = "alphabetical") -> str:
    lines = [f"{s.table_a} (A) and {s.table_b} (B)", f"keys: {', '.join(s.keys)} | {tolerance_text(s)}"]
    lines += [f"filter on {n}: {f}" for n, f in (("A", s.filter_a), ("B", s.filter_b)) if f]
    lines += ["", *notices(s), "", "Rows", *("  " + x for x in row_lines(s)), "", "Columns"]
    same = sorted(c.name for c in s.columns if not c.diff_count)
    lines.append(f"  identical: {', '.join(same) or 'none'}")
    for c in ordered(s.differing, sort):
        lines.append(
            f"  {c.name} ({c.kind}): {c.diff_count:,} rows differ ({percent(s.diff_share(c))} of the matched)" + (
                f", {c.within:,} within tolerance, {c.outside:,} not" if c.within is not None else ""
            )
        )
        shown = [f"{label} {number(c.stats[key])}" for key, label in STATS if c.stats.get(key) is not None]
        lines += ["    " + ", ".join(shown)] if shown else []
    return "\n".join([*lines, "", f"{verdict(s):=^{WIDTH}}"])


def table(s: Summary, sort: str = "alphabetical") -> str:
    head = ["Column", "Type", "Diffs", "Diff%", "MaxAbs", "MaxRel", "AvgAbs"] + (["Outside", "Within"] if s.absolute or s.relative else []) + ["Status"]
    rows = []
    for c in ordered(s.differing, sort):
        largest = next((c.stats[k] for k in ("max_abs", "max_len_delta", "max_value_diff", "max_meters") if k in c.stats), None)
        mean = next((c.stats[k] for k in ("avg_abs", "avg_len_delta", "avg_value_diff", "avg_meters") if k in c.stats), None)
        cells = [
            c.name if len(c.name) <= 30 else c.name[:29] + "…",
            KINDS[c.kind].short,
            number(c.diff_count),
            percent(s.diff_share(c)),
            number(largest),
            number(c.stats.get("max_rel")),
            number(mean),
        ]
        cells += [number(c.outside), number(c.within)] if s.absolute or s.relative else []
        rows.append([*cells, "ABORT" if s.aborted else c.status])
    width = [max(len(r[i]) for r in [head, *rows]) for i in range(len(head))]
    line = lambda cells: "  ".join(x.ljust(w) if i < 2 else x.rjust(w) for i, (x, w) in enumerate(zip(cells, width)))
    same = sorted(c.name for c in s.columns if not c.diff_count)
    out = [f"{s.table_a} and {s.table_b}", f"keys: {', '.join(s.keys)} | {tolerance_text(s)}", *notices(s), *row_lines(s)]
    out += [f"identical columns: {', '.join(same)}"] if same else []
    return "\n".join([*out, *([line(head), "-" * len(line(head)), *map(line, rows)] if rows else []), f"{verdict(s):=^{WIDTH}}"])


FORMATS: dict[str, Callable[[Summary, str], str]] = {"verbose": verbose, "table": table}


def render(s: Summary, how: str = "verbose", sort: str = "alphabetical") -> str:
    if how not in FORMATS:
        raise ValueError(f"no such format: {how}; there are {', '.join(FORMATS)}")
    return FORMATS[how](s, sort)


def breakdown(dimension: str, rows: Sequence[Row], totals: Row) -> str:
    """Only buckets with differences."""
    lines = [f"differences by {dimension}"]
    for r in rows:
        if r["total"]:
            sizes = [f"max abs {number(r['max_abs_delta'])}, max rel {number(r['max_rel_delta'])}"] if "max_abs_delta" in r else []
            lines.append(
                f"  {r['dimension']}: " + " | ".join(
                    [f"only in A {r['only_in_a']:,}", f"only in B {r['only_in_b']:,}", f"in both {r['in_both_diff']:,}", *sizes]
                )
            )
    return "\n".join([*lines, f"  in all: only in A {totals['only_in_a']:,} | only in B {totals['only_in_b']:,} | in both {totals['in_both_diff']:,}"])


def rows_text(rows: Sequence[Row]) -> list[str]:
    """A line per row; floating-point numbers in full."""
    text = lambda v: repr(v) if isinstance(v, float) else str(v)
    return [" | ".join(f"{k}={text(v)}" for k, v in r.asDict().items()) for r in rows]
