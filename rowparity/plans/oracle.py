"""The same comparisons as plain SQL for DuckDB, to hold the Spark results against."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

PROBES = (0.1, 0.25, 0.5, 0.75, 0.9)


@dataclass(frozen=True)
class Spec:
    """Two sides as SQL that both engines read ({table} stands for a table), and how to compare them."""

    a: str
    b: str
    keys: Sequence[str]
    kinds: dict[str, str]  # value column -> kind
    absolute: float | None = None
    relative: float | None = None
    column_absolute: dict[str, float] = field(default_factory=dict)
    column_relative: dict[str, float] = field(default_factory=dict)


def equal(kind: str, a: str, b: str) -> str:
    if kind == "ARRAY":
        return f"(list_sort({a}) is not distinct from list_sort({b}))"
    return f"({a} is not distinct from {b})"


def within(s: Spec, kind: str, a: str, b: str) -> str | None:
    """None for a column without tolerance. a: a__<column>."""
    absolute, relative = s.column_absolute.get(a[3:], s.absolute), s.column_relative.get(a[3:], s.relative)
    if kind != "FLOAT" or (absolute is None and relative is None):
        return None
    tests = [f"abs({a} - {b}) <= {absolute!r}"] if absolute is not None else []
    tests += [f"abs({a} - {b}) / nullif(greatest(abs({a}), abs({b})), 0) <= {relative!r}"] if relative is not None else []
    return f"(case when {a} is not null and {b} is not null then coalesce({' or '.join(tests)}, {equal(kind, a, b)}) else {a} is null and {b} is null end)"


def deltas(kind: str, a: str, b: str) -> dict[str, str]:
    if kind == "INTEGER":
        delta, base = f"({a}::bigint - {b}::bigint)", b
    elif kind == "FLOAT":
        delta, base = f"({a} - {b})", b
    elif kind == "BOOLEAN":
        delta, base = f"({a}::bigint - {b}::bigint)", f"{b}::bigint"
    elif kind == "TIMESTAMP":
        delta, base = f"date_diff('microsecond', {b}, {a})", f"epoch_us({b})"
    elif kind == "DATE":
        delta, base = f"date_diff('day', {b}, {a})::int", f"date_diff('day', date '1970-01-01', {b})"
    elif kind == "ARRAY":
        return {"len_delta": f"(len({a}) - len({b}))"}
    else:
        return {}
    return {"delta": delta, "abs_delta": f"abs({delta})", "rel_delta": f"({delta})::double / nullif(({base})::double, 0)"}


def joined(s: Spec) -> str:
    on = " and ".join(f"a.{k} = b.{k}" for k in s.keys)
    keys = ", ".join(f"coalesce(a.{k}, b.{k}) as {k}" for k in s.keys)
    values = "".join(f", a.{v} as a__{v}, b.{v} as b__{v}" for v in s.kinds)
    return (
        f"(select {keys}, a.{s.keys[0]} is not null as in_a, b.{s.keys[0]} is not null as in_b{values} from ({plain(s.a)}) a full outer join "
        f"({plain(s.b)}) b on {on})"
    )


def plain(sql: str) -> str:
    """SQL with the tables' own names."""
    return sql.replace("{", "").replace("}", "")


def flags(s: Spec) -> tuple[dict[str, str], str | None]:
    """Equality of each column, and whether tolerance excuses a row."""
    same = {v: equal(k, f"a__{v}", f"b__{v}") for v, k in s.kinds.items()}
    near = {v: within(s, k, f"a__{v}", f"b__{v}") for v, k in s.kinds.items()}
    return same, " and ".join(near[v] or same[v] for v in s.kinds) if any(near.values()) else None


def summary(s: Spec, legacy: bool = False, places: int = 6) -> str:
    same, excuse = flags(s)
    both = "(in_a and in_b)"
    counted = f"({both} and not ({excuse}))" if legacy and excuse else both
    out = [
        "count(*) filter (in_a and not in_b) as rows_only_in_a",
        "count(*) filter (in_b and not in_a) as rows_only_in_b",
        f"count(*) filter {both} as rows_in_both_diff",
    ]
    rounded = lambda x: f"round(({x})::double, {places})"
    for v, kind in s.kinds.items():
        a, b = f"a__{v}", f"b__{v}"
        out.append(f"count(*) filter ({both} and not {same[v]}) as {v}__diff_count")
        d = deltas(kind, a, b)
        f = f"filter ({counted})"
        if "rel_delta" in d:
            size, share = f"({d['abs_delta']})::double", f"abs({d['rel_delta']})"
            out += [
                f"{rounded(f'max({size}) {f}')} as {v}__max_abs",
                f"{rounded(f'max({share}) {f}')} as {v}__max_rel",
                f"{rounded(f'avg({size}) {f}')} as {v}__avg_abs",
                f"{rounded(f'sum({share}) {f}')} as {v}__sum_rel",
            ]
        elif kind == "STRING":
            out.append(f"count(*) filter ({counted} and not {same[v]}) as {v}__mismatches")
        elif kind == "ARRAY" and not legacy:
            size = f"abs({d['len_delta']})"
            out += [
                f"count(*) filter ({counted} and not {same[v]}) as {v}__mismatches",
                f"(max({size}) {f})::bigint as {v}__max_len_delta",
                f"{rounded(f'avg({size}) {f}')} as {v}__avg_len_delta",
            ]
        if near := within(s, kind, a, b):
            rows = both if legacy else f"{both} and not {same[v]}"
            out += [f"count(*) filter ({rows} and {near}) as {v}__within", f"count(*) filter ({rows} and not {near}) as {v}__outside"]
    if excuse:
        out.append(f"count(*) filter ({both} and not ({excuse})) as rows_in_both_diff_post_tolerance")
    every = " and ".join(same.values()) or "true"
    return f"select {', '.join(out)} from {joined(s)} where not (in_a and in_b and {every})"


def differing(s: Spec, columns: Sequence[str] | None = None, tolerant: bool = True) -> str:
    same, excuse = flags(s)
    some = " or ".join(f"not {x}" for v, x in same.items() if columns is None or v in columns) or "false"
    kept = f" and not (in_a and in_b and {excuse})" if excuse and tolerant else ""
    return f"{joined(s)} where (not (in_a and in_b) or {some}){kept}"


def diff(s: Spec, columns: Sequence[str] | None = None) -> str:
    out = [*s.keys, "in_a", "in_b"]
    for v, kind in s.kinds.items():
        if columns is not None and v not in columns:
            continue
        a, b = f"a__{v}", f"b__{v}"
        out += [a, b] + [f"{x} as {v}__{n}" for n, x in deltas(kind, a, b).items()]
        out += [f"{equal(kind, a, b)} as {v}__match"] if kind == "STRING" else []
        out += [f"{near} as {v}__within_tolerance"] if (near := within(s, kind, a, b)) else []
    return f"select {', '.join(out)} from {differing(s, columns)}"


def duplicates(s: Spec) -> str:
    keys = ", ".join(s.keys)
    none = " or ".join(f"{k} is null" for k in s.keys)
    side = lambda sql, n: f"(select coalesce(sum(n), 0)::bigint as total_rows_{n}, count(*) filter (n > 1) as duplicate_keys_{n}, coalesce(sum(n) filter (n > 1), 0)::bigint as duplicate_rows_{n}, coalesce(max(n) filter (n > 1), 0)::bigint as max_multiplicity_{n}, coalesce(sum(n) filter ({none}), 0)::bigint as null_key_rows_{n} from (select {keys}, count(*) as n from ({plain(sql)}) group by {keys}))"
    return f"select * from {side(s.a, 'a')} cross join {side(s.b, 'b')}"


def split(s: Spec, which: str) -> str:
    other = "b" if which == "a" else "a"
    same, excuse = flags(s)
    every = " and ".join(same.values()) or "true"
    wanted = f"in_{which}" + (f" and (not in_{other} or not ({excuse}))" if excuse else "")
    on = " and ".join(f"d.{k} = t.{k}" for k in s.keys)
    return (
        f"select t.* from ({plain(s.a if which == 'a' else s.b)}) t where exists (select 1 from {joined(s)} d where not (in_a and in_b and {every}) "
        f"and {wanted} and {on})"
    )


def breakdown(s: Spec, dimension: str, delta: str | None = None, limit: int | None = None) -> str:
    d = deltas(s.kinds[delta], f"a__{delta}", f"b__{delta}") if delta else {}
    more = f", max({d['abs_delta']})::double as max_abs_delta, max(abs({d['rel_delta']})) as max_rel_delta" if d else ""
    by = f"coalesce(a__{dimension}, b__{dimension})" if dimension in s.kinds else dimension
    return (
        f"select {by} as dimension, count(*) filter (in_a and not in_b) as only_in_a, count(*) filter (in_b and not in_a) as only_in_b, count(*) "
        f"filter (in_a and in_b) as in_both_diff, count(*) as total{more} from {differing(s)} group by 1 order by 1 nulls first" + (f" limit {limit}" if limit else "")
    )


def verify(s: Spec, differing_columns: Sequence[str] = ()) -> str:
    kept = ", ".join([*s.keys, *[f"list_sort({v}) as {v}" if k == "ARRAY" else v for v, k in s.kinds.items() if v not in differing_columns]])
    a, b = f"select {kept} from ({plain(s.a)})", f"select {kept} from ({plain(s.b)})"
    return f"select 'missing_in_a' as which, * from ({b} except {a}) union all select 'missing_in_b' as which, * from ({a} except {b})"
