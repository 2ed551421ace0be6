"""Queries on what a comparison writes, reads back and reports, and on hot keys; with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import report
from ..functions.kinds import KINDS, Settings
from ..functions.tolerance import Tolerance, from_options, parse
from ..operators import summary
from ..sources import tables
from . import oracle
from .compare import Comparison
from .oracle import Spec
from .result import Summary

Query = Callable[[SparkSession, str], DataFrame]
#: How long the tables of these queries stay until purge_expired() drops them.
HOURS = 1


def name_of_table() -> str:
    return f"rowparity_query_{uuid.uuid4().hex[:12]}"


def persisted_diff(c: Comparison) -> DataFrame:
    """A diff written as a table, replaced once, and read back; a second write of mode if_not_exists changes nothing."""
    name = name_of_table()
    for columns, mode in (([], "error"), (None, "replace"), ([], "if_not_exists")):
        tables.persist(c.diff(columns), name, mode, HOURS)
    return c.a.sparkSession.table(name)


def split_written(c: Comparison) -> DataFrame:
    """Both sides of a split, written by a summary and read back: which, then the keys."""
    names = name_of_table(), name_of_table()
    c.summary(split_to=names, split_expiry_hours=HOURS)
    sides = [c.a.sparkSession.table(n).select(F.lit(which).alias("which"), *c.keys) for which, n in zip("ab", names)]
    return sides[0].union(sides[1])


def split_written_sql(s: Spec) -> str:
    side = lambda which: f"select '{which}' as which, {', '.join(s.keys)} from ({oracle.split(s, which)})"
    return f"{side('a')} union all {side('b')}"


def partition_detect(spark: SparkSession, d: str) -> DataFrame:
    """Lines in a folder partitioned by their flag: the column is found from the folder, and its sentinel left out of a side."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select(
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        F.date_trunc("year", "l_shipdate").cast("date").alias("year"),
    )
    root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    path = f"{root}/{name_of_table()}"
    lines.write.partitionBy("year").parquet(path)
    column = tables.partition_column(spark, path)
    a = tables.scan(spark, path).where(tables.any_partition(column, "1995-01-01"))
    c = Comparison(a, lines.where("year <> date'1996-01-01'"), ["l_orderkey", "l_linenumber"])
    return summary.summarize(c.layers(), flags_only=True).select(
        F.lit(column).alias("partition_column"),
        "rows_only_in_a",
        "rows_only_in_b",
        "rows_in_both_diff",
    )


_YEARS = "select l_orderkey, l_linenumber, l_quantity, cast(date_trunc('year', l_shipdate) as date) as year from {lineitem} where year(l_shipdate) <> "
PARTED = Spec(_YEARS + "1995", _YEARS + "1996", ["l_orderkey", "l_linenumber"], {"l_quantity": "FLOAT", "year": "DATE"})
PARTITION_SQL = f"select 'year' as partition_column, rows_only_in_a, rows_only_in_b, rows_in_both_diff from ({oracle.summary(PARTED)})"

#: Options as on the command line, by name; the last is one set merged with another.
OPTIONS = {
    "defaults": from_options(None, None),
    "off": from_options("0", "1e-3"),
    "one": from_options("2", None),
    "columns": parse("price:2,weight:0.3", "1e-3"),
    "merged": parse("price:2,weight:0.3", "1e-3").merged(parse("0.5", "weight:0.05")),
}


def with_options(s: Spec, t: Tolerance) -> Spec:
    return Spec(s.a, s.b, s.keys, s.kinds, t.absolute, t.relative, dict(t.column_absolute), dict(t.column_relative))


def _counts(s: Spec) -> list[str]:
    return ["rows_in_both_diff", "rows_in_both_diff_post_tolerance", *[f"{v}__{n}" for v in s.kinds for n in ("within", "outside")]]


def tolerances_applied(s: Spec, sides: Callable[[SparkSession, str], tuple[DataFrame, DataFrame]]) -> Query:
    """What each set of options leaves of the same two tables."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        a, b = sides(spark, d)
        rows = [summary.summarize(Comparison(a, b, list(s.keys), Settings(t)).layers()).select(F.lit(name).alias("options"), *_counts(s)) for name, t in OPTIONS.items()]
        out = rows[0]
        for more in rows[1:]:
            out = out.unionByName(more)
        return out

    return query


def tolerances_sql(s: Spec) -> str:
    return (
        " union all ".join(f"select '{name}' as options, {', '.join(_counts(s))} from ({oracle.summary(with_options(s, t))})" for name, t in OPTIONS.items())
    )


def report_cells(c: Comparison) -> DataFrame:
    """The table report of a summary that went through JSON, cell by cell."""
    found = Summary.from_json(c.summary().to_json())
    lines = [x.split() for x in report.render(found, "table", "significance").splitlines()]
    at = next(i for i, x in enumerate(lines) if x[:2] == ["Column", "Type"])
    rows = [(x[0], x[1], x[2], x[-3], x[-2], x[-1], k + 1) for k, x in enumerate(lines[at + 2 : at + 2 + len(found.differing)])]
    return c.a.sparkSession.createDataFrame(rows, "column_name string, type string, diffs string, outside string, within string, status string, place int")


def report_sql(s: Spec) -> str:
    near = lambda v: s.kinds[v] == "FLOAT"
    text = lambda x: f"format('{{:,}}', {x})"
    rows = " union all ".join(
        f"select '{v}' as column_name, '{KINDS[k].short}' as type, {v}__diff_count as n, "
        f"{f'coalesce({v}__sum_rel, 0)' if oracle.deltas(k, 'a', 'b').get('rel_delta') else '0'} as weight, "
        + (f"{text(f'{v}__outside')} as outside, {text(f'{v}__within')} as within, case when {v}__outside > 0 then 'NOK' else 'OK' end as status" if near(v) else "'-' as outside, '-' as within, 'NOK' as status")
        + f" from found where {v}__diff_count > 0"
        for v, k in s.kinds.items()
    )
    return f"""with found as ({oracle.summary(s)})
select column_name, type, {text("n")} as diffs, outside, within, status, row_number() over (order by weight desc, column_name)::int as place from ({rows})"""


#: A third of A's rows, and one of B's, have one key; another key has a sixth of B's rows and none of A's.
HOT = Spec(
    "select case when l_orderkey % 3 = 0 then -7 else l_orderkey * 10 + l_linenumber end as k, l_quantity, l_returnflag from {lineitem}",
    """select l_orderkey * 10 + l_linenumber as k, case when l_orderkey % 5 = 0 then l_quantity + 1 else l_quantity end as l_quantity, l_returnflag
    from {lineitem} where l_orderkey % 3 <> 0 union all select -7, 17.0, 'N' union all select -8, l_quantity, l_returnflag from {lineitem} where l_orderkey % 6 = 0""",
    ["k"],
    {"l_quantity": "FLOAT", "l_returnflag": "STRING"},
)
HOT_ROWS = 500
