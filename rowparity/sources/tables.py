"""Where tables come from and where results go: scans with predicates, partition predicates, writes with an expiry."""

from __future__ import annotations

import os
import re
import uuid
import warnings
from collections.abc import Mapping
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values.
SENTINEL_DATE = "1979-01-01"
EXPIRES_AT = "expires_at"
SPLIT_PREFIX = "DIFF_"
SPLIT_DATASET_VARIABLE = "ROWPARITY_DIFF_DATASET"
SPLIT_EXPIRY_HOURS = 168
FULL_NAME = re.compile(r"^[A-Za-z_][\w-]*(\.[A-Za-z_][\w-]*){1,2}$")
FORMATS = ("parquet", "orc", "json", "csv")


def open_table(spark: SparkSession, name: str) -> DataFrame:
    """A path ends in a known format or holds a slash (then it is Parquet); all else is a name of the catalog."""
    ending = name.rstrip("/").rsplit(".", 1)[-1].lower()
    if ending in FORMATS and ("/" in name or os.path.exists(name)):
        return spark.read.option("header", True).format(ending).load(name)
    return spark.read.parquet(name) if "/" in name else spark.table(name)


def filtered(df: DataFrame, predicate: str | None) -> DataFrame:
    """Before anything else, so that the predicate reaches the scan and prunes partitions."""
    return df.where(F.expr(predicate)) if predicate else df


def any_partition(column: str, sentinel: str = SENTINEL_DATE) -> Column:
    """A predicate on the partition column that keeps all but the sentinel's date; null partitions stay."""
    c = F.col(column)
    return c.isNull() | (F.to_date(c) != F.lit(sentinel).cast("date"))


def partition_columns(df: DataFrame) -> list[str]:
    """The columns that partition the files a frame reads, in their order: of the scan's own file index, so paths count too."""
    found: dict[str, None] = {}
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            found |= dict.fromkeys(leaf.relation().partitionSchema().fieldNames())
        elif leaf.getClass().getSimpleName() == "HiveTableRelation":
            cols = leaf.partitionCols()
            found |= dict.fromkeys(cols.apply(k).name() for k in range(cols.size()))
    return list(found)


def partition_column(spark: SparkSession, table: str) -> str | None:
    """The first partition column of a table by name or path; None if there is none or it cannot be told."""
    try:
        df = open_table(spark, table)
        return next((c for c in partition_columns(df) if c in df.columns), None)
    except Exception as e:  # no such table, or one that cannot be read: detection never fails
        warnings.warn(f"no partition column found for {table}: {type(e).__name__}", stacklevel=2)
        return None


def scan(spark: SparkSession, table: str, predicate: str | None = None, require_partition_filter: bool = False) -> DataFrame:
    """The user's predicate wins; else, where one is required, the detected partition column gets any_partition()."""
    df = open_table(spark, table)
    if predicate:
        return filtered(df, predicate)
    column = partition_column(spark, table) if require_partition_filter else None
    return df.where(any_partition(column)) if column else df


# --- sinks


MODES = ("replace", "if_not_exists", "error")
#: How long tables that a broken-off commit leaves behind may stay until purge_expired() drops them.
STAGED_HOURS = 24


def persist(df: DataFrame, table: str, mode: str = "replace", expiry_hours: float | None = None) -> int:
    """Write as a catalog table and return its number of rows. mode: replace, if_not_exists or error."""
    return commit({table: df}, mode, expiry_hours)[table]


def commit(frames: Mapping[str, DataFrame], mode: str = "replace", expiry_hours: float | None = None) -> dict[str, int]:
    """Write all of them as catalog tables, or none: table -> its number of rows.

    Every frame is written to a table of its own beside its target first. Only when all are there do targets change, by
    renaming, and a failure on the way renames back what has changed. A table to be replaced can be read until then, by
    the frames too. Between the renames of one table there is a moment without it.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    if not frames:
        return {}
    spark = next(iter(frames.values())).sparkSession
    there = {t for t in frames if spark.catalog.tableExists(t)}
    if mode == "error" and there:
        raise ValueError(f"the table already exists: {', '.join(sorted(there))}")
    new = {t: df for t, df in frames.items() if mode != "if_not_exists" or t not in there}
    tag = uuid.uuid4().hex[:12]
    staged, old = {t: f"{t}__new_{tag}" for t in new}, {t: f"{t}__old_{tag}" for t in new if t in there}
    counts = {}
    try:
        for t, df in new.items():
            df.write.mode("errorifexists").saveAsTable(staged[t])
            set_expiry(spark, staged[t], STAGED_HOURS)
            counts[t] = spark.table(staged[t]).count()
        swap(spark, staged, old)
    except BaseException:
        for name in staged.values():
            spark.sql(f"DROP TABLE IF EXISTS {quoted(name)}")
        raise
    for t in new:
        set_expiry(spark, t, expiry_hours)
    for name in old.values():
        spark.sql(f"DROP TABLE IF EXISTS {quoted(name)}")
    return {t: counts[t] if t in counts else spark.table(t).count() for t in frames}


def swap(spark: SparkSession, staged: Mapping[str, str], old: Mapping[str, str]) -> None:
    """Put every staged table in its target's place, whose former table gets the name in old; all, or back to before."""
    done: list[tuple[str, str]] = []
    try:
        for target, name in staged.items():
            for start, end in ([(target, old[target])] if target in old else []) + [(name, target)]:
                rename(spark, start, end)
                done.append((start, end))
    except BaseException:
        for start, end in reversed(done):
            rename(spark, end, start)
        raise


def rename(spark: SparkSession, start: str, end: str) -> None:
    spark.sql(f"ALTER TABLE {quoted(start)} RENAME TO {quoted(end)}")


def set_expiry(spark: SparkSession, table: str, hours: float | None) -> None:
    """When purge_expired() may drop the table; never, without hours."""
    if hours:
        at = datetime.now(timezone.utc) + timedelta(hours=hours)
        spark.sql(f"ALTER TABLE {quoted(table)} SET TBLPROPERTIES ('{EXPIRES_AT}' = '{at.isoformat()}')")
    else:
        spark.sql(f"ALTER TABLE {quoted(table)} UNSET TBLPROPERTIES IF EXISTS ('{EXPIRES_AT}')")


def quoted(table: str) -> str:
    return ".".join(f"`{p}`" for p in table.split("."))


def purge_expired(spark: SparkSession, database: str | None = None, now: datetime | None = None) -> list[str]:
    """Drop the tables whose expiry has passed; Spark has no expiry of its own."""
    now, dropped = now or datetime.now(timezone.utc), []
    for t in spark.catalog.listTables(database) if database else spark.catalog.listTables():
        if t.isTemporary:
            continue
        name = ".".join([*(t.namespace or []), t.name])
        at = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {quoted(name)}").collect()}.get(EXPIRES_AT)
        if at and datetime.fromisoformat(at) <= now:
            spark.sql(f"DROP TABLE {quoted(name)}")
            dropped.append(name)
    return dropped


def split_targets(
    table_a: str,
    table_b: str,
    name_a: str | None = None,
    name_b: str | None = None,
    mode: str = "error",
    environment: Mapping[str, str] = os.environ,
) -> tuple[str, str]:
    """The two output names of a split.

    Both are given, or neither: then they are DIFF_<table> in the database that the environment variable names. Names
    are qualified, differ from each other and from the tables, and may only be replaced if they begin with DIFF_.
    """
    if mode not in ("error", "replace"):
        raise ValueError("mode must be error or replace")
    if (name_a is None) != (name_b is None):
        raise ValueError("give both output tables or neither")
    if name_a is None or name_b is None:
        database = environment.get(SPLIT_DATASET_VARIABLE)
        if not database:
            raise ValueError(f"without output tables, {SPLIT_DATASET_VARIABLE} must name a database")
        name_a, name_b = (
            f"{database}.{SPLIT_PREFIX}{re.sub(r'[^0-9A-Za-z_]', '_', t.rstrip('/').rsplit('/', 1)[-1].rsplit('.', 1)[-1] if '/' not in t else t.rstrip('/').rsplit('/', 1)[-1].split('.')[0])}" for t in (table_a, table_b)
        )
        if name_a == name_b:
            name_a, name_b = name_a + "_a", name_b + "_b"
    for n in (name_a, name_b):
        if not FULL_NAME.match(n):
            raise ValueError(f"{n!r} is not a qualified table name")
        if mode == "replace" and not n.rsplit(".", 1)[-1].startswith(SPLIT_PREFIX):
            raise ValueError(f"only tables named {SPLIT_PREFIX}... may be replaced, not {n}")
    if len({name_a.lower(), name_b.lower(), table_a.lower(), table_b.lower()}) < len({table_a.lower(), table_b.lower()}) + 2:
        raise ValueError("the output tables must differ from each other and from the compared ones")
    return name_a, name_b
