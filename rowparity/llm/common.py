"""What the operators of this package share: table access, checkpoint tables, connected components."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no checkpoint folder and driver and executors are one process, as in tests.
DEFAULT_CHECKPOINT_DIR = "/tmp/checkpoints"
#: The tables that this thread's open scratch() blocks have written, the innermost last: runs side by side keep theirs apart.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())
#: Spark's setting by which an execution's shuffle files go when it ends, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _cleaning = threading.Lock(), {"open": 0, "before": None}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not (spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or DEFAULT_CHECKPOINT_DIR).rstrip("/")


def new_path(spark: SparkSession) -> str:
    """A path for a table of this application in the shared folder."""
    return f"{checkpoint_dir(spark)}/tables/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared checkpoint folder and read it back: cuts the lineage, survives lost executors."""
    return saved_at(df)[0]


def saved_at(df: DataFrame) -> tuple[DataFrame, str]:
    """saved(), and the table's path."""
    path = new_path(df.sparkSession)
    with shuffles_deleted(df.sparkSession):
        df.write.parquet(path)
    for scope in _scopes.get():
        scope.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Executions that begin in this block leave no shuffle files; the setting is then as before. Threads may overlap."""
    with _lock:
        if not _cleaning["open"]:
            _cleaning["before"] = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
        _cleaning["open"] += 1
    try:
        yield
    finally:
        with _lock:
            _cleaning["open"] -= 1
            if not _cleaning["open"]:
                spark.conf.unset(CLEANUP) if _cleaning["before"] is None else spark.conf.set(CLEANUP, _cleaning["before"])


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Tables that are saved in this block are deleted at its end, but for those that are taken off the list it gives."""
    made: list[str] = []
    before = _scopes.get()
    _scopes.set((*before, made))
    try:
        yield made
    finally:
        _scopes.set(before)
        for path in made:
            dropped(spark, path)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a saved table that nothing will read again, through Spark's own file system for the path."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges(u, v) by alternating large-star and small-star steps.

    Returns (id, component) with the smallest reachable id, for every id that occurs in an edge. The minimum of a
    neighbourhood is an aggregate with map-side combine and a join, so a hub is never gathered in one group.
    """

    def step(pairs: DataFrame, large: bool) -> DataFrame:
        # pairs: undirected (u, v), u != v
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs.select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = both.join(least.hint("rebalance"), "u")  # apart from its aggregate, so that a hub's edges can be split over tasks
        if large:
            moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
        return moved.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def size(pairs: DataFrame) -> tuple:
        # order-free digest of the edge set
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 998_244_353)).first())

    spark = edges.sparkSession
    pairs, path = saved_at(edges.select("u", "v").where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = size(pairs)
    for _ in range(max_rounds):
        if not before[0]:
            break
        old = path
        pairs, path = saved_at(step(step(pairs, True), False))
        after = size(pairs)
        dropped(spark, old)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).union(pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
