"""Plans and tasks: hot keys, filters before the shuffle, one shuffle for set differences, one action for a summary."""

import random

import pytest
from pyspark.sql import functions as F

from rowparity import Comparison, Settings
from rowparity.operators import skew, split
from rowparity.operators.align import align
from rowparity.plans.compare import Comparison as C
from rowparity.sources import tables


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def joined(spark, a, b, schema, keys, hot_rows):
    c = Comparison(spark.createDataFrame(a, schema).repartition(3), spark.createDataFrame(b, schema).repartition(3), keys)
    return align(c.a, c.b, c.key_columns, c.values, hot_rows)


@pytest.mark.parametrize("schema", ["id long, k string, v int", "id double, k string, v int"])
def test_hot_keys_give_the_rows_of_the_plain_join(spark, schema):
    draw = random.Random(3)
    number = float if "double" in schema else int
    key = lambda hot: number(hot) if draw.random() < 0.4 else None if draw.random() < 0.1 else number(draw.randrange(6)) if draw.random() < 0.4 else number(draw.randrange(300))
    a = [(key(1), draw.choice("xy"), draw.randrange(3)) for _ in range(500)] + [(number(-5), "x", 1)] * 90
    b = [(key(2), draw.choice("xy"), draw.randrange(3)) for _ in range(400)] + [(number(-6), "x", 1)] * 90 + [(number(1), "x", 7)]
    if "double" in schema:
        a, b = a + [(0.0, "z", 1)] * 60, b + [(-0.0, "z", 2)] * 3
    for keys in (["id"], ["id", "k"]):
        plain, dealt = (sorted(map(str, joined(spark, a, b, schema, keys, hot).collect())) for hot in (None, 40))
        assert plain == dealt


def test_no_task_gets_a_hot_key_alone(spark):
    """A third of A's rows and one of B's have one key: its joined rows are spread over the tasks."""
    a = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("id"), F.col("id").alias("v"))
    b = spark.range(30_000).where("id % 3 <> 0").union(spark.range(1).select(F.lit(-1).cast("long"))).select("id", F.lit(2).cast("long").alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        c = Comparison(a, b, ["id"])
        sizes = {}
        for hot in (None, 1000):
            rows = align(c.a, c.b, c.key_columns, c.values, hot).groupBy(F.spark_partition_id().alias("p")).count().collect()
            sizes[hot] = sorted(r["count"] for r in rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    median = lambda x: x[len(x) // 2]
    assert sizes[None][-1] > 2 * sizes[None][0] and sizes[1000][-1] <= 2 * median(sizes[1000]) and sum(sizes[None]) == sum(sizes[1000])


def test_hot_keys_are_few_and_counted_exactly(spark):
    a = spark.range(1000).select((F.col("id") % 500).alias("id")).union(spark.range(300).select(F.lit(7).cast("long")))
    found = {r["id"]: r for r in skew.hot_keys(a, spark.range(50), ["id"], 100).collect()}
    assert set(found) == {7} and found[7]["hot parts"] == 4 and found[7]["hot side"] == "a" and found[7]["hot both"]
    with pytest.raises(ValueError):
        Settings(overflow="wrap")


def test_split_drops_rows_before_the_shuffle(spark):
    a = spark.range(2000).select("id", (F.col("id") * 2).alias("v"), F.lit("more").alias("w"))
    b = a.withColumn("v", F.when(F.col("id") % 400 == 0, -1).otherwise(F.col("v")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = Comparison(a, b, ["id"]).split_side("a")
        assert sorted(r["id"] for r in rows.collect()) == [0, 400, 800, 1200, 1600]
        text = plan_of(rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = text.splitlines()
    depth = lambda i: len(lines[i]) - len(lines[i].lstrip(" :+-"))
    own = next(i for i, x in enumerate(lines) if "Exchange hashpartitioning(__own_id" in x)
    below = [x for i, x in enumerate(lines) if i > own and all(depth(k) > depth(own) for k in range(own + 1, i + 1))]
    assert any("BroadcastHashJoin" in x for x in below)


def test_the_key_filter_loses_nothing(spark):
    rows = spark.range(3000).select(F.col("id").alias("k"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("s"))
    for names in (["k"], ["s"], ["k", "s"]):
        wanted = rows.where("k % 7 = 3")
        left = split.may_match(rows, split._place(rows, names), split.key_filter(wanted, names))
        kept = {r["k"] for r in left.collect()}
        assert kept >= {k for k in range(3000) if k % 7 == 3} and len(kept) < 460
    empty = split.key_filter(rows.where("false"), ["k"])
    assert split.may_match(rows, split._place(rows, ["k"]), empty).count() == 0


def test_set_differences_take_one_shuffle(spark):
    a = spark.createDataFrame([(1, "x", [2, 1]), (1, "x", [2, 1]), (2, "y", None), (None, "n", [])], "id long, s string, xs array<int>")
    b = spark.createDataFrame([(1, "x", [1, 2]), (3, "y", None), (None, "n", None)], "id long, s string, xs array<int>")
    rows = Comparison(a, b, ["id"]).verify([])
    text = plan_of(rows)
    assert text.count("Exchange hashpartitioning") == 1 and text.count("Exchange rangepartitioning") == 1 and text.count("Scan") == 2
    assert sorted((r["which"], str(r["id"]), r["xs"]) for r in rows.collect() if r["id"]) == [("missing_in_a", "3", None), ("missing_in_b", "2", None)]
    assert sorted((r["which"], r["xs"]) for r in rows.collect() if r["id"] is None) == [("missing_in_a", None), ("missing_in_b", [])]


def test_a_summary_is_one_action(spark):
    a = spark.range(100).select("id", F.col("id").alias("v"))
    b = spark.range(5, 110).select("id", (F.col("id") + (F.col("id") % 10 == 0).cast("int")).alias("v"))
    c = Comparison(a, b, ["id"])
    c.summary()  # compiled
    store = spark._jsparkSession.sharedState().statusStore()
    for breaker in (1.0, 0.01):
        before = store.executionsCount()
        found = c.summary(breaker=breaker)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        assert store.executionsCount() - before == 1
        assert (found.rows_only_in_a, found.rows_only_in_b, found.rows_in_both_diff, found.aborted) == (5, 10, 9, breaker < 1)
    assert not found.columns[0].stats


def test_a_summary_warns_of_lost_differences(spark):
    a, b = ([(1, 2**63 - 1), (2, 5)], [(1, -1), (2, 6)])
    s = Comparison(spark.createDataFrame(a, "id long, x long"), spark.createDataFrame(b, "id long, x long"), ["id"]).summary()
    assert s.columns[0].diff_count == 2 and s.columns[0].stats["max_abs"] == 1.0 and any("1 rows" in w for w in s.warnings)


# --- writes


def rows_of(spark, table):
    return sorted(r[0] for r in spark.table(table).collect())


def failing(spark):
    return spark.range(5).select(F.when(F.col("id") == 3, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("id"))


def test_a_failed_write_leaves_all_tables_as_they_were(spark):
    tables.persist(spark.range(3), "kept_one")
    with pytest.raises(Exception, match="broken"):
        tables.persist(failing(spark), "kept_one")
    with pytest.raises(Exception, match="broken"):
        tables.commit({"kept_one": spark.range(9), "kept_two": failing(spark)})
    assert rows_of(spark, "kept_one") == [0, 1, 2] and not spark.catalog.tableExists("kept_two")
    assert not [t.name for t in spark.catalog.listTables() if "__new_" in t.name or "__old_" in t.name]


@pytest.mark.parametrize("fails_at", [1, 2, 3, 4])
def test_a_failed_rename_goes_back(spark, monkeypatch, fails_at):
    for name in ("swap_one", "swap_two"):
        tables.persist(spark.range(2), name)
    real, calls = tables.rename, []

    def broken(s, start, end):
        calls.append(start)
        if len(calls) == fails_at:
            raise RuntimeError("lost the catalog")
        real(s, start, end)

    monkeypatch.setattr(tables, "rename", broken)
    with pytest.raises(RuntimeError):
        tables.commit({n: spark.range(7) for n in ("swap_one", "swap_two")})
    assert rows_of(spark, "swap_one") == rows_of(spark, "swap_two") == [0, 1]
    monkeypatch.setattr(tables, "rename", real)
    assert tables.commit({n: spark.range(7) for n in ("swap_one", "swap_two")}) == {"swap_one": 7, "swap_two": 7}
    assert not [t.name for t in spark.catalog.listTables() if "__new_" in t.name or "__old_" in t.name]


def test_a_table_can_be_replaced_by_what_is_read_from_it(spark):
    tables.persist(spark.range(6), "self_read")
    assert tables.persist(spark.table("self_read").where("id > 2"), "self_read") == 3
    assert rows_of(spark, "self_read") == [3, 4, 5]


# --- partitions of paths, rows as they come


def test_partition_columns_of_paths(spark, tmp_path):
    path = str(tmp_path / "parted")
    spark.range(20).select("id", F.when(F.col("id") < 5, "1979-01-01").otherwise("2020-05-05").alias("day"), (F.col("id") % 2).alias("half")).write.partitionBy("day", "half").parquet(path)
    assert tables.partition_columns(spark.read.parquet(path)) == ["day", "half"] and tables.partition_column(spark, path) == "day"
    assert tables.scan(spark, path, None, True).count() == 15
    text = plan_of(tables.scan(spark, path, "day = '2020-05-05'"))
    assert "PartitionFilters" in text and "day" in text.split("PartitionFilters")[1]
    flat = str(tmp_path / "flat")
    spark.range(3).write.parquet(flat)
    assert tables.partition_column(spark, flat) is None


def test_rows_go_to_a_file_as_they_come(capsys):
    from pyspark.sql import Row

    from rowparity.cli import show

    held = []

    def rows():
        for i in range(5000):
            held.append(i)
            yield Row(id=i)
            held.pop()

    n, path = show(rows(), 3)
    assert n == 5000 and len(path.read_text().splitlines()) == 5000 and len(held) == 0
    assert capsys.readouterr().out.splitlines() == ["id=0", "id=1", "id=2"]
    path.unlink()
    assert show(iter([Row(id=1)]), 3)[1] is None


def test_breakdown_shows_a_limit_and_totals_of_all(spark, tmp_path, capsys):
    from rowparity.cli import main

    a, b = str(tmp_path / "a.parquet"), str(tmp_path / "b.parquet")
    spark.range(50).select("id", F.lit(1).alias("v")).write.parquet(a)
    spark.range(50).select("id", F.lit(2).alias("v")).write.parquet(b)
    main(["breakdown", "--table-a", a, "--table-b", b, "--keys", "id", "--dimension", "id", "--limit", "4"], spark)
    out = capsys.readouterr().out
    assert "the first 4 of 50 buckets" in out and "in both 50" in out
    assert C is Comparison
