from datetime import datetime, timedelta, timezone

import pytest

from rowparity.sources import tables


def test_any_partition_keeps_nulls_and_drops_the_sentinel(spark):
    df = spark.createDataFrame([("1979-01-01 05:00:00",), ("2020-01-01 00:00:00",), (None,)], "t string").selectExpr("cast(t as timestamp_ntz) t")
    assert df.where(tables.any_partition("t")).count() == 2


def test_partition_detection(spark):
    spark.sql("create or replace temp view v as select 1 as x")
    spark.createDataFrame([(1, "2020-01-01")], "id long, day string").write.partitionBy("day").mode("overwrite").saveAsTable("parted")
    assert tables.partition_column(spark, "parted") == "day"
    assert tables.partition_column(spark, "v") is None
    with pytest.warns(UserWarning):
        assert tables.partition_column(spark, "no.such.table_at_all") is None
    assert tables.scan(spark, "parted", None, True).count() == 1 and tables.scan(spark, "parted", "day > '2021'").count() == 0


def test_pushdown_reaches_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("id", "id * 2 as x", "id * 3 as y").write.parquet(str(tmp_path / "t.parquet"))
    plan = tables.scan(spark, str(tmp_path / "t.parquet"), "id > 5").select("x")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,5)" in plan and "y" not in plan.split("ReadSchema")[1]


def test_persist_and_expiry(spark):
    df = spark.range(3)
    assert tables.persist(df, "kept", expiry_hours=1) == 3
    assert tables.persist(spark.range(5), "kept", "if_not_exists") == 3
    assert tables.persist(spark.range(0), "kept", "replace", 1) == 0
    with pytest.raises(Exception, match="exists"):
        tables.persist(df, "kept", "error")
    with pytest.raises(ValueError):
        tables.persist(df, "kept", "other")
    assert not any("kept" in t for t in tables.purge_expired(spark))
    assert any("kept" in t for t in tables.purge_expired(spark, now=datetime.now(timezone.utc) + timedelta(hours=2)))
    assert not spark.catalog.tableExists("kept")


def test_split_names():
    env = {tables.SPLIT_DATASET_VARIABLE: "scratch"}
    assert tables.split_targets("db.x", "db.y", environment=env) == ("scratch.DIFF_x", "scratch.DIFF_y")
    assert tables.split_targets("d1.x", "d2.x", environment=env) == ("scratch.DIFF_x_a", "scratch.DIFF_x_b")
    assert tables.split_targets("/p/x.parquet", "/p/y.parquet", environment=env) == ("scratch.DIFF_x", "scratch.DIFF_y")
    assert tables.split_targets("db.x", "db.y", "s.a", "s.b") == ("s.a", "s.b")
    assert tables.split_targets("db.x", "db.y", "s.DIFF_a", "s.DIFF_b", "replace") == ("s.DIFF_a", "s.DIFF_b")
    bad = [("s.a", None, "error"), (None, None, "error"), ("a", "b", "error"), ("s.a", "s.a", "error"), ("db.x", "s.b", "error"), ("s.a", "s.b", "replace"), ("s.a", "s.b", "other")]
    for a, b, mode in bad:
        with pytest.raises(ValueError):
            tables.split_targets("db.x", "db.y", a, b, mode, environment={})
