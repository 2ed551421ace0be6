from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from rowparity import Comparison, Settings, Summary, Tolerance
from rowparity.operators import breakdown as breakdowns
from rowparity.operators.align import align
from rowparity.sources.schema import KeyColumnError


def compare(spark, schema, a, b, keys=("id",), **how):
    tol = how.pop("tolerance", Tolerance())
    return Comparison(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), list(keys), Settings(tol), **how)


def diff_ids(c, **how):
    return sorted(r["id"] for r in c.diff(**how).collect())


def test_nulls_and_one_sided_rows(spark):
    c = compare(spark, "id long, x int, s string", [(1, None, "a"), (2, 1, None), (3, 1, "x"), (4, 1, "y")], [(1, None, "a"), (2, 1, ""), (3, None, "x"), (5, 1, "y")])
    rows = {r["id"]: r for r in c.diff().collect()}
    assert set(rows) == {2, 3, 4, 5}
    assert (rows[4]["in_a"], rows[4]["in_b"], rows[5]["in_a"], rows[5]["in_b"]) == (True, False, False, True)
    assert rows[2]["s__match"] is False and rows[3]["x__delta"] is None
    s = c.summary()
    assert (s.rows_only_in_a, s.rows_only_in_b, s.rows_in_both_diff, s.rows_identical) == (1, 1, 2, 1)
    assert {x.name: x.diff_count for x in s.columns} == {"x": 1, "s": 1}
    assert not s.identical


def test_strings_are_compared_exactly(spark):
    c = compare(spark, "id long, s string", [(1, "a"), (2, "a"), (3, "a")], [(1, "A"), (2, "a "), (3, "a")])
    assert diff_ids(c) == [1, 2]


def test_composite_keys(spark):
    c = compare(spark, "id long, k string, v int", [(1, "a", 1), (1, "b", 2)], [(1, "a", 1), (1, "b", 3)], keys=("id", "k"))
    assert [(r["id"], r["k"], r["v__delta"]) for r in c.diff().collect()] == [(1, "b", -1)]


def test_small_float_differences(spark):
    a, b = [(1, 1.0000000001)], [(1, 1.0000000002)]
    assert diff_ids(compare(spark, "id long, f double", a, b)) == [1]
    assert diff_ids(compare(spark, "id long, f double", a, b, tolerance=Tolerance(1e-9))) == []


def test_tolerance_counts_and_post_tolerance_rows(spark):
    a = [(1, 1.0, 20.0), (2, 2.0, 20.0), (3, 3.0, 20.0)]
    b = [(1, 1.0 + 1e-12, 20.0), (2, 2.5, 20.0 + 1e-12), (3, 3.0 + 1e-12, 20.0)]
    s = compare(spark, "id long, a double, b double", a, b, tolerance=Tolerance(1e-9)).summary()
    by = {c.name: c for c in s.columns}
    assert (s.rows_in_both_diff, s.rows_in_both_diff_post_tolerance) == (3, 1)
    assert (by["a"].within, by["a"].outside, by["a"].status) == (2, 1, "NOK")
    assert (by["b"].within, by["b"].outside, by["b"].status) == (1, 0, "OK")
    assert by["a"].within + by["a"].outside == by["a"].diff_count


def test_tolerance_is_for_floats_only(spark):
    c = compare(spark, "id long, f double, i int", [(1, 1.0, 1), (2, 1.0, 1)], [(1, 1.1, 1), (2, 1.1, 2)], tolerance=Tolerance(1.0))
    assert diff_ids(c) == [2]
    assert diff_ids(compare(spark, "id long, f double, i int", [(1, 1.0, 1)], [(1, 1.1, 1)], tolerance=Tolerance(column_absolute={"i": 5.0}))) == [1]


def test_chosen_columns_and_tolerance(spark):
    c = compare(spark, "id long, i int, f double, name string", [(1, 1, 1.0, "a"), (2, 1, 1.0, "b"), (3, 1, 3.0, "c")], [(1, 1, 1.0 + 1e-13, "z"), (2, 2, 1.0, "b"), (3, 1, 3.5, "c")], tolerance=Tolerance(1e-9))
    rows = c.diff(["i", "f"])
    assert not any("name" in n for n in rows.columns)
    # the row whose chosen columns differ within tolerance stays only because another column of it differs
    assert {r["id"] for r in rows.collect()} == {1, 2, 3}
    assert c.diff([]).columns == ["id", "in_a", "in_b"]


def test_deltas_of_every_kind(spark):
    schema = "id long, b boolean, t timestamp_ntz, d date, m decimal(10,2), s string"
    a = [(1, True, datetime(2020, 1, 1, 0, 0, 1), date(2020, 1, 3), None, "x")]
    b = [(1, False, datetime(2020, 1, 1), date(2020, 1, 1), None, "y")]
    r = compare(spark, schema, a, b).diff().first()
    assert (r["b__delta"], r["b__rel_delta"]) == (1, None)
    assert r["t__delta"] == 1_000_000 and r["t__rel_delta"] == pytest.approx(1e6 / (1577836800 * 1e6))
    assert (r["d__delta"], r["d__rel_delta"]) == (2, pytest.approx(2 / 18262))
    assert r["m__delta"] is None and r["s__match"] is False


def test_overflow(spark):
    a, b = [(1, 2**63 - 1)], [(1, -1)]
    c = compare(spark, "id long, x long", a, b)
    with pytest.raises(Exception, match="ARITHMETIC_OVERFLOW"):
        c.diff().collect()
    c.settings = Settings(overflow="null")
    assert c.diff().first()["x__delta"] is None and c.summary().columns[0].diff_count == 1
    with pytest.raises(ValueError):
        Settings(overflow="wrap")


def test_numeric_stats_include_rows_where_the_column_is_equal(spark):
    s = compare(spark, "id long, x int, y int", [(1, 1, 1), (2, 5, 1)], [(1, 1, 2), (2, 3, 1)]).summary()
    x = next(c for c in s.columns if c.name == "x")
    assert (x.stats["max_abs"], x.stats["avg_abs"], x.stats["sum_rel"]) == (2.0, 1.0, pytest.approx(2 / 3))


def test_structs_and_null_structs(spark):
    schema = "id long, s struct<tag:string,inner:struct<x:double>>"
    a = [(1, None), (2, ("t", (1.0,))), (3, None), (4, ("t", (1.0,)))]
    b = [(1, None), (2, ("t", (2.0,))), (3, ("t", None)), (4, ("t", (1.0,)))]
    c = compare(spark, schema, a, b)
    assert diff_ids(c) == [2, 3]
    assert c.differing_columns() == ["s.tag", "s.inner.x"]


def test_arrays_as_multisets(spark):
    schema = "id long, a array<string>, b array<struct<n:string,m:int>>"
    a = [(1, ["x", "y"], None), (2, ["x", "x"], None), (3, None, None), (4, [None, "x"], None), (5, ["x"], [("p", 1), ("q", None)])]
    b = [(1, ["y", "x"], None), (2, ["x"], None), (3, [], None), (4, ["x", None], None), (5, ["x"], [("q", None), ("p", 1)])]
    c = compare(spark, schema, a, b)
    rows = {r["id"]: r for r in c.diff().collect()}
    assert set(rows) == {2, 3}
    assert (rows[2]["a__a"], rows[2]["b__a"], rows[2]["a__len_delta"]) == ('["x","x"]', '["x"]', 1)
    assert rows[3]["a__a"] == "[]"
    stats = c.summary().columns[0].stats
    assert (stats["mismatches"], stats["max_len_delta"]) == (2, 1)


def test_sketches(spark):
    data = spark.range(400).select((F.col("id") % 4).alias("id"), F.rand(1).alias("v"))
    sketch = lambda shift: data.groupBy("id").agg(F.expr(f"kll_sketch_agg_double(v + {shift} * (id % 2))").alias("k"))
    c = Comparison(sketch(0), sketch(3), ["id"], sketches=["k"])
    rows = c.diff().collect()
    assert sorted(r["id"] for r in rows) == [1, 3] and all(2.5 < r["k__max_abs_value_diff"] < 3.5 for r in rows)
    found = next(x for x in c.summary().columns)
    assert (found.kind, found.diff_count, found.stats["mismatches"]) == ("KLL_FLOAT64", 2, 2)
    nulls = sketch(0).withColumn("k", F.when(F.col("id") < 2, F.col("k")))
    assert sorted(r["id"] for r in Comparison(sketch(0), nulls, ["id"], sketches=["k"]).diff().collect()) == [2, 3]


def test_geography(spark):
    schema = "id long, p string"
    a = [(1, "POINT(-0.1278 51.5074)"), (2, "POINT(-0.1278 51.5074)"), (3, None), (4, "POINT(180 1)"), (5, "POINT(3 90)"), (6, None)]
    b = [(1, "POINT(2.3522 48.8566)"), (2, "POINT(-0.1279 51.5074)"), (3, "POINT(1 1)"), (4, "point ( -180 1)"), (5, "POINT(7 90)"), (6, None)]
    c = compare(spark, schema, a, b, geography=["p"])
    rows = {r["id"]: r["p__distance_meters"] for r in c.diff().collect()}
    assert set(rows) == {1, 2, 3}
    assert 340_000 < rows[1] < 350_000 and 0 < rows[2] < 20 and rows[3] is None
    near = compare(spark, schema, a, b, geography=["p"], tolerance=Tolerance(1000.0))
    assert diff_ids(near) == [1, 3]
    struct = compare(spark, "id long, p struct<lon:double,lat:double>", [(1, (0.0, 0.0))], [(1, (1.0, 0.0))], geography=["p"])
    assert struct.diff().first()["p__distance_meters"] == pytest.approx(111_319.5, rel=1e-4)


def test_null_and_duplicate_keys(spark):
    c = compare(spark, "id long, x int", [(None, 1), (1, 1), (1, 2), (2, 1)], [(None, 1), (1, 1), (2, 1)])
    s = c.summary()
    assert (s.side_a.total_rows, s.side_a.duplicate_keys, s.side_a.duplicate_rows, s.side_a.max_multiplicity, s.side_a.null_key_rows) == (4, 1, 2, 2, 1)
    assert (s.rows_only_in_a, s.rows_only_in_b) == (0, 0)
    assert c.count().first()[0] == 3  # rows with a null key match nothing
    assert sorted(r["x"] for r in c.split_side("a").collect()) == [1, 2]


def test_breaker(spark):
    c = compare(spark, "id long, x int", [(i, i) for i in range(10)], [(i, i + (i < 5)) for i in range(10)])
    stopped, passed = c.summary(breaker=0.4), c.summary(breaker=0.5)
    assert stopped.aborted and stopped.columns[0].diff_count == 5 and not stopped.columns[0].stats
    assert not passed.aborted and passed.columns[0].stats["max_abs"] == 1.0
    assert not c.summary().aborted


def test_split_with_tolerance(spark):
    c = compare(spark, "id long, f double", [(1, 1.0), (2, 2.0), (3, 3.0)], [(1, 1.0 + 1e-13), (2, 2.5), (4, 4.0)], tolerance=Tolerance(1e-9))
    assert sorted(r["id"] for r in c.split_side("a").collect()) == [2, 3]
    assert sorted(r["id"] for r in c.split_side("b").collect()) == [2, 4]
    assert "left_semi" in c.split_side("a")._jdf.queryExecution().optimizedPlan().toString().lower().replace("leftsemi", "left_semi")


def test_legacy_statistics(spark):
    a, b = [(1, 1.0, 1.0), (2, 1.0, 1.0), (3, 1.0, 1.0)], [(1, 1.0 + 1e-12, 1.0), (2, 2.0, 1.0), (3, 1.0, 3.0)]
    found = {c.name: c for c in compare(spark, "id long, a double, b double", a, b, tolerance=Tolerance(1e-9)).summary(legacy=True).columns}
    assert (found["a"].within, found["a"].outside) == (2, 1)  # over all differing rows, equal ones too
    assert found["a"].stats["avg_abs"] == pytest.approx(0.5)  # over the rows tolerance does not excuse


def test_breakdown(spark):
    c = compare(spark, "id long, day string, x int", [(1, "m", 1), (2, "m", 1), (3, "t", 1)], [(1, "m", 3), (3, "t", 1), (4, "w", 1)])
    rows = c.breakdown("day", "x")
    got = [(r["dimension"], r["only_in_a"], r["only_in_b"], r["in_both_diff"], r["max_abs_delta"]) for r in rows.collect()]
    assert got == [("m", 1, 0, 1, 2.0), ("w", 0, 1, 0, None)]
    assert breakdowns.totals(c.breakdown("day", limit=1)).first().asDict() == {"only_in_a": 1, "only_in_b": 0, "in_both_diff": 1, "total": 2}
    assert c.breakdown("in_a", "day").columns == ["dimension", "only_in_a", "only_in_b", "in_both_diff", "total"]


def test_verify(spark):
    c = compare(spark, "id long, x int, t array<int>, s struct<p:int,q:int>", [(1, 1, [1, 2], (1, 1)), (2, 1, [1], (1, 1))], [(1, 2, [2, 1], (1, 2)), (3, 1, [1], (1, 1))])
    assert [(r["which"], r["id"]) for r in c.verify().collect()] == [("missing_in_b", 2), ("missing_in_a", 3)]
    assert c.verify().columns == ["which", "id", "t"]


def test_no_value_columns(spark):
    c = compare(spark, "id long, m map<string,int>", [(1, {}), (2, {})], [(1, {}), (3, {})])
    s = c.summary()
    assert (s.rows_only_in_a, s.rows_only_in_b, s.rows_in_both_diff, s.excluded) == (1, 1, 0, [["m", "map<string,int>"]])


def test_empty_tables(spark):
    c = compare(spark, "id long, x int", [], [])
    assert c.summary().identical and c.diff().count() == 0 and c.breakdown("x").count() == 0 and c.verify().count() == 0


def test_summary_goes_through_json(spark):
    s = compare(spark, "id long, f double", [(1, 1.0)], [(1, 2.0)], tolerance=Tolerance(1e-9)).summary()
    assert Summary.from_json(s.to_json()) == s


def test_one_join_and_no_python(spark):
    c = compare(spark, "id long, f double, s string, a array<int>", [(1, 1.0, "x", [1])], [(1, 2.0, "y", [2])], tolerance=Tolerance(1e-9))
    plan = c.layers().rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1 and "Python" not in plan and "Cartesian" not in plan


def test_stream_batches(spark, tmp_path):
    from rowparity.streaming.batches import comparer

    spark.createDataFrame([(1, 1), (2, 5)], "id long, x int").write.parquet(str(tmp_path / "in"))
    expected = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "id long, x int")
    got: list[Summary] = []
    query = spark.readStream.schema("id long, x int").parquet(str(tmp_path / "in")).writeStream.foreachBatch(comparer(expected, ["id"], lambda n, s: got.append(s))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [(s.rows_in_both_diff, s.rows_only_in_b) for s in got] == [(1, 0)]


def test_small_integers_differ_without_overflow(spark):
    a = spark.sql("select 1 as k, 100Y as t, 30000S as s, 2000000000 as i")
    b = spark.sql("select 1 as k, -100Y as t, -30000S as s, -2000000000 as i")
    row = Comparison(a, b, ["k"]).diff().first()
    assert (row["t__delta"], row["s__delta"], row["i__abs_delta"]) == (200, 60000, 4000000000)


def test_the_largest_differences_are_null_on_request(spark):
    a, b = spark.sql("select 1 as k, -9223372036854775808L as v"), spark.sql("select 1 as k, 0L as v")
    row = Comparison(a, b, ["k"], Settings(overflow="null")).diff().first()
    assert (row["v__delta"], row["v__abs_delta"]) == (-(2**63), None)


def test_instants_differ_across_a_change_of_the_clocks(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        a, b = (spark.sql(f"select 1 as k, timestamp_seconds({s}) as v") for s in (1730611800, 1730615400))  # 05:30 and 06:30 UTC
        row = Comparison(a, b, ["k"]).diff().first()
        assert row["v__delta"] == -3_600_000_000 and row["v__rel_delta"] == -3600 / 1730615400
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


@pytest.mark.parametrize("name", ["in_a", "a__v", "v__delta"])
def test_keys_named_like_the_output_are_refused(spark, name):
    df = spark.createDataFrame([(1, 2)], f"{name} int, v int")
    with pytest.raises(KeyColumnError, match="rename"):
        Comparison(df, df, [name]).schema


def test_null_keys_are_dealt_out(spark):
    rows = spark.range(20_000).selectExpr("if(id % 2 = 0, null, id) as k", "id as v")
    c = Comparison(rows, rows, ["k"])
    joined = align(c.a, c.b, c.key_columns, c.values)
    sizes = [r["n"] for r in joined.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 30_000 and (len(sizes) == 1 or max(sizes) < 2 * sum(sizes) / len(sizes))
    assert joined.columns == ["k", "in_a", "in_b", "a__v", "b__v"]


def test_a_sketch_of_many_rows_answers_exactly(spark):
    from rowparity.functions import sketches

    values = {"a": [(i * 7919) % 10007 * 0.5 for i in range(10007)], "b": [float(i % 3) for i in range(5000)], None: [-float(i * i) for i in range(3001)], "c": [4.0, None, float("nan")], "d": [None], "e": [7.0] * 4000 + [9.0]}
    rows = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v double").repartition(7)
    for suffix in ("double", "bigint"):
        frame = rows if suffix == "double" else rows.where("not isnan(v) or v is null").selectExpr("k", "cast(v as bigint) as v")
        got = {r["k"]: r["q"] for r in sketches.exact(frame, ["k"], "v", suffix).select("k", sketches.quantiles(F.col("sketch"), suffix).alias("q")).collect()}
        for k, vs in values.items():
            known = sorted(v if suffix == "double" else int(v) for v in vs if v is not None and v == v)
            want = [known[-(-len(known) * round(20 * p) // 20) - 1] if known else None for p in sketches.PROBES]
            assert got[k] == want or (not known and got[k] is None)
        assert len(got) == len(values)


@pytest.mark.parametrize("name", ["kll_bigint", "kll_stats", "kll_compare"])
def test_sketches_of_800_rows_a_brand_equal_their_sql(spark, name):
    import duckdb

    from rowparity.plans import catalogue

    d = "/root/testdata/sf0.1"
    known = duckdb.connect()
    known.sql(f"create view part as select * from read_parquet('{d}/part.parquet')")
    want = known.sql(catalogue.ORACLE_SQL[name]).fetchall()
    assert sorted(map(str, map(tuple, catalogue.QUERIES[name](spark, d).collect()))) == sorted(map(str, want))
