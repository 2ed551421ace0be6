import pytest

from rowparity import ColumnFound, SideCounts, Summary, report
from rowparity.cli import main
from rowparity.plans.result import cache_path


def a_summary(**changes) -> Summary:
    columns = [ColumnFound("f", "FLOAT", "double", 3, True, 2, 1, {"max_abs": 0.5, "max_rel": 1e-5, "avg_abs": 0.1, "sum_rel": 2.0}), ColumnFound("a", "STRING", "string", 1, stats={"mismatches": 1}), ColumnFound("same", "INTEGER", "int")]
    base = dict(table_a="x", table_b="y", keys=["id"], side_a=SideCounts(10), side_b=SideCounts(9), rows_only_in_a=1, rows_only_in_b=0, rows_in_both_diff=4, rows_in_both_diff_post_tolerance=2, columns=columns, absolute={"f": 1e-9})
    return Summary(**(base | changes))


def test_numbers():
    assert [report.number(x) for x in (None, 12345, 0.0, 0.0005, 0.5, 12345.6)] == ["-", "12,345", "0.0e+00", "5.0e-04", "0.50", "1.2e+04"]
    assert [report.percent(x) for x in (None, 0.0, 0.25, 0.0123, 0.00001)] == ["-", "0%", "25.0%", "1.23%", "1.0e-03%"]


@pytest.mark.parametrize("how", ["verbose", "table"])
def test_reports_say_what_was_found(how):
    text = report.render(a_summary(), how)
    for part in ("x", "y", "id", "10", "same", "DIFFERENCES FOUND", "1e-09"):
        assert part in text
    text = report.render(a_summary(side_a=SideCounts(10, 2, 5, 3, 1), aborted=True, excluded=[["m", "map<string,int>"]]), how)
    for part in ("DUPLICATE KEYS in A", "null in their key", "STOPPED", "m (map<string,int>)"):
        assert part in text


def test_identical_and_order():
    same = a_summary(rows_only_in_a=0, rows_in_both_diff_post_tolerance=0)
    assert "IDENTICAL" in report.render(same)
    assert [c.name for c in report.ordered(a_summary().differing, "alphabetical")] == ["a", "f"]
    assert [c.name for c in report.ordered(a_summary().differing, "significance")] == ["f", "a"]
    with pytest.raises(ValueError):
        report.render(same, "other")
    with pytest.raises(ValueError):
        report.ordered([], "other")


def test_status():
    assert [c.status for c in a_summary().columns] == ["NOK", "NOK", "OK"]
    assert ColumnFound("f", "FLOAT", "double", 3, True, 3, 0).status == "OK"


def test_cache_path_ignores_the_order_of_keys():
    assert cache_path("a", "b", ["x", "y"]) == cache_path("a", "b", ["y", "x"]) != cache_path("b", "a", ["x", "y"])


@pytest.fixture
def sides(spark, tmp_path):
    a, b = str(tmp_path / "a.parquet"), str(tmp_path / "b.parquet")
    spark.createDataFrame([(1, 1.0, "x"), (2, 2.0, "y"), (3, 3.0, "z")], "id long, f double, s string").write.parquet(a)
    spark.createDataFrame([(1, 1.0, "x"), (2, 2.5, "y"), (4, 3.0, "z")], "id long, f double, s string").write.parquet(b)
    return ["--table-a", a, "--table-b", b, "--keys", "id"]


def test_verbs(spark, sides, tmp_path, capsys):
    out = lambda *args: (main(list(args), spark), capsys.readouterr().out)
    assert out("count", *sides) == (0, "3 differing rows\n")
    assert out("count", *sides, "--fail-on-diff")[0] == 1
    code, text = out("diff", *sides, "--only-diffs", "--max-display-rows", "1")
    assert code == 0 and "3 differing rows" in text and "a__f" in text and "a__s" not in text and "all 3 rows are in" in text
    assert "Join" in out("diff", *sides, "--dry-run")[1]
    assert "3 rows in cli_diff" in out("diff", *sides, "--output-table", "cli_diff", "--expiration-hours", "1")[1]
    path = str(tmp_path / "s.json")
    assert "DIFFERENCES FOUND" in out("summary", *sides, "--output-json", path, "--max-diff-pct", "50")[1]
    assert "MaxAbs" in out("format", path, "--format", "table")[1]
    assert "missing_in_a" in out("verify-query", *sides, "--json", path)[1]
    assert "only in A 1" in out("breakdown", *sides, "--dimension", "s", "--delta-col", "f")[1]


def test_summary_writes_the_split(spark, sides, tmp_path, capsys):
    spark.sql("create database if not exists scratch")
    main(["summary", *sides, "--diff-table-a", "scratch.DIFF_l", "--diff-table-b", "scratch.DIFF_r", "--diff-write-mode", "replace", "--output-json", str(tmp_path / "s.json")], spark)
    assert sorted(r["id"] for r in spark.table("scratch.DIFF_l").collect()) == [2, 3]
    assert sorted(r["id"] for r in spark.table("scratch.DIFF_r").collect()) == [2, 4]
    with pytest.raises(ValueError):
        main(["summary", *sides, "--legacy", "--diff-table-a", "scratch.l", "--diff-table-b", "scratch.r"], spark)
