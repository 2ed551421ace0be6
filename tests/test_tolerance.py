import pytest
from pyspark.sql import functions as F

from rowparity.functions import tolerance as t
from rowparity.functions.tolerance import Tolerance


def test_parse_global_and_by_column():
    assert t.parse("1e-9", None) == Tolerance(1e-9, None)
    assert t.parse("a:1e-9, b:2", "0.5") == Tolerance(None, 0.5, {"a": 1e-9, "b": 2.0}, {})
    assert not t.parse(None, " ")
    assert t.parse("0").absolute == 0.0


@pytest.mark.parametrize("bad", ["x", "a:", "a:1:2", "1e-9,a:1", ":1"])
def test_parse_refuses(bad):
    with pytest.raises(ValueError):
        t.parse(bad)


def test_options_default_only_if_both_are_absent():
    assert t.from_options(None, None) == Tolerance(1e-15, 1e-12)
    assert t.from_options("1e-9", None) == Tolerance(1e-9, None)
    assert t.from_options("0", "0") == Tolerance()
    assert t.from_options("0.0", None) == Tolerance(0.0, None)


def test_lookup_and_merge():
    x = Tolerance(1.0, None, {"c": 2.0})
    assert (x.absolute_of("c"), x.absolute_of("d"), x.relative_of("c")) == (2.0, 1.0, None)
    m = x.merged(Tolerance(9.0, 0.5, {"c": 3.0}, {"d": 4.0}))
    assert m == Tolerance(1.0, 0.5, {"c": 3.0}, {"d": 4.0})


@pytest.mark.parametrize(
    ("a", "b", "absolute", "relative", "expected"),
    [
        (1.0, 1.5, 0.5, None, True),  # the bound counts
        (1.0, 1.51, 0.5, None, False),
        (100.0, 101.0, 0.1, 0.01, True),  # either suffices
        (100.0, 102.0, 0.1, 0.01, False),
        (None, None, 0.1, None, True),
        (None, 1.0, 0.1, None, False),
        (0.0, 0.0, None, 0.1, True),
        (1.0, 9.0, None, None, True),
        (float("inf"), float("inf"), 0.1, None, False),  # their difference is no number, so the test has an answer: no
    ],
)
def test_within(spark, a, b, absolute, relative, expected):
    df = spark.createDataFrame([(a, b)], "a double, b double")
    assert df.select(t.within(F.col("a"), F.col("b"), absolute, relative)).first()[0] is expected
