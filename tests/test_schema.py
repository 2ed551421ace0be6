import pytest
from pyspark.sql import types as T

from rowparity import KeyColumnError, Settings, Tolerance, describe, intersect
from rowparity.sources.schema import by_kind, check_tolerances, split_names


def schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


def kinds(text: str, **how) -> dict[str, str]:
    return {c.name: c.kind for c in describe(schema(text), **how)}


def test_every_type_has_a_kind():
    found = kinds("i int, l bigint, f float, d decimal(9,2), s string, t timestamp, n timestamp_ntz, y date, b boolean, x binary, m map<string,int>, v variant")
    assert found == {"i": "INTEGER", "l": "INTEGER", "f": "FLOAT", "d": "FLOAT", "s": "STRING", "t": "TIMESTAMP", "n": "TIMESTAMP", "y": "DATE", "b": "BOOLEAN", "x": "UNSUPPORTED", "m": "UNSUPPORTED", "v": "UNSUPPORTED"}


def test_structs_flatten_and_arrays_stay():
    found = kinds("id int, s struct<tag:string,inner:struct<x:double,y:double>>, a array<string>, b array<struct<n:string,m:int>>, c array<struct<n:array<int>>>, d array<binary>, e array<array<int>>")
    assert list(found) == ["id", "s.tag", "s.inner.x", "s.inner.y", "a", "b", "c", "d", "e"]
    assert [found[n] for n in "abcde"] == ["ARRAY", "ARRAY", "UNSUPPORTED", "UNSUPPORTED", "UNSUPPORTED"]


def test_names_that_would_meet_are_refused():
    with pytest.raises(ValueError, match="same name"):
        describe(schema("s struct<x:int>, s__x int"))


def test_sketches_are_opted_into():
    text = "id int, k binary, s string"
    assert kinds(text, sketches=["k"])["k"] == "KLL_FLOAT64"
    assert kinds(text, int_sketches=["k"])["k"] == "KLL_INT64"
    for how in ({"sketches": ["k"], "int_sketches": ["k"]}, {"sketches": ["z"]}, {"sketches": ["s"]}):
        with pytest.raises(ValueError):
            describe(schema(text), **how)


def test_geography_is_opted_into():
    assert kinds("id int, p struct<lon:double,lat:double>, w string", geography=["p", "w"]) == {"id": "INTEGER", "p": "GEOGRAPHY", "w": "GEOGRAPHY"}
    with pytest.raises(ValueError):
        describe(schema("p int"), geography=["p"])


def test_intersection():
    a, b = describe(schema("id int, x int, y array<string>, z string, u binary")), describe(schema("id int, x string, y array<int>, w int, u binary"))
    found = intersect(a, b, ["id"])
    assert [c.name for c in found.columns] == ["id", "u"] and found.excluded == [("u", "binary")]
    assert (found.only_in_a, found.only_in_b) == (["z"], ["w"])
    assert [n for n, _, _ in found.type_differs] == ["x", "y"]
    assert len(found.warnings()) == 4
    for keys in ([], ["z"], ["w"], ["x"], ["none"]):
        with pytest.raises(KeyColumnError):
            intersect(a, b, keys)


def test_widths_of_numbers():
    a, b = describe(schema("id bigint, n int")), describe(schema("id bigint, n bigint"))
    assert [c.name for c in intersect(a, b, ["id"]).columns] == ["id"]
    assert [c.name for c in intersect(a, b, ["id"], coerce_numeric=True).columns] == ["id", "n"]


def test_tolerance_may_not_name_arrays_and_sketches():
    columns = describe(schema("id int, a array<int>, k binary, f double"), sketches=["k"])
    check_tolerances(columns, Settings(Tolerance(1.0, None, {"f": 2.0})))
    for name in "ak":
        with pytest.raises(ValueError):
            check_tolerances(columns, Settings(Tolerance(column_relative={name: 1.0})))


def test_small_helpers():
    assert split_names(" a, b ,,c") == ["a", "b", "c"] and split_names(" , ") is None and split_names(None) is None
    assert by_kind(describe(schema("a int, b double")), "FLOAT") == ["b"]
