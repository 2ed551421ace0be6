"""Shapes and geodesics: published distances, shapes written in other ways, and distances against dense sampling."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowparity.functions import geo, geodesic


@pytest.fixture(scope="module")
def pairs(spark):
    geo.allow(spark)

    def make(rows):
        return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "id int, a string, b string")

    return make


def both(df, what):
    return [r["x"] for r in df.select("id", what(F.col("a"), F.col("b")).alias("x")).orderBy("id").collect()]


#: Published geodesics of WGS 84 in metres; the last ones near antipodes, where plain substitution fails.
PUBLISHED = [
    ((-73.8, 40.6), (-0.5, 51.6), 5551759.400),
    ((0, 0), (0, 90), 10001965.729),
    ((0, 0), (1, 0), 111319.491),
    ((0, 0), (0, 1), 110574.389),
    ((144 + 25 / 60 + 29.5244 / 3600, -(37 + 57 / 60 + 3.7203 / 3600)), (143 + 55 / 60 + 35.3839 / 3600, -(37 + 39 / 60 + 10.1561 / 3600)), 54972.271),
    ((174.81, -41.32), (-5.50, 40.96), 19959679.267),
    ((0, -30), (179.8, 29.9), 19989832.828),
    ((0, 0), (179.5, 0.5), 19936288.579),
    ((0, 0), (179.7, 0.5), 19944127.421),
    ((0, 0), (180, 0), 20003931.459),
    ((10, 30), (-170, -30), 20003931.459),
]


def test_published_geodesics(pairs):
    rows = [(f"POINT({x} {y})", f"POINT({u} {v})") for (x, y), (u, v), _ in PUBLISHED]
    here = both(pairs(rows), lambda a, b: geo.spheroid_distance(a, b, False))
    back = both(pairs(rows), lambda a, b: geo.spheroid_distance(b, a, False))
    for got, other, (_, _, want) in zip(here, back, PUBLISHED):
        assert got == pytest.approx(want, abs=1e-3) and other == pytest.approx(got, abs=1e-4)


def test_no_length(pairs):
    rows = [("POINT(5 6)", "POINT(5 6)"), ("POINT(180 0)", "POINT(-180 0)"), (None, "POINT(1 1)"), ("nothing", "POINT(1 1)"), ("POINT EMPTY", "POINT(1 1)")]
    assert [None if x is None else round(x, 4) for x in both(pairs(rows), lambda a, b: geo.spheroid_distance(a, b, False))] == [0, 0, None, None, None]


SAME = [
    ("LINESTRING(0 0, 10 0)", "linestring (10 0,5 0, 0 0)"),
    ("LINESTRING(0 0,0 0,10 0)", "LINESTRING(0 0,10 0)"),
    ("MULTILINESTRING((0 0,1 1),(5 5,6 6))", "MULTILINESTRING((6 6, 5 5),(1 1, 0 0))"),
    ("LINESTRING(0 0,1 1,2 0)", "MULTILINESTRING((1 1,2 0),(0 0,1 1))"),
    ("POLYGON((0 0,10 0,10 10,0 10,0 0))", "POLYGON ((10 10, 0 10, 0 5, 0 0, 10 0, 10 10))"),
    ("POLYGON((0 0,9 0,9 9,0 9,0 0),(1 1,2 1,2 2,1 1))", "POLYGON((9 9,0 9,0 0,9 0,9 9),(2 2,2 1,1 1,2 2))"),
    ("MULTIPOLYGON(((0 0,1 0,1 1,0 0)),((5 5,6 5,6 6,5 5)))", "MULTIPOLYGON(((5 5,6 6,6 5,5 5)),((1 1,0 0,1 0,1 1)))"),
    ("POLYGON((0 0,1 0,1 1,0 0))", "MULTIPOLYGON(((1 1,0 0,1 0,1 1)))"),
    ("MULTIPOINT(1 2,3 4)", "MULTIPOINT((3 4),(1 2),(1 2))"),
    ("POINT(1 2)", "MULTIPOINT(1 2)"),
    ("POINT(180 5)", "POINT(-180 5)"),
    ("POINT(17 90)", "POINT(-3 90)"),
    ("LINESTRING(-180 0,170 0)", "LINESTRING(170 0,180 0)"),
    ("POINT(0 0)", "POINT(-0.0 0)"),
    ("GEOMETRYCOLLECTION(POINT(1 1),LINESTRING(0 0,1 0))", "GEOMETRYCOLLECTION(LINESTRING(1 0,0 0),GEOMETRYCOLLECTION(POINT(1 1)))"),
    ("POINT EMPTY", "GEOMETRYCOLLECTION EMPTY"),
    ("no shape", "no shape"),
    (None, None),
]
OTHER = [
    ("LINESTRING(0 45,20 45)", "LINESTRING(0 45,10 45,20 45)"),  # the arc between them is not the parallel
    ("LINESTRING(0 0,10 0)", "LINESTRING(0 0,9 0)"),
    ("LINESTRING(0 0,1 0,0 1)", "POLYGON((0 0,1 0,0 1,0 0))"),
    ("POLYGON((0 0,9 0,9 9,0 9,0 0),(1 1,2 1,2 2,1 1))", "POLYGON((0 0,9 0,9 9,0 9,0 0))"),
    ("POLYGON((0 0,9 0,9 9,0 9,0 0))", "POLYGON((0 0,9 0,9 9.000001,0 9,0 0))"),
    ("MULTIPOINT(1 2,3 4)", "MULTIPOINT(1 2)"),
    ("POINT(1 2", "POINT(1 2)"),
    ("POINT(1 2 3)", "POINT(1 2)"),
    ("POINT(1 95)", "POINT(1 96)"),
    ("CIRCLE(1 2)", "POINT(1 2)"),
    ("POINT(1 2)", None),
]


def test_the_same_shapes(pairs):
    found = both(pairs(SAME + OTHER), lambda a, b: geo.equal(a, b, False))
    back = both(pairs(SAME + OTHER), lambda a, b: geo.equal(b, a, False))
    assert found == back == [True] * len(SAME) + [False] * len(OTHER)


def unit(p):
    lon, lat = map(math.radians, p)
    return np.array([math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat)])


def sampled(chain, n=400):
    out = []
    for a, b in zip(chain, chain[1:]):
        w = np.linspace(0, 1, n)[:, None]
        v = unit(a) * (1 - w) + unit(b) * w
        out.append(v / np.linalg.norm(v, axis=1, keepdims=True))
    return np.concatenate(out)


def test_distances_against_sampling(pairs):
    draw = np.random.default_rng(4)
    rows, wants = [], []
    for k in range(24):
        a = np.column_stack([draw.uniform(-20, 20, 3), draw.uniform(-20, 20, 3)])
        b = np.column_stack([draw.uniform(25, 70, 4), draw.uniform(-60, 60, 4)])
        if k % 3 == 0:
            b[:, 0] += 120  # over the date line
        text = lambda c: ", ".join(f"{x} {y}" for x, y in c.tolist())
        closed = np.vstack([a, a[:1]])
        rows.append((f"POLYGON(({text(closed)}))" if k % 2 else f"LINESTRING({text(a)})", f"LINESTRING({text(b)})"))
        x, y = sampled((closed if k % 2 else a).tolist()), sampled(b.tolist())
        wants.append(geo.SPHERE_RADIUS * 2 * math.asin(np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2).min()) / 2))
    got = both(pairs(rows), lambda a, b: geo.sphere_distance(a, b, False))
    spheroid = both(pairs(rows), lambda a, b: geo.spheroid_distance(a, b, False))
    for g, s, w in zip(got, spheroid, wants):
        assert g <= w + 1 and g == pytest.approx(w, rel=2e-3, abs=2000) and s == pytest.approx(g, rel=7e-3)


def test_touching_crossing_and_inside(pairs):
    square = "POLYGON((0 0,10 0,10 10,0 10,0 0),(4 4,6 4,6 6,4 6,4 4))"
    rows = [("POINT(2 2)", square), (square, "LINESTRING(1 1,2 2)"), ("LINESTRING(-5 5,5 5)", square), ("POINT(5 5)", square), ("POINT(-1 5)", square), ("LINESTRING(0 -1,0 1)", "LINESTRING(-1 0,1 0)")]
    got = both(pairs(rows), lambda a, b: geo.sphere_distance(a, b, False))
    assert [x == 0 for x in got] == [True, True, True, False, False, True]
    assert got[3] == pytest.approx(geo.SPHERE_RADIUS * math.radians(1), rel=0.01)  # in the hole
    near = both(pairs(rows), lambda a, b: geo.within(a, b, 120_000.0, False))
    assert near == [True] * 6
    assert both(pairs(rows), lambda a, b: geo.within(a, b, 1000.0, False)) == [True, True, True, False, False, True]


def test_within_of_nulls_and_texts(pairs):
    rows = [(None, None), (None, "POINT(1 1)"), ("x", "x"), ("x", "y"), ("POINT EMPTY", "LINESTRING EMPTY"), ("POINT EMPTY", "POINT(1 1)"), ("POINT(1 1)", "LINESTRING(60 1,70 1)")]
    assert both(pairs(rows), lambda a, b: geo.within(a, b, 5.0, False)) == [True, False, True, False, True, False, False]


def test_let_computes_once(spark):
    plan = spark.range(1).select(geodesic.let(F.col("id") + 1, lambda x: x * x + x)).collect()
    assert plan[0][0] == 2
