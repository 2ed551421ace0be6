"""Queries on places over the customers, and their SQL: geodesics by a recursive query, shapes by how they were made."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.geodesic import FLATTENING, SEMI_MAJOR, SEMI_MINOR
from ..functions.kinds import Settings
from ..functions.tolerance import Tolerance
from ..operators import summary
from ..operators.align import Pair, align
from .compare import Comparison

Query = Callable[[SparkSession, str], DataFrame]

#: Two places a customer: the second up to a third of the way round the globe from the first, or the same.
FAR_A = "c_custkey, ((c_custkey * 37) % 3600) / 10.0 - 180 as lon, ((c_custkey * 53) % 1700) / 10.0 - 85 as lat"
FAR_B = (
    "c_custkey, ((c_custkey * 37) % 3600) / 10.0 - 180 + (case when c_custkey % 5 = 0 then 0 else ((c_custkey * 7) % 1000) / 10.0 end) as lon, "
    "((c_custkey * 53) % 1700) / 10.0 - 85 + (case when c_custkey % 5 = 0 then 0 else ((c_custkey * 11) % 50) / 10.0 end) as lat"
)


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/customer.parquet")


def _sides(spark: SparkSession, d: str) -> list[DataFrame]:
    wkt = F.concat(F.lit("POINT("), F.col("lon").cast("double").cast("string"), F.lit(" "), F.col("lat").cast("double").cast("string"), F.lit(")"))
    return [_customers(spark, d).selectExpr(*_split(side)).select("c_custkey", wkt.alias("place")) for side in (FAR_A, FAR_B)]


def _split(columns: str) -> list[str]:
    """c_custkey, and the expressions of lon and lat."""
    key, rest = columns.split(", ", 1)
    lon, lat = rest.split(" as lon, ")
    return [key, f"{lon} as lon", lat]


def _far(spark: SparkSession, d: str) -> Comparison:
    return Comparison(*_sides(spark, d), keys=["c_custkey"], settings=Settings(Tolerance(absolute=500_000.0)), geography=["place"])


def geo_spheroid(spark: SparkSession, d: str) -> DataFrame:
    """What a diff shows of places that differ: metres along the geodesic, to the millimetre, and whether they are near enough."""
    rows = _far(spark, d).diff()
    return rows.select("c_custkey", F.round("place__distance_meters", 3).alias("metres"), F.col("place__within_tolerance").alias("near"))


def geo_stats(spark: SparkSession, d: str) -> DataFrame:
    """The same in a summary."""
    names = ["rows_in_both_diff", "place__diff_count", "place__within", "place__outside"]
    row = summary.summarize(_far(spark, d).layers())
    return row.select(*names, *[F.round(f"place__{n}_meters", 3).alias(f"place__{n}_meters") for n in ("max", "avg")])


def _geodesics() -> str:
    """c_custkey, metres, sphere: by repeated substitution, as the formulas stand."""
    f = FLATTENING
    step = f"""
    select c_custkey, l, s1, c1, s2, c2, n + 1 as n,
        l + (1 - c) * {f} * sa * (sigma + c * ss * (cm + c * cs * (2 * cm * cm - 1))) as x
    from (select *, ({f} / 16) * (1 - sa * sa) * (4 + {f} * (4 - 3 * (1 - sa * sa))) as c from ({{arc}}))"""
    arc = """
    select *, cs - case when sa * sa = 1 then 0 else 2 * s1 * s2 / (1 - sa * sa) end as cm
    from (select *, atan2(ss, cs) as sigma, c1 * c2 * sin(x) / ss as sa
          from (select *, sqrt(pow(c2 * sin(x), 2) + pow(c1 * s2 - s1 * c2 * cos(x), 2)) as ss, s1 * s2 + c1 * c2 * cos(x) as cs from {rows}))"""
    h = "pow(sin((lat_b - lat_a) / 2), 2) + cos(lat_a) * cos(lat_b) * pow(sin((lon_b - lon_a) / 2), 2)"
    return f"""
with recursive sides as (
    select a.c_custkey, radians(a.lon::double) as lon_a, radians(a.lat::double) as lat_a, radians(b.lon::double) as lon_b, radians(b.lat::double) as lat_b
    from (select {FAR_A} from customer) a join (select {FAR_B} from customer) b using (c_custkey) where a.c_custkey % 5 <> 0 and not (a.lon = b.lon and a.lat = b.lat)
),
start as (
    select c_custkey, lon_b - lon_a as l, sin(atan(tan(lat_a) * {1 - f!r})) as s1, cos(atan(tan(lat_a) * {1 - f!r})) as c1,
        sin(atan(tan(lat_b) * {1 - f!r})) as s2, cos(atan(tan(lat_b) * {1 - f!r})) as c2
    from sides
),
steps as (
    select *, 0 as n, l as x from start
    union all {step.format(arc=arc.format(rows="steps where n < 20"))}
),
ends as (
    select *, (1 - sa * sa) * {(SEMI_MAJOR**2 - SEMI_MINOR**2) / SEMI_MINOR**2!r} as u from ({arc.format(rows="steps where n = 20")})
),
found as (
    select c_custkey, {SEMI_MINOR!r} * (1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u))))
        * (sigma - k * ss * (cm + k / 4 * (cs * (2 * cm * cm - 1) - k / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))) as metres
    from (select *, u / 1024 * (256 + u * (-128 + u * (74 - 47 * u))) as k from ends)
),
places as (select c_custkey, metres, 2 * {geo.SPHERE_RADIUS} * asin(least(1.0, sqrt({h}))) as sphere from found join sides using (c_custkey))"""


GEO_SPHEROID_SQL = f"{_geodesics()} select c_custkey, round(metres, 3) as metres, false as near from places where sphere > 500000"
GEO_STATS_SQL = f"""{_geodesics()}
select count(*) as rows_in_both_diff, count(*) as place__diff_count, count(*) filter (sphere <= 500000) as place__within,
    count(*) filter (sphere > 500000) as place__outside, round(max(metres), 3) as place__max_meters, round(avg(metres), 3) as place__avg_meters
from places"""


#: Shapes about a corner (x y) with the step h, as formats: of each pair the first is A's, the others are B's; equal or not.
SHAPES: list[tuple[str, str, bool]] = [
    ("LINESTRING({x} {y}, {x} {y2}, {x2} {y2})", "linestring ({x2} {y2},{x} {y2},{x} {ym},{x} {y})", True),
    ("LINESTRING({x} {y}, {x} {y2}, {x2} {y2})", "LINESTRING({x} {y}, {x} {y2})", False),
    ("POLYGON(({x} {y}, {x2} {y}, {x2} {y2}, {x} {y2}, {x} {y}))", "POLYGON (({x2} {y2}, {x2} {ym}, {x2} {y}, {x} {y}, {x} {y2}, {x2} {y2}))", True),
    ("POLYGON(({x} {y}, {x2} {y}, {x2} {y2}, {x} {y2}, {x} {y}))", "POLYGON(({x} {y}, {x2} {y}, {x2} {y2}, {x} {y}))", False),
    (
        "MULTIPOLYGON((({x} {y}, {xm} {y}, {x} {ym}, {x} {y})), (({x2} {y2}, {xm} {y2}, {x2} {ym}, {x2} {y2})))",
        "MULTIPOLYGON((({x2} {ym}, {x2} {y2}, {xm} {y2}, {x2} {ym})), (({x} {ym}, {x} {y}, {xm} {y}, {x} {ym})))",
        True,
    ),
    ("MULTIPOINT({x} {y}, {x2} {y2})", "MULTIPOINT(({x2} {y2}), ({x} {y}), ({x} {y}))", True),
    ("GEOMETRYCOLLECTION(POINT({x} {y}), LINESTRING({x} {y}, {x2} {y}))", "GEOMETRYCOLLECTION(LINESTRING({x2} {y}, {x} {y}), POINT({x} {y}))", True),
    ("GEOMETRYCOLLECTION(POINT({x} {y}), LINESTRING({x} {y}, {x2} {y}))", "GEOMETRYCOLLECTION(POINT({x} {y2}), LINESTRING({x} {y}, {x2} {y}))", False),
]


def _text(form: str) -> F.Column:
    """A format with its numbers, as a concatenation."""
    x, y = (F.col("c_custkey") % 170).cast("double"), (F.col("c_custkey") % 70).cast("double")
    at = {"x": x, "y": y, "x2": x + 2, "y2": y + 2, "xm": x + 1, "ym": y + 1}
    parts = []
    for piece in form.replace("{", "\0{").replace("}", "\0").split("\0"):
        parts.append(at[piece[1:]].cast("string") if piece.startswith("{") else F.lit(piece))
    return F.concat(*parts)


def _chosen(forms: list[str]) -> F.Column:
    out = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        out = F.when(F.col("c_custkey") % len(forms) == i, _text(form)).otherwise(out)
    return out


def geo_shapes_equal(spark: SparkSession, d: str) -> DataFrame:
    """Lines, polygons and collections written in other ways, or changed: which rows the comparison finds different."""
    sides = [_customers(spark, d).select("c_custkey", _chosen([s[k] for s in SHAPES]).alias("place")) for k in (0, 1)]
    c = Comparison(*sides, keys=["c_custkey"], geography=["place"])
    rows = align(c.a, c.b, c.key_columns, c.values)
    return rows.select("c_custkey", Pair(c.values[0], c.settings).equal.alias("same"))


GEO_SHAPES_SQL = f"select c_custkey, c_custkey % {len(SHAPES)} in ({', '.join(str(i) for i, s in enumerate(SHAPES) if s[2])}) as same from customer"

#: Pairs of shapes whose distance in degrees is known: a point off a meridian line's end, lines across, inside a polygon, ...
APART: list[tuple[str, str, str]] = [
    ("POINT({x} {y})", "LINESTRING({x} {y2}, {x} 85)", "2"),
    ("LINESTRING(-1 0, 1 0)", "LINESTRING(0 -1, 0 {y2})", "0"),
    ("POINT({x} {y})", "LINESTRING(0 0, 90 0, 179 0)", "least(c_custkey % 70, 90)"),
    ("POLYGON((-5 -5, 5 -5, 5 5, -5 5, -5 -5))", "MULTIPOINT(1 1, {x} {y})", "0"),
    ("LINESTRING({x} -5, {x} -1)", "LINESTRING({x} {y2}, {x} 80)", "c_custkey % 70 + 3"),
]


def geo_shape_distance(spark: SparkSession, d: str) -> DataFrame:
    """How far shapes are apart on the sphere, and whether that is within 300 km."""
    sides = [_customers(spark, d).select("c_custkey", _chosen([s[k] for s in APART]).alias("place")) for k in (0, 1)]
    c = Comparison(*sides, keys=["c_custkey"], settings=Settings(Tolerance(absolute=300_000.0)), geography=["place"])
    rows = align(c.a, c.b, c.key_columns, c.values)
    pair = Pair(c.values[0], c.settings)
    return rows.select("c_custkey", pair.within.alias("near"), F.round(geo.sphere_distance(pair.a, pair.b, False), 2).alias("metres"))


def _apart_sql() -> str:
    degrees = " ".join(f"when {i} then {s[2]}" for i, s in enumerate(APART))
    metres = f"{geo.SPHERE_RADIUS} * radians((case c_custkey % {len(APART)} {degrees} end)::double)"
    return f"select c_custkey, {metres} <= 300000 as near, round({metres}, 2) as metres from customer"


QUERIES: dict[str, Query] = {
    "geo_spheroid": geo_spheroid,
    "geo_stats": geo_stats,
    "geo_shapes_equal": geo_shapes_equal,
    "geo_shape_distance": geo_shape_distance,
}
ORACLE_SQL: dict[str, str] = {
    "geo_spheroid": GEO_SPHEROID_SQL,
    "geo_stats": GEO_STATS_SQL,
    "geo_shapes_equal": GEO_SHAPES_SQL,
    "geo_shape_distance": _apart_sql(),
}
