"""Places on the globe as Column expressions: WKT text (points, lines, polygons, collections) or a struct with lon and lat.

A shape is an array of parts: a kind (0 point, 1 line, 2 polygon) and rings of vertices, a point or line being one ring.
Edges are the shorter arcs of great circles. Text that is no WKT of these types has no shape and compares as text.
A session that uses them needs allow(); a Comparison with places calls it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import geodesic
from .geodesic import let

#: Fixed value: mean radius of the sphere.
SPHERE_RADIUS = 6371010.0
POINT = r"(?i)^\s*POINT\s*\(\s*(\S+)\s+(\S+?)\s*\)\s*$"
#: A vertex this near (radians, about 6 micrometres) to the arc between its neighbours is on it.
ON_ARC = 1e-12

NAMES = r"^(MULTI)?(POINT|LINESTRING|POLYGON)(?=\(|EMPTY$)"
VERTEX = "struct<lon:double,lat:double>"
#: Passes that the analyzer needs for the nested functions here; Spark's own limit is 100.
PASSES = 1000


def allow(spark: SparkSession) -> None:
    """Let this session resolve the expressions of this module, which nest deeper than Spark's default allows."""
    if int(spark.conf.get("spark.sql.analyzer.maxIterations", "100")) < PASSES:
        spark.conf.set("spark.sql.analyzer.maxIterations", str(PASSES))


def coordinate(value: Column, part: str, struct: bool) -> Column:
    """lon or lat of a point in degrees; null if the value is no point."""
    if struct:
        return value.getField(part).cast("double")
    return F.regexp_extract(value, POINT, 1 if part == "lon" else 2).try_cast("double")


def text(value: Column, struct: bool) -> Column:
    if not struct:
        return value
    lon, lat = coordinate(value, "lon", True), coordinate(value, "lat", True)
    return F.when(lon.isNotNull() & lat.isNotNull(), F.concat(F.lit("POINT("), lon.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")")))


# --- shapes from WKT


def vertex(lon: Column, lat: Column) -> Column:
    """Normal coordinates: -180 is 180, a pole has the longitude 0, and zero no sign; null fields if lat is out of range."""
    turned = F.pmod(lon + 180, F.lit(360.0)) - 180
    lon = F.when((lon > -180) & (lon <= 180), lon + 0.0).otherwise(F.when(turned == -180, F.lit(180.0)).otherwise(turned))
    ok = lat.between(-90, 90)
    return F.struct(F.when(ok, F.when(F.abs(lat) == 90, F.lit(0.0)).otherwise(lon)).alias("lon"), F.when(ok, lat + 0.0).alias("lat"))


def _vertices(words: Column) -> Column:
    """"lon lat,lon lat" -> vertices; anything but two numbers gives null fields."""

    def one(pair: Column) -> Column:
        xy = F.split(pair, " ")
        return F.when(F.size(xy) == 2, vertex(F.get(xy, 0).try_cast("double"), F.get(xy, 1).try_cast("double"))).otherwise(F.lit(None).cast(VERTEX))

    return F.transform(F.split(words, ","), one)


def _part(kind: int | Column, rings: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, int) else kind).alias("kind"), rings.alias("rings"))


def _member(words: Column) -> Column:
    """The parts of one geometry, compact and upper-case, without the brackets around its body."""
    name = F.regexp_extract(words, NAMES, 2)
    body = F.regexp_replace(F.regexp_replace(words, "^[A-Z]+", ""), r"^\(+|\)+$", "")
    kind = F.when(name == "POINT", 0).when(name == "LINESTRING", 1).otherwise(2)
    body = F.when(name == "POINT", F.regexp_replace(body, "[()]", "")).otherwise(body)
    between_parts = F.when(name == "POINT", ",").when(name == "LINESTRING", r"\),\(").otherwise(r"\)\),\(\(")
    rings = lambda x: F.transform(F.split(x, r"\),\("), _vertices)
    none = F.array().cast(f"array<struct<kind:int,rings:array<array<{VERTEX}>>>>")
    parts = F.transform(F.split(body, between_parts), lambda p: _part(kind, rings(p)))
    return F.when(name != "", F.when(words.endswith("EMPTY"), none).otherwise(parts))


def shape(value: Column, struct: bool = False) -> Column:
    """The parts; null if the value is null or no geometry. Members of collections, nested ones too, are parts of the whole."""
    if struct:
        lon, lat = coordinate(value, "lon", True), coordinate(value, "lat", True)
        at = vertex(lon, lat)
        return F.when(at.getField("lon").isNotNull() & at.getField("lat").isNotNull(), F.array(_part(0, F.array(F.array(at)))))
    compact = F.regexp_replace(F.regexp_replace(F.trim(F.upper(value)), r"\s+", " "), r" ?([(),]) ?| (?=EMPTY)", "$1")
    opened = F.regexp_count(compact, F.lit(r"\(")) == F.regexp_count(compact, F.lit(r"\)"))
    members = F.split(F.regexp_replace(compact, r"GEOMETRYCOLLECTION\(", ""), ",(?=[A-Z])")
    empty = F.array().cast(f"array<struct<kind:int,rings:array<array<{VERTEX}>>>>")
    parts = F.when(compact == "GEOMETRYCOLLECTIONEMPTY", empty).otherwise(
        F.flatten(F.transform(members, lambda m: _member(F.when(m.contains("EMPTY"), F.regexp_replace(m, r"\)+$", "")).otherwise(m))))
    )
    known = lambda v: v.getField("lon").isNotNull() & v.getField("lat").isNotNull()
    sound = lambda p: F.forall(p.getField("rings"), lambda r: F.forall(r, known) & ((p.getField("kind") == 0) | (F.size(r) >= 2)))
    return F.when(opened, let(parts, lambda ps: F.when(F.forall(ps, sound), ps)))


def of_both(a: Column, b: Column, what: Callable[[Column], Column], then: Callable[[Column, Column], Column]) -> Column:
    """then(what(a), what(b)), with what() in the expression once."""
    return let(F.transform(F.array(a, b), lambda v: what(v)), lambda xs: then(F.get(xs, 0), F.get(xs, 1)))


# --- the same shape


def vector(v: Column) -> Column:
    """A vertex as a unit vector."""
    lon, lat = F.radians(v.getField("lon")), F.radians(v.getField("lat"))
    return F.struct((F.cos(lat) * F.cos(lon)).alias("x"), (F.cos(lat) * F.sin(lon)).alias("y"), F.sin(lat).alias("z"))


def xyz(v: Column) -> tuple[Column, Column, Column]:
    return v.getField("x"), v.getField("y"), v.getField("z")


def of_xyz(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def dot(a: Column, b: Column) -> Column:
    return sum((p * q for p, q in zip(xyz(a), xyz(b))), F.lit(0.0))


def minus(a: Column, b: Column) -> Column:
    return of_xyz(*(p - q for p, q in zip(xyz(a), xyz(b))))


def cross(a: Column, b: Column) -> Column:
    (ax, ay, az), (bx, by, bz) = xyz(a), xyz(b)
    return of_xyz(ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def angle(a: Column, b: Column) -> Column:
    """Radians between two unit vectors, by the chord: exact for near ones."""
    return let(norm(minus(a, b)), lambda chord: 2 * F.asin(F.least(F.lit(1.0), chord / 2)))


def between(a: Column, b: Column, c: Column) -> Column:
    """Whether the vertex b is on the arc from a to c."""

    def found(u: Column, v: Column, w: Column) -> Column:
        chord = minus(w, u)
        off = F.abs(dot(u, cross(minus(v, u), chord)))
        return (off <= F.lit(ON_ARC) * norm(chord)) & (dot(u, v) >= dot(u, w)) & (dot(w, v) >= dot(u, w))

    return let(vector(a), lambda u: let(vector(b), lambda v: let(vector(c), lambda w: found(u, v, w))))


def thinned(ring: Column, closed: bool) -> Column:
    """Without repeated vertices and without those on the arc between their neighbours; closed rings without the last vertex."""
    distinct = F.filter(ring, lambda v, i: (i == 0) | (v != F.get(ring, i - 1)))
    opened = let(
        distinct,
        lambda r: F.when((F.size(r) > 1) & (F.get(r, 0) == F.get(r, F.size(r) - 1)), F.slice(r, F.lit(1), F.size(r) - 1)).otherwise(r),
    ) if closed else distinct

    def corners(r: Column) -> Column:
        n = F.size(r)
        at = lambda i: F.get(r, F.pmod(i, n))
        ends = (lambda i: F.lit(False)) if closed else (lambda i: (i == 0) | (i == n - 1))
        return F.when(n > 2, F.filter(r, lambda v, i: ends(i) | ~between(at(i - 1), v, at(i + 1)))).otherwise(r)

    return let(opened, corners)


def edges(ring: Column, closed: bool) -> Column:
    """Undirected edges between neighbours."""

    def found(r: Column) -> Column:
        last = F.size(r) if closed else F.size(r) - 1
        pair = lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        one = lambda i: pair(F.get(r, i), F.get(r, F.pmod(i + 1, F.size(r))))
        return F.when(last >= 1, F.transform(F.sequence(F.lit(0), last - 1), one)).otherwise(F.array().cast(f"array<struct<a:{VERTEX},b:{VERTEX}>>"))

    return let(thinned(ring, closed), found)


def canonical(parts: Column) -> Column:
    """Equal for shapes that are the same places: points, edges of lines and edges of polygons, each as a sorted set.

    So neither the order of parts and rings counts, nor where a ring starts, which way it runs, or vertices that add
    nothing to an arc. Lines of one straight arc that is cut in two at different places stay apart.
    """
    of = lambda kind: F.filter(parts, lambda p: p.getField("kind") == kind)
    every = lambda kind, closed: F.flatten(
        F.transform(of(kind), lambda p: F.flatten(F.transform(p.getField("rings"), lambda r: edges(r, closed))))
    )
    points = F.transform(of(0), lambda p: F.get(F.get(p.getField("rings"), 0), 0))
    return F.struct(*[F.array_sort(F.array_distinct(x)).alias(n) for n, x in (("points", points), ("lines", every(1, False)), ("areas", every(2, True)))])


def equal(a: Column, b: Column, struct: bool) -> Column:
    """The same places. Shapes are looked at only where the values differ; what has no shape compares as it stands."""
    lon_a, lat_a, lon_b, lat_b = (coordinate(x, p, struct) for x in (a, b) for p in ("lon", "lat"))
    points = lon_a.isNotNull() & lat_a.isNotNull() & lon_b.isNotNull() & lat_b.isNotNull()
    same = (lat_a == lat_b) & ((F.abs(lat_a) == 90) | (lon_a == lon_b) | ((F.abs(lon_a) == 180) & (F.abs(lon_b) == 180)))
    if struct:
        return F.when(points, same).otherwise(a.eqNullSafe(b))
    same_shape = lambda x, y: F.when(x.isNotNull() & y.isNotNull(), of_both(x, y, canonical, lambda p, q: p == q)).otherwise(F.lit(False))
    shapes = of_both(a, b, shape, same_shape)
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).when(a == b, F.lit(True)).when(points, same).otherwise(shapes)


# --- distances


def sphere_points(lon_a: Column, lat_a: Column, lon_b: Column, lat_b: Column) -> Column:
    """Radians along a great circle (haversine) from coordinates in radians."""
    h = F.pow(F.sin((lat_b - lat_a) / 2), 2) + F.cos(lat_a) * F.cos(lat_b) * F.pow(F.sin((lon_b - lon_a) / 2), 2)
    return F.when(h.isNotNull(), 2 * F.asin(F.least(F.lit(1.0), F.sqrt(h))))


def arcs(parts: Column) -> Column:
    """struct(a, b) of unit vectors: every edge, and every point as an edge of no length."""

    def of_ring(ring: Column, kind: Column) -> Column:
        def found(r: Column) -> Column:
            n = F.size(r)
            arc = lambda i, j: F.struct(F.get(r, i).alias("a"), F.get(r, j).alias("b"))
            open_ones = F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: arc(i, F.least(i + 1, n - 1)))
            return F.when(kind == 2, F.array_append(open_ones, arc(n - 1, F.lit(0)))).otherwise(open_ones)

        return let(F.transform(ring, vector), found)

    return F.flatten(F.transform(parts, lambda p: F.flatten(F.transform(p.getField("rings"), lambda r: of_ring(r, p.getField("kind"))))))


def meeting(d: Column, p: Column, q: Column) -> Column:
    """How far apart (radians), and where on the one and on the other."""
    return F.struct(d.alias("d"), p.alias("p"), q.alias("q"))


def to_arc(case: Column) -> Column:
    """meeting() of a point p and the arc from a to b; turned: the point belongs to the second shape."""
    p, a, b = (case.getField(n) for n in "pab")

    def found(n: Column) -> Column:
        # n: normal of the arc's great circle; the foot is on the arc if p is ahead of a and before b
        on = (dot(cross(n, a), p) > 0) & (dot(cross(b, n), p) > 0)
        flat = let(F.try_divide(dot(n, p), dot(n, n)), lambda share: of_xyz(*(x - share * y for x, y in zip(xyz(p), xyz(n)))))
        foot = let(flat, lambda f: let(norm(f), lambda size: of_xyz(*(F.try_divide(x, size) for x in xyz(f)))))
        return F.array_min(F.transform(F.when(on, F.array(foot)).otherwise(F.array(a, b)), lambda q: meeting(angle(p, q), p, q)))

    turn = lambda m: F.when(case.getField("turned"), meeting(m.getField("d"), m.getField("q"), m.getField("p"))).otherwise(m)
    return let(let(cross(a, b), found), turn)


def crosses(s: Column, t: Column) -> Column:
    """Whether two arcs cross inside both."""
    a, b, c, d = s.getField("a"), s.getField("b"), t.getField("a"), t.getField("b")

    def found(n: Column, m: Column) -> Column:
        acb, dac = -dot(n, c), dot(n, d)
        cbd, bda = -dot(m, b), dot(m, a)
        return ((acb > 0) & (cbd > 0) & (bda > 0) & (dac > 0)) | ((acb < 0) & (cbd < 0) & (bda < 0) & (dac < 0))

    return let(cross(a, b), lambda n: let(cross(c, d), lambda m: found(n, m)))


def arc_pair(s: Column, t: Column) -> Column:
    zero = meeting(F.lit(0.0), s.getField("a"), s.getField("a"))
    case = lambda end, mine, theirs, turned: F.struct(
        mine.getField(end).alias("p"),
        theirs.getField("a").alias("a"),
        theirs.getField("b").alias("b"),
        F.lit(turned).alias("turned"),
    )
    cases = F.array(case("a", s, t, False), case("b", s, t, False), case("a", t, s, True), case("b", t, s, True))
    return F.when(crosses(s, t), zero).otherwise(F.array_min(F.transform(cases, to_arc)))


def inside(parts: Column, p: Column) -> Column:
    """Whether the polygons among the parts, each within half the globe, hold the point p: an arc to a far point crosses oddly often."""

    def of_polygon(polygon: Column) -> Column:
        total = lambda sides: F.aggregate(
            sides,
            of_xyz(*[F.lit(0.0)] * 3),
            lambda sum_,
            s: of_xyz(*(x + y for x, y in zip(xyz(sum_), xyz(s.getField("a"))))),
        )
        # square to the middle: outside, and less than half round from any point inside
        far = lambda middle: cross(middle, of_xyz(F.lit(0.3141), F.lit(0.5926), F.lit(0.7413)))
        odd = lambda sides, q: F.size(F.filter(sides, lambda s: crosses(F.struct(p.alias("a"), q.alias("b")), s))) % 2 == 1
        ahead = lambda middle: dot(middle, p) > 0
        return let(
            arcs(F.array(polygon)),
            lambda sides: let(
                total(sides),
                lambda m: ahead(m) & let(far(m), lambda q: let(of_xyz(*(F.try_divide(x, norm(q)) for x in xyz(q))), lambda u: odd(sides, u))),
            ),
        )

    return F.exists(F.filter(parts, lambda x: x.getField("kind") == 2), of_polygon)


def closest(a: Column, b: Column) -> Column:
    """meeting() of two shapes; null if either is empty. A shape inside a polygon of the other is at no distance."""

    def covered(pair: Column) -> Column:
        """The first vertices of y's parts that x's polygons hold."""
        firsts = F.transform(pair.getField("y"), lambda p: vector(F.get(F.get(p.getField("rings"), 0), 0)))
        return F.filter(firsts, lambda v: inside(pair.getField("x"), v))

    pairs = of_both(a, b, arcs, lambda s, t: F.array_min(F.flatten(F.transform(s, lambda x: F.transform(t, lambda y: arc_pair(x, y))))))
    ways = F.array(F.struct(a.alias("x"), b.alias("y")), F.struct(b.alias("x"), a.alias("y")))
    held = F.get(F.flatten(F.transform(ways, covered)), 0)
    return let(held, lambda v: F.when(v.isNotNull(), meeting(F.lit(0.0), v, v)).otherwise(pairs))


def cap(parts: Column) -> Column:
    """struct(c, r): the middle of the vertices and the angle of the farthest from it; arcs stay in it if r < 90 degrees."""
    ends = F.flatten(F.transform(parts, lambda p: F.flatten(F.transform(p.getField("rings"), lambda r: F.transform(r, vector)))))

    def found(vs: Column) -> Column:
        total = F.aggregate(vs, of_xyz(*[F.lit(0.0)] * 3), lambda s, v: of_xyz(*(x + y for x, y in zip(xyz(s), xyz(v)))))
        unit = let(total, lambda t: of_xyz(*(F.try_divide(x, norm(t)) for x in xyz(t))))
        return let(unit, lambda c: F.struct(c.alias("c"), F.array_max(F.transform(vs, lambda v: angle(c, v))).alias("r")))

    return let(ends, found)


def apart(a: Column, b: Column) -> Column:
    """A lower bound of the angle between two shapes, by their caps; 0 where a cap is too wide to say."""

    def found(p: Column, q: Column) -> Column:
        r = p.getField("r") + q.getField("r")
        wide = (p.getField("r") > 1.5) | (q.getField("r") > 1.5)
        return F.when(wide, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), angle(p.getField("c"), q.getField("c")) - r - 1e-9))

    return of_both(a, b, cap, lambda p, q: F.coalesce(found(p, q), F.lit(0.0)))


def _by_kind(a: Column, b: Column, struct: bool, points: Callable[..., Column], shapes: Callable[[Column, Column], Column]) -> Column:
    """points(radians of both) where both are points, else shapes(parts of both); null if either is null or no shape."""
    where = [F.radians(coordinate(x, p, struct)) for x in (a, b) for p in ("lon", "lat")]
    of = lambda x: [x.getField(f"c{i}") for i in range(4)]
    at = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(where)])

    def chosen(x: Column) -> Column:
        both = of(x)[0].isNotNull() & of(x)[1].isNotNull() & of(x)[2].isNotNull() & of(x)[3].isNotNull()
        if struct:
            return F.when(both, points(*of(x)))
        known = lambda p, q: F.when(p.isNotNull() & q.isNotNull(), shapes(p, q))
        return F.when(both, points(*of(x))).otherwise(of_both(a, b, shape, known))

    return F.when(a.isNotNull() & b.isNotNull(), let(at, chosen))


def sphere_distance(a: Column, b: Column, struct: bool) -> Column:
    """Metres on the sphere, between the nearest places of shapes; null if either is null, empty or no shape."""
    return F.lit(SPHERE_RADIUS) * _by_kind(a, b, struct, sphere_points, lambda x, y: closest(x, y).getField("d"))


def spheroid_distance(a: Column, b: Column, struct: bool) -> Column:
    """Metres along a geodesic of the ellipsoid; of shapes, between the places that are nearest on the sphere."""
    ends = lambda *where: F.struct(*[c.alias(f"c{i}") for i, c in enumerate(where)])

    def nearest(met: Column) -> Column:
        where = [
            f for v in (met.getField("p"), met.getField("q")) for f in (
                F.atan2(v.getField("y"), v.getField("x")),
                F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v.getField("z")))),
            )
        ]
        return F.when(met.getField("d") == 0, ends(*[F.lit(0.0)] * 4)).otherwise(ends(*where))

    found = _by_kind(a, b, struct, ends, lambda x, y: let(closest(x, y), nearest))
    return let(found, lambda x: geodesic.distance(*[x.getField(f"c{i}") for i in range(4)]))


def within(a: Column, b: Column, absolute: float | None, struct: bool) -> Column:
    """Never null: on the sphere, absolute only; both null: true; no bound: true. Caps rule far shapes out.

    What has no distance compares as it stands: two empty shapes are together, text that is no shape only with itself.
    """
    if absolute is None:
        return F.lit(True)
    angle_ = F.lit(absolute / SPHERE_RADIUS)
    shapes = lambda x, y: F.when((F.size(x) == 0) & (F.size(y) == 0), F.lit(True)).when(apart(x, y) > angle_, F.lit(False)).otherwise(
        F.lit(SPHERE_RADIUS) * closest(x, y).getField("d") <= absolute
    )
    near = _by_kind(a, b, struct, lambda *where: F.lit(SPHERE_RADIUS) * sphere_points(*where) <= absolute, shapes)
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(near, a.eqNullSafe(b))).otherwise(a.isNull() & b.isNull())
