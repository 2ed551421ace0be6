"""The length of the shortest geodesic on the WGS 84 ellipsoid, as a Column expression (within a millimetre).

Reduced latitudes map the ellipsoid's geodesics to great circles of an auxiliary sphere, whose longitudes differ from
the ellipsoid's by a series. Away from antipodes that difference is found by repeated substitution. Near them, where
substitution does not settle, the azimuth at the first point is found by bisection: with the first point as the one
farther from the equator and turned to the south, the longitude reached at the other's latitude grows with it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ellipsoid.
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563
SEMI_MINOR = SEMI_MAJOR * (1 - FLATTENING)
SUBSTITUTIONS, HALVINGS = 12, 54
#: Beyond this angle on the auxiliary sphere the points are nearly antipodal.
NEARLY_ANTIPODAL = math.pi - 0.1
TINY = 1e-150


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def named(**columns: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in columns.items()])


def gain(sin_azimuth: Column, sigma: Column, sin_sigma: Column, cos_sigma: Column, cos_middle: Column) -> Column:
    """How much the longitude on the sphere is ahead, for an arc sigma whose middle has that cosine of twice its place."""
    f = FLATTENING
    square = 1 - sin_azimuth * sin_azimuth
    c = square * (f / 16) * (4 + f * (4 - 3 * square))
    return (1 - c) * f * sin_azimuth * (sigma + c * sin_sigma * (cos_middle + c * cos_sigma * (2 * cos_middle * cos_middle - 1)))


def length(sin_azimuth: Column, sigma: Column, sin_sigma: Column, cos_sigma: Column, cos_middle: Column) -> Column:
    """Metres of an arc sigma of the auxiliary sphere."""
    square = (1 - sin_azimuth * sin_azimuth) * ((SEMI_MAJOR**2 - SEMI_MINOR**2) / SEMI_MINOR**2)

    def found(u: Column) -> Column:
        a = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        b = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        m = cos_middle
        inner = cos_sigma * (2 * m * m - 1) - b / 6 * m * (4 * sin_sigma * sin_sigma - 3) * (4 * m * m - 3)
        return F.lit(SEMI_MINOR) * a * (sigma - b * sin_sigma * (m + b / 4 * inner))

    return let(square, found)


def _arc(sin1: Column, cos1: Column, sin2: Column, cos2: Column, longitude: Column) -> Column:
    """The great circle between two reduced latitudes, a longitude apart on the sphere."""
    across = F.pow(cos2 * F.sin(longitude), 2) + F.pow(cos1 * sin2 - sin1 * cos2 * F.cos(longitude), 2)
    half = named(s=F.sqrt(across), c=sin1 * sin2 + cos1 * cos2 * F.cos(longitude))

    def found(x: Column) -> Column:
        s, c = x.getField("s"), x.getField("c")
        azimuth = F.coalesce(F.try_divide(cos1 * cos2 * F.sin(longitude), s), F.lit(0.0))
        middle = let(azimuth, lambda a: named(a=a, m=F.coalesce(c - F.try_divide(2 * sin1 * sin2, 1 - a * a), F.lit(0.0))))
        return let(middle, lambda y: named(sigma=F.atan2(s, c), s=s, c=c, a=y.getField("a"), m=F.greatest(F.lit(-1.0), F.least(F.lit(1.0), y.getField("m")))))

    return let(half, found)


def _fields(x: Column) -> tuple[Column, ...]:
    return tuple(x.getField(n) for n in ("a", "sigma", "s", "c", "m"))


def _by_substitution(sin1: Column, cos1: Column, sin2: Column, cos2: Column, longitude: Column) -> Column:
    once = lambda ahead, _: let(_arc(sin1, cos1, sin2, cos2, ahead), lambda x: longitude + gain(*_fields(x)))
    ahead = F.aggregate(F.array_repeat(F.lit(0), SUBSTITUTIONS), longitude, once)
    return let(let(ahead, lambda at: _arc(sin1, cos1, sin2, cos2, at)), lambda x: length(*_fields(x)))


def _from_azimuth(sin1: Column, cos1: Column, sin2: Column, cos2: Column, azimuth: Column) -> Column:
    """a, sigma, s, c, m as in _arc, and omega, the longitude on the sphere, of the geodesic that leaves with the azimuth."""
    sine = let(
        F.sin(azimuth) * cos1,
        lambda a: named(a=a, c1=F.cos(azimuth) * cos1, c2=F.sqrt(F.greatest(F.lit(0.0), F.pow(F.cos(azimuth) * cos1, 2) + (cos2 - cos1) * (cos2 + cos1)))),
    )

    def found(x: Column) -> Column:
        a, c1, c2 = (x.getField(n) for n in ("a", "c1", "c2"))
        places = named(s1=F.atan2(sin1, c1), s2=F.atan2(sin2, c2), w1=F.atan2(a * sin1, c1), w2=F.atan2(a * sin2, c2))

        def arc(y: Column) -> Column:
            sigma = y.getField("s2") - y.getField("s1")
            return named(
                a=a,
                sigma=sigma,
                s=F.sin(sigma),
                c=F.cos(sigma),
                m=F.cos(y.getField("s1") + y.getField("s2")),
                omega=y.getField("w2") - y.getField("w1"),
            )

        return let(places, arc)

    return let(sine, found)


def _by_bisection(sin1: Column, cos1: Column, sin2: Column, cos2: Column, longitude: Column) -> Column:
    # the one farther from the equator first, in the south
    swap = F.abs(sin1) < F.abs(sin2)
    sign = F.when(F.when(swap, sin2).otherwise(sin1) > 0, -1.0).otherwise(1.0)
    placed = named(
        s1=F.least(F.when(swap, sin2).otherwise(sin1) * sign, F.lit(-TINY)), c1=F.when(swap, cos2).otherwise(cos1),
        s2=F.when(swap, sin1).otherwise(sin2) * sign, c2=F.when(swap, cos1).otherwise(cos2),
    )

    def found(p: Column) -> Column:
        ends = [p.getField(n) for n in ("s1", "c1", "s2", "c2")]
        reached = lambda azimuth: let(_from_azimuth(*ends, azimuth), lambda x: x.getField("omega") - gain(*_fields(x)))

        def halved(range_: Column, _: Column) -> Column:
            lo, hi = range_.getField("lo"), range_.getField("hi")
            middle = (lo + hi) / 2
            return F.when(reached(middle) < longitude, named(lo=middle, hi=hi)).otherwise(named(lo=lo, hi=middle))

        range_ = F.aggregate(F.array_repeat(F.lit(0), HALVINGS), named(lo=F.lit(0.0), hi=F.lit(math.pi)), halved)
        azimuth = let(range_, lambda r: (r.getField("lo") + r.getField("hi")) / 2)
        return let(let(azimuth, lambda z: _from_azimuth(*ends, z)), lambda x: length(*_fields(x)))

    return let(placed, found)


def distance(lon_a: Column, lat_a: Column, lon_b: Column, lat_b: Column) -> Column:
    """Metres between two places in radians; null if one is null."""
    turn = F.pmod(lon_b - lon_a + math.pi, F.lit(2 * math.pi)) - math.pi
    reduced = lambda lat: F.atan(F.tan(lat) * (1 - FLATTENING))
    inputs = named(l=F.abs(turn), u1=reduced(lat_a), u2=reduced(lat_b))

    def found(x: Column) -> Column:
        u1, u2, longitude = x.getField("u1"), x.getField("u2"), x.getField("l")
        parts = named(s1=F.sin(u1), c1=F.cos(u1), s2=F.sin(u2), c2=F.cos(u2))

        def chosen(y: Column) -> Column:
            ends = [y.getField(n) for n in ("s1", "c1", "s2", "c2")]
            angle = let(_arc(*ends, longitude), lambda z: z.getField("sigma"))
            return let(angle, lambda s: F.when(s > NEARLY_ANTIPODAL, _by_bisection(*ends, longitude)).otherwise(_by_substitution(*ends, longitude)))

        return let(parts, chosen)

    known = lon_a.isNotNull() & lat_a.isNotNull() & lon_b.isNotNull() & lat_b.isNotNull()
    return F.when(known, F.when((lon_a == lon_b) & (lat_a == lat_b), F.lit(0.0)).otherwise(let(inputs, found)))
