"""Distances and an axial hexagon grid."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
# The WGS 84 spheroid.
EQUATOR_KM = 6378.137
FLATTENING = 1 / 298.257223563
#: Steps of the inverse problem, and the change of longitude (radians) at which it has settled.
STEPS, SETTLED = 20, 1e-12


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere of mean radius; a spheroid's differs by up to half a percent."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def spheroid_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Length of the shortest line on the WGS 84 spheroid, to a millimetre; null if a coordinate is.

    The inverse problem by fixed-point steps on the difference of longitude. Where these don't settle, which is near the point
    opposite to the first, the line is cut where it crosses the circle halfway, at the place that makes both parts shortest.
    """
    there = lat1.isNotNull() & lon1.isNotNull() & lat2.isNotNull() & lon2.isNotNull()
    d = [c.cast("double") for c in (lat1, lon1, lat2, lon2)]
    return F.when(there, _let(_inverse(*d), lambda s: F.when(s["settled"], s["km"]).otherwise(_around_km(*d))))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _inverse(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """km, and whether the steps settled, by Vincenty's formulas."""
    u1, u2 = (F.atan((1 - FLATTENING) * F.tan(F.radians(lat))) for lat in (lat1, lat2))
    turn = F.radians(lon2 - lon1)
    ends = F.struct(F.sin(u1).alias("s1"), F.cos(u1).alias("c1"), F.sin(u2).alias("s2"), F.cos(u2).alias("c2"), (turn - 2 * math.pi * F.rint(turn / (2 * math.pi))).alias("turn"))
    settled = lambda s: F.abs(s["now"] - s["before"]) < SETTLED

    def solve(e: Column) -> Column:
        begin = F.struct(F.lit(math.inf).alias("before"), e["turn"].alias("now"))
        step = lambda s, _: F.when(settled(s), s).otherwise(_let(_arc(e, s["now"]), lambda a: F.struct(s["now"].alias("before"), _next_turn(e, a).alias("now"))))
        found = lambda s: F.struct(_let(_arc(e, s["now"]), _arc_km).alias("km"), (settled(s) & (F.abs(s["now"]) <= math.pi)).alias("settled"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), begin, step, found)

    return _let(ends, solve)


def _arc(e: Column, turn: Column) -> Column:
    """The arc between two ends on the auxiliary sphere: its sine, cosine and length, and the sine and squared cosine of its azimuth at the equator."""
    across, along = e["c2"] * F.sin(turn), e["c1"] * e["s2"] - e["s1"] * e["c2"] * F.cos(turn)
    sides = F.struct(F.sqrt(across * across + along * along).alias("sin"), (e["s1"] * e["s2"] + e["c1"] * e["c2"] * F.cos(turn)).alias("cos"))

    def azimuth(a: Column) -> Column:
        slant = F.when(a["sin"] == 0, 0.0).otherwise(e["c1"] * e["c2"] * F.sin(turn) / a["sin"])
        rise = 1 - slant * slant
        mid = F.when(rise > 1e-15, a["cos"] - 2 * e["s1"] * e["s2"] / rise).otherwise(0.0)
        return F.struct(a["sin"].alias("sin"), a["cos"].alias("cos"), F.atan2(a["sin"], a["cos"]).alias("arc"), slant.alias("slant"), rise.alias("rise"), mid.alias("mid"))

    return _let(sides, azimuth)


def _next_turn(e: Column, a: Column) -> Column:
    c = FLATTENING / 16 * a["rise"] * (4 + FLATTENING * (4 - 3 * a["rise"]))
    return e["turn"] + (1 - c) * FLATTENING * a["slant"] * (a["arc"] + c * a["sin"] * (a["mid"] + c * a["cos"] * (2 * a["mid"] * a["mid"] - 1)))


def _arc_km(a: Column) -> Column:
    polar = EQUATOR_KM * (1 - FLATTENING)
    u = a["rise"] * (EQUATOR_KM**2 / polar**2 - 1)
    scale = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
    b = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
    mid2 = a["mid"] * a["mid"]
    off = b * a["sin"] * (a["mid"] + b / 4 * (a["cos"] * (2 * mid2 - 1) - b / 6 * a["mid"] * (4 * a["sin"] * a["sin"] - 3) * (4 * mid2 - 3)))
    return polar * scale * (a["arc"] - off)


def _around_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """The shortest way over a point of the circle 90 degrees from the first end: every way to the other side crosses it."""
    lat = F.radians(lat1)

    def over(at: Column) -> Column:
        up = F.asin(F.cos(lat) * F.cos(at))
        place = F.degrees(up), lon1 + F.degrees(F.atan2(F.sin(at) * F.cos(lat), -F.sin(lat) * F.sin(up)))
        km = _inverse(lat1, lon1, *place)["km"] + _inverse(*place, lat2, lon2)["km"]
        return F.struct(km.alias("km"), at.alias("at"))

    wide = math.pi / 36
    first = F.array_min(F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: over(i * wide)))
    around = lambda s, i: F.array_min(F.transform(F.sequence(F.lit(-4), F.lit(4)), lambda j: over(s["at"] + j * wide / F.pow(F.lit(4.0), i))))
    return F.aggregate(F.sequence(F.lit(1), F.lit(7)), first, around)["km"]


def in_box(lat: Column, lon: Column, south: float, north: float, west: float, east: float) -> Column:
    return lat.between(south, north) & lon.between(west, east)


def hex_id(q: Column, r: Column) -> Column:
    """Axial coordinates, each within 31 bits, as one long."""
    return F.shiftleft(q.cast("long"), 32) + r.cast("long") + F.lit(1 << 31)


def hex_q(cell: Column) -> Column:
    return F.shiftright(cell, 32)


def hex_r(cell: Column) -> Column:
    return cell - F.shiftleft(F.shiftright(cell, 32), 32) - F.lit(1 << 31)


def hex_of_point(lat: Column, lon: Column, size: float) -> Column:
    """Cell of a point on a plane of degrees, for hexagons with the given side."""
    q, r = (lon * (3**0.5) / 3 - lat / 3) / size, lat * 2 / 3 / size
    x, z = F.rint(q), F.rint(r)
    y = F.rint(-q - r)
    dx, dy, dz = F.abs(x - q), F.abs(y + q + r), F.abs(z - r)
    by_x = (dx > dy) & (dx > dz)
    return hex_id(F.when(by_x, -y - z).otherwise(x), F.when(by_x | (dy > dz), z).otherwise(-x - y))


def hex_centre(cell: Column, size: float) -> Column:
    """lon and lat of a cell's centre."""
    q, r = hex_q(cell), hex_r(cell)
    return F.struct(((q + r / 2) * (size * 3**0.5)).alias("lon"), (r * (1.5 * size)).alias("lat"))


def hex_boundary(cell: Column, size: float) -> Column:
    """A cell's six corners as [lon, lat], against the clock from the upper right one."""
    half, c = size * 3**0.5 / 2, hex_centre(cell, size)
    corners = ((half, size / 2), (0.0, size), (-half, size / 2), (-half, -size / 2), (0.0, -size), (half, -size / 2))
    return F.array(*[F.array(c["lon"] + x, c["lat"] + y) for x, y in corners])


def ring_edges(cells: DataFrame, cell: str, k: int = 1) -> DataFrame:
    """(cell, neighbour) for all cells within k steps, without the cell itself."""
    offsets = [(q, r) for q in range(-k, k + 1) for r in range(max(-k, -q - k), min(k, -q + k) + 1) if (q, r) != (0, 0)]
    around = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(r).alias("r")) for q, r in offsets])
    return cells.select(cell, F.explode(around).alias("_o")).select(cell, hex_id(hex_q(F.col(cell)) + F.col("_o.q"), hex_r(F.col(cell)) + F.col("_o.r")).alias("neighbour"))
