"""Geometry as column expressions: a line is ``array<struct<x:double,y:double>>``, in metres.

Everything stays in the JVM. A null geometry gives null; a line of fewer than two vertices
has length 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: a name used twice in an expression is computed twice."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def point(x: Column | float, y: Column | float) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.struct(lit(x).alias("x"), lit(y).alias("y"))


def distance(a: Column, b: Column) -> Column:
    dx, dy = a["x"] - b["x"], a["y"] - b["y"]
    return F.sqrt(dx * dx + dy * dy)


def segments(line: Column | str) -> Column:
    """Array of struct(a, b, len), one for each pair of neighbouring vertices."""
    g = _col(line)
    n = F.greatest(F.size(g) - 1, F.lit(0))
    return F.zip_with(F.slice(g, F.lit(1), n), F.slice(g, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b"), distance(a, b).alias("len")))


def length(line: Column | str) -> Column:
    return F.aggregate(segments(line), F.lit(0.0), lambda t, s: t + s["len"])


def cumulative(line: Column | str) -> Column:
    """Distance from the start at every vertex."""
    start = F.array(F.lit(0.0))
    return F.aggregate(segments(line), start, lambda t, s: F.concat(t, F.array(F.element_at(t, -1) + s["len"])))


def located(line: Column | str) -> Column:
    """Segments with the distance at which they begin: struct(a, b, len, at)."""
    g = _col(line)
    return F.zip_with(segments(g), F.slice(cumulative(g), F.lit(1), F.greatest(F.size(g) - 1, F.lit(0))), lambda s, at: F.struct(s["a"].alias("a"), s["b"].alias("b"), s["len"].alias("len"), at.alias("at")))


def point_at(line: Column | str, d: Column) -> Column:
    """The point at distance ``d`` along the line; past an end, that end. Pass stored ``located`` segments to :func:`point_on`."""
    return point_on(located(line), d)


def point_on(parts: Column | str, d: Column) -> Column:
    first = F.element_at(F.filter(_col(parts), lambda s: s["at"] + s["len"] >= d), 1)

    def on(s: Column) -> Column:
        t = F.when(s["len"] > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (d - s["at"]) / s["len"]))).otherwise(0.0)
        return point(s["a"]["x"] + t * (s["b"]["x"] - s["a"]["x"]), s["a"]["y"] + t * (s["b"]["y"] - s["a"]["y"]))

    return let(F.coalesce(first, F.element_at(_col(parts), -1)), on)


def to_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column]:
    """Distance of a point to a segment, and the share of the segment before the nearest place."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / square))).otherwise(0.0)
    ex, ey = px - ax - t * dx, py - ay - t * dy
    return F.sqrt(ex * ex + ey * ey), t


def project(p: Column, line: Column | str) -> Column:
    """struct(dist, along): the nearest place of a line to a point; ties take the first."""

    def one(s: Column) -> Column:
        dist, t = to_segment(p["x"], p["y"], s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"])
        return F.struct(dist.alias("dist"), (s["at"] + t * s["len"]).alias("along"))

    return F.array_min(F.transform(located(line), one))


def bearing(a: Column, b: Column) -> Column:
    """Degrees clockwise from north, 0 to 360."""
    return F.pmod(F.degrees(F.atan2(b["x"] - a["x"], b["y"] - a["y"])) + 360.0, F.lit(360.0))


def turn(before: Column, after: Column) -> Column:
    """Signed change of bearing, -180 to 180."""
    return F.pmod(after - before + 540.0, F.lit(360.0)) - 180.0


def folded(a: Column, b: Column) -> Column:
    """Angle between two undirected lines, 0 to 90."""
    d = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.least(d, F.lit(180.0) - d)


#: Turn angles at which the wording changes.
STRAIGHT, SLIGHT, PLAIN, SHARP = 20.0, 45.0, 120.0, 160.0


def modifier(angle: Column) -> Column:
    size, side = F.abs(angle), F.when(angle < 0, "left").otherwise("right")
    return (
        F.when(size < STRAIGHT, "straight").when(size < SLIGHT, F.concat(F.lit("slight "), side)).when(size < PLAIN, side)
        .when(size < SHARP, F.concat(F.lit("sharp "), side)).otherwise("uturn")
    )


def octant(angle: Column) -> Column:
    names = F.array(*[F.lit(n) for n in ("north", "northeast", "east", "southeast", "south", "southwest", "west", "northwest")])
    return F.element_at(names, (F.floor((angle + 22.5) / 45.0) % 8 + 1).cast("int"))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0088 * F.asin(F.sqrt(a))


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    r = 6378137.0
    return F.radians(lon) * r, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * r


def tile(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Slippy-map tile of a point."""
    n = float(1 << zoom)
    y = (1 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2 * n
    return F.floor((lon + 180) / 360 * n), F.floor(y)


def lambert(lon: Column, lat: Column, lat1: float, lat2: float, lat0: float, lon0: float) -> tuple[Column, Column]:
    """Lambert conformal conic on a sphere, metres; two standard parallels."""
    r, rad = 6371008.8, math.radians
    n = math.log(math.cos(rad(lat1)) / math.cos(rad(lat2))) / math.log(math.tan(math.pi / 4 + rad(lat2) / 2) / math.tan(math.pi / 4 + rad(lat1) / 2))
    f = math.cos(rad(lat1)) * math.tan(math.pi / 4 + rad(lat1) / 2) ** n / n
    rho0 = r * f / math.tan(math.pi / 4 + rad(lat0) / 2) ** n
    rho = F.lit(r * f) / F.pow(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2), F.lit(n))
    angle = F.radians(lon - lon0) * n
    return rho * F.sin(angle), F.lit(rho0) - rho * F.cos(angle)


def ring_area(ring: Column | str) -> Column:
    """Shoelace area of a ring; it need not repeat its first vertex."""
    g = _col(ring)
    after = F.concat(F.slice(g, F.lit(2), F.greatest(F.size(g) - 1, F.lit(0))), F.slice(g, F.lit(1), F.lit(1)))
    return F.abs(F.aggregate(F.zip_with(g, after, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda t, v: t + v)) / 2


def inside(p: Column, ring: Column | str) -> Column:
    """Even-odd rule: whether a ray to the east crosses the ring an odd number of times."""
    g = _col(ring)
    after = F.concat(F.slice(g, F.lit(2), F.greatest(F.size(g) - 1, F.lit(0))), F.slice(g, F.lit(1), F.lit(1)))
    crosses = F.zip_with(g, after, lambda a, b: F.when((a["y"] > p["y"]) != (b["y"] > p["y"]), F.when(p["x"] < (b["x"] - a["x"]) * (p["y"] - a["y"]) / (b["y"] - a["y"]) + a["x"], 1).otherwise(0)).otherwise(0))
    return F.aggregate(crosses, F.lit(0), lambda t, v: t + v) % 2 == 1


def square(x: Column, y: Column, side: Column) -> Column:
    h = side / 2
    return F.array(point(x - h, y - h), point(x + h, y - h), point(x + h, y + h), point(x - h, y + h))


#: Fixed values of the curvature measure: chord and cap a step, shortest road counted.
CHORD, CAP, SHORTEST = 60.0, 25.0, 300.0


def curvature(parts: Column | str, own: Column, road: Column, start: Column | None = None) -> Column:
    """Degrees per km of a piece: capped turns between chords of 60 m, the last one to the piece's end.

    parts: stored ``located`` segments of the road; start: where the piece begins on it; own:
    length of the piece; road: of the whole road. Only a short road's length is raised to the
    shortest counted, so a piece of a long one is measured over the length it has.
    """
    begin = F.lit(0.0) if start is None else start
    n = F.ceil(own / CHORD - 1e-9).cast("int")
    at = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda k: point_on(parts, begin + F.least(k * CHORD, own) - 1e-9))
    neighbours = lambda a, f: F.zip_with(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))), f)
    turns = let(at, lambda a: let(neighbours(a, bearing), lambda h: neighbours(h, lambda x, y: F.least(F.abs(turn(x, y)), F.lit(CAP)))))
    total = F.aggregate(turns, F.lit(0.0), lambda t, v: t + v)
    floor = F.when(road < SHORTEST, F.greatest(own, F.lit(SHORTEST))).otherwise(own)
    return F.when(n >= 2, total / (floor / 1000)).otherwise(0.0)


def stitch(pieces: Column) -> Column:
    """One line from an array of lines, without repeated neighbours."""
    flat = F.flatten(pieces)
    return F.filter(flat, lambda p, i: (i == 0) | (p != F.get(flat, i - 1)))
