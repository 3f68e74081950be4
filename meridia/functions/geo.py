"""Geometry in columns: boxes, distances, rings, affine maps, map projection.

A point is struct<x, y>; a ring is an array of points, closed or not; a box is given by
its four sides."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
KM_PER_LON, KM_PER_LAT = 111.320, 110.574


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box_ring(west: Column, south: Column, east: Column, north: Column) -> Column:
    return F.array(point(west, south), point(east, south), point(east, north), point(west, north), point(west, south))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def equirectangular(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    dx = (lon2 - lon1) * KM_PER_LON * F.cos(F.radians((lat1 + lat2) / 2))
    return F.sqrt(dx * dx + F.pow((lat2 - lat1) * KM_PER_LAT, 2))


def plane(lon: Column, lat: Column, lat0: float) -> Column:
    """Kilometres on a plane whose east-west scale is that of one latitude."""
    return point(lon * KM_PER_LON * math.cos(math.radians(lat0)), lat * KM_PER_LAT)


def overlap_area(w1, s1, e1, n1, w2, s2, e2, n2) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, F.least(e1, e2) - F.greatest(w1, w2)) * F.greatest(zero, F.least(n1, n2) - F.greatest(s1, s2))


def share_inside(w1, s1, e1, n1, w2, s2, e2, n2) -> Column:
    """How much of the first box lies in the second; null if the first has no area."""
    area = (e1 - w1) * (n1 - s1)
    return F.when(area > 0, overlap_area(w1, s1, e1, n1, w2, s2, e2, n2) / area)


def _edges_of(ring: Column) -> Column:
    """The edges of a ring, which is computed once, however it is made."""
    edge = lambda r, i: F.struct(F.element_at(r, i).alias("a"), F.element_at(r, F.when(i < F.size(r), i + 1).otherwise(1)).alias("b"))
    return _let(ring, lambda r: F.transform(F.sequence(F.lit(1), F.size(r)), lambda i: edge(r, i)))


def shoelace(ring: Column) -> Column:
    """Area of a ring."""
    terms = F.transform(_edges_of(ring), lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda t, x: t + x)) / 2


def in_convex(x: Column, y: Column, ring: Column) -> Column:
    """Inside a convex ring, its boundary included: one sign at all edges."""
    cross = F.transform(_edges_of(ring), lambda e: (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) - (e["b"]["y"] - e["a"]["y"]) * (x - e["a"]["x"]))
    return F.forall(cross, lambda c: c >= 0) | F.forall(cross, lambda c: c <= 0)


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Inside any ring, by the parity of the edges that a ray crosses."""
    crossed = F.filter(_edges_of(ring), lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]))
    return F.size(crossed) % 2 == 1


def inset(ring: Column, metres: float) -> Column:
    """A ring drawn in towards its corners' mean by about a length: all corners by the same
    share, that of the length in their mean distance. A ring no larger stays as it is."""
    n = F.size(ring)
    zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    total = F.aggregate(ring, zero, lambda t, p: F.struct((t["x"] + p["x"]).alias("x"), (t["y"] + p["y"]).alias("y")))

    def drawn(mean: Column) -> Column:
        far = F.aggregate(ring, F.lit(0.0), lambda t, p: t + F.hypot(p["x"] - mean["x"], p["y"] - mean["y"])) / n
        part = F.when(far > metres, 1 - F.lit(float(metres)) / far).otherwise(1.0)
        return F.transform(ring, lambda p: F.struct((mean["x"] + (p["x"] - mean["x"]) * part).alias("x"), (mean["y"] + (p["y"] - mean["y"]) * part).alias("y")))

    return _let(F.struct((total["x"] / n).alias("x"), (total["y"] / n).alias("y")), drawn)


def apply_affine(m, x: Column, y: Column) -> tuple[Column, Column]:
    """m: (a, b, c, d, e, f) with x' = a x + b y + c and y' = d x + e y + f."""
    return m[0] * x + m[1] * y + m[2], m[3] * x + m[4] * y + m[5]


def invert_affine(m, u: Column, v: Column) -> tuple[Column, Column]:
    det = m[0] * m[4] - m[1] * m[3]
    return (m[4] * (u - m[2]) - m[1] * (v - m[5])) / det, (m[0] * (v - m[5]) - m[3] * (u - m[2])) / det


GRADE, PARIS = 0.9, 2.33722917


def from_grades(g: Column) -> Column:
    """Degrees east of Greenwich from grades east of Paris."""
    return g * GRADE + PARIS


@dataclass(frozen=True)
class Zone:
    """A conformal conic zone with one standard parallel, and its datum's shift."""

    lat0: float
    k0: float
    shift: tuple[float, float, float]
    lon0: float = 9.9
    east0: float = 500000.0
    north0: float = 300000.0
    a: float = 6378249.2
    rf: float = 293.466021293627


NORTH = Zone(36.0, 0.999625544, (-260.1, 5.5, 432.2))
SOUTH = Zone(33.3, 0.999625769, (-263.0, 6.0, 431.0))
WGS_A, WGS_RF = 6378137.0, 298.257223563


def _e2(rf: float) -> float:
    return (2 - 1 / rf) / rf


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often use names it."""
    return F.transform(F.array(value), use)[0]


def _iterate(start: Column, step, times: int) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.lit(times)), start, lambda acc, _: step(acc))


def _shifted(lon: Column, lat: Column, a1: float, rf1: float, a2: float, rf2: float, shift) -> Column:
    """struct<lon, lat> on the second ellipsoid, by way of geocentric metres."""
    e1, e2 = _e2(rf1), _e2(rf2)
    n = a1 / F.sqrt(1 - e1 * F.pow(F.sin(lat), 2))
    metres = _let(F.struct(lon.alias("g"), lat.alias("f"), n.alias("n")), lambda q: F.struct((q["n"] * F.cos(q["f"]) * F.cos(q["g"]) + shift[0]).alias("x"), (q["n"] * F.cos(q["f"]) * F.sin(q["g"]) + shift[1]).alias("y"), (q["n"] * (1 - e1) * F.sin(q["f"]) + shift[2]).alias("z")))

    def back(m: Column) -> Column:
        p = F.sqrt(m["x"] * m["x"] + m["y"] * m["y"])
        step = lambda f: F.atan2(m["z"] + e2 * (a2 / F.sqrt(1 - e2 * F.pow(F.sin(f), 2))) * F.sin(f), p)
        return F.struct(F.atan2(m["y"], m["x"]).alias("lon"), _iterate(F.atan2(m["z"], p * (1 - e2)), step, 5).alias("lat"))

    return _let(metres, back)


def _iso(lat: Column, e: float) -> Column:
    return F.tan(math.pi / 4 - lat / 2) * F.pow((1 + e * F.sin(lat)) / (1 - e * F.sin(lat)), e / 2)


def _cone(z: Zone) -> tuple[float, float, float]:
    """The cone's constant, and the isometric ratio and the radius of its parallel."""
    e = math.sqrt(_e2(z.rf))
    p = math.radians(z.lat0)
    iso0 = math.tan(math.pi / 4 - p / 2) * ((1 + e * math.sin(p)) / (1 - e * math.sin(p))) ** (e / 2)
    return math.sin(p), iso0, z.k0 * (z.a / math.sqrt(1 - _e2(z.rf) * math.sin(p) ** 2)) / math.tan(p)


def project(lon: Column, lat: Column, z: Zone) -> Column:
    """struct<x, y>, easting and northing, of WGS 84 degrees."""
    e = math.sqrt(_e2(z.rf))
    n, iso0, r0 = _cone(z)

    def conic(q: Column) -> Column:
        r, g = r0 * F.pow(_iso(q["lat"], e) / iso0, n), n * (q["lon"] - math.radians(z.lon0))
        return point(z.east0 + r * F.sin(g), z.north0 + r0 - r * F.cos(g))

    return _let(_shifted(F.radians(lon), F.radians(lat), WGS_A, WGS_RF, z.a, z.rf, tuple(-s for s in z.shift)), conic)


def unproject(east: Column, north: Column, z: Zone) -> Column:
    """struct<x, y>, WGS 84 degrees, of easting and northing: the place that ``project`` takes
    there. A datum's shift drops the height, so that the shift back is some centimetres off
    far from the zone; what it is off by when shifted again is taken off it, twice."""
    e = math.sqrt(_e2(z.rf))
    n, iso0, r0 = _cone(z)
    dx, dy = east - z.east0, z.north0 + r0 - north
    t = iso0 * F.pow(F.sqrt(dx * dx + dy * dy) / r0, 1 / n)

    def latitude(t: Column) -> Column:
        step = lambda s: math.pi / 2 - 2 * F.atan(t * F.pow((1 - e * F.sin(s)) / (1 + e * F.sin(s)), e / 2))
        return _iterate(math.pi / 2 - 2 * F.atan(t), step, 6)

    there = lambda lon, lat: _shifted(lon, lat, WGS_A, WGS_RF, z.a, z.rf, tuple(-s for s in z.shift))
    turn = lambda a: F.when(a > math.pi, a - 2 * math.pi).when(a <= -math.pi, a + 2 * math.pi).otherwise(a)

    def nearer(own: Column, p: Column) -> Column:
        return _let(there(p["lon"], p["lat"]), lambda r: F.struct(_let(p["lon"] + _let(own["lon"] - r["lon"], turn), turn).alias("lon"), (p["lat"] + own["lat"] - r["lat"]).alias("lat")))

    def back(own: Column) -> Column:
        first = _shifted(own["lon"], own["lat"], z.a, z.rf, WGS_A, WGS_RF, z.shift)
        return _iterate(first, lambda p: nearer(own, p), 2)

    own = F.struct((F.atan2(dx, dy) / n + math.radians(z.lon0)).alias("lon"), _let(t, latitude).alias("lat"))
    return _let(_let(own, back), lambda q: point(F.degrees(q["lon"]), F.degrees(q["lat"])))


def spread_of(ring: Column) -> Column:
    """Twice the area of the corner at a quadrilateral's second point: a cheap measure of two
    nearly parallel sheets' sizes."""

    def cross(r: Column) -> Column:
        p, q, o = (F.element_at(r, k) for k in (1, 3, 2))
        return F.abs((o["x"] - p["x"]) * (q["y"] - o["y"]) - (o["y"] - p["y"]) * (q["x"] - o["x"]))

    return _let(ring, cross)


def shared_footprint(first: Column, second: Column, inset_by: float) -> Column:
    """What two sheets of the same ground share: the smaller of the two quadrilaterals, each
    drawn in towards its centre; the first of equals."""
    both = F.array(inset(first, inset_by), inset(second, inset_by))
    return _let(both, lambda r: F.when(spread_of(r[1]) < spread_of(r[0]), r[1]).otherwise(r[0]))


def clip_box(box: Column, corners: Column) -> Column:
    """A stated box moved to where a sheet's corners (array of points) have their middle: the
    size of the one, the position of the other. Without corners the box as it is; without a
    box, null."""
    n = F.size(corners)
    mean = lambda axis: F.aggregate(F.transform(corners, lambda p: p[axis]), F.lit(0.0), lambda t, v: t + v) / n
    x, y = (box["east"] - box["west"]) / 2, (box["north"] - box["south"]) / 2
    moved = F.struct((mean("x") - x).alias("west"), (mean("y") - y).alias("south"), (mean("x") + x).alias("east"), (mean("y") + y).alias("north"))
    as_is = F.struct(*[box[k].cast("double").alias(k) for k in ("west", "south", "east", "north")])
    return F.when(box.isNull(), F.lit(None)).when(corners.isNull() | (n == 0), as_is).otherwise(moved)


def in_clip(x: Column, y: Column, box: Column, margin: float) -> Column:
    """Whether a point lies in a box drawn in by a margin; any point does where there is none."""
    return box.isNull() | (x.between(box["west"] + margin, box["east"] - margin) & y.between(box["south"] + margin, box["north"] - margin))


def evidence_points(at: Column, extent: Column) -> Column:
    """A label's points on a plane: the one it stands at or, where its printed name was
    measured, the name's two ends."""
    end = lambda sign: point(at["x"] + sign * extent / 2, at["y"])
    return F.when(F.coalesce(extent, F.lit(0.0)) != 0, F.array(end(-1), end(1))).otherwise(F.array(point(at["x"], at["y"])))


def corner_spans(north_west: Column, north_east: Column, south_west: Column, east: tuple[Column, Column], north: tuple[Column, Column]) -> Column:
    """struct<width_km, height_km, scale_x, scale_y, rotation_deg> of a sheet placed by its
    corners: distances in kilometres, and what the map's coefficients (easting and northing
    by pixel column and row) say of its scales and its turn."""
    span = lambda a, b: F.hypot(a["x"] - b["x"], a["y"] - b["y"]) / 1000
    return F.struct(
        span(north_west, north_east).alias("width_km"), span(north_west, south_west).alias("height_km"), F.hypot(east[0], north[0]).alias("scale_x"), F.hypot(east[1], north[1]).alias("scale_y"),
        F.degrees(F.atan2(-north[0], east[0])).alias("rotation_deg"),
    )
