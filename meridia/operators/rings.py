"""Rings: mending those that cross themselves, hulls of any number of points, and what a hull
and a polygon have in common.

Mending cuts a ring at its crossings, turns every side so that the inside is on its left
(inside is what an odd number of sides lies below: the even-odd rule), and follows the sides
to simple rings, outer ones and holes. Hulls are made task by task and then
of the corners that are left: no group's points meet in one task, only the corners of its
partial hulls. A polygon, which may be hollow in places, is clipped by the hull's sides, one
half-plane after another."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Point = tuple[float, float]
RING = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
RING_SQL = "array<struct<x:double,y:double>>"


def signed_area(ring: Sequence[Point]) -> float:
    """Twice over by the sides, halved; from the first corner, so that far-off rings lose nothing."""
    if len(ring) < 3:
        return 0.0
    ox, oy = ring[0]
    at = [(x - ox, y - oy) for x, y in ring]
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(at, at[1:] + at[:1], strict=True)) / 2


def _sides(ring: list[Point]) -> list[tuple[Point, Point]]:
    return list(zip(ring, ring[1:] + ring[:1], strict=True))


def _open(ring: Sequence[Point]) -> list[Point]:
    """Without its closing point and points that repeat the one before."""
    out = [p for k, p in enumerate(ring) if k == 0 or p != ring[k - 1]]
    while len(out) > 1 and out[0] == out[-1]:
        out.pop()
    return out


def _meeting(a: Point, b: Point, c: Point, d: Point) -> list[Point]:
    """Points in which two sides meet: one, or the ends of what they share, or none."""
    r, s, t = (b[0] - a[0], b[1] - a[1]), (d[0] - c[0], d[1] - c[1]), (c[0] - a[0], c[1] - a[1])
    cross = r[0] * s[1] - r[1] * s[0]
    if cross:
        u, v = (t[0] * s[1] - t[1] * s[0]) / cross, (t[0] * r[1] - t[1] * r[0]) / cross
        if not (0 <= u <= 1 and 0 <= v <= 1):
            return []
        # a corner is met as it is, not as it is computed
        return [next((p for p, w, k in ((a, u, 0), (b, u, 1), (c, v, 0), (d, v, 1)) if w == k), (a[0] + u * r[0], a[1] + u * r[1]))]
    if t[0] * r[1] - t[1] * r[0]:
        return []
    between = lambda p, q, z: min(p[0], q[0]) <= z[0] <= max(p[0], q[0]) and min(p[1], q[1]) <= z[1] <= max(p[1], q[1])
    return [p for p in (c, d) if between(a, b, p)] + [p for p in (a, b) if between(c, d, p)]


def _noded(ring: list[Point]) -> list[Point]:
    """The ring with every point in which it meets itself as a corner. Sides are taken in
    order of their west ends, so that only those that overlap in x are compared."""
    sides, cuts = _sides(ring), [set() for _ in ring]
    order = sorted(range(len(sides)), key=lambda k: min(sides[k][0][0], sides[k][1][0]))
    live: list[int] = []
    for k in order:
        west = min(sides[k][0][0], sides[k][1][0])
        live = [j for j in live if max(sides[j][0][0], sides[j][1][0]) >= west]
        for j in live:
            for p in _meeting(*sides[j], *sides[k]):
                cuts[j].add(p)
                cuts[k].add(p)
        live.append(k)
    out: list[Point] = []
    for (a, b), own in zip(sides, cuts, strict=True):
        along = sorted(own | {a}, key=lambda p: (p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1]))
        out += [p for p in along if p != b]
    return _open(out)


def _split(path: list[Point]) -> list[list[Point]]:
    """The simple loops of a closed path that touches itself and does not cross: on coming
    back to a point, what lies between is one."""
    out, held, place = [], [], {}
    for p in path:
        if p in place:
            start = place[p]
            out.append(held[start:])
            for q in held[start + 1 :]:
                del place[q]
            del held[start + 1 :]
        else:
            place[p] = len(held)
            held.append(p)
    return [x for x in [*out, held] if len(x) > 2]


def _directed(ring: list[Point]) -> list[tuple[Point, Point]]:
    """The sides between the ring's crossings, each with the inside on its left. A side that
    is run twice bounds nothing. Above a side is inside if an even number of others lie below."""
    odd: set[tuple[Point, Point]] = set()
    for p, q in _sides(_noded(ring)):
        odd ^= {(min(p, q), max(p, q))}
    out = []
    for a, b in odd:
        # a steep side is looked at from the west: its middle is then well between its ends
        axis = 0 if abs(b[0] - a[0]) >= abs(b[1] - a[1]) else 1
        a, b = (a, b) if a[axis] < b[axis] else (b, a)
        x, y = (a[axis] + b[axis]) / 2, (a[1 - axis] + b[1 - axis]) / 2
        under = 0
        for c, d in odd:
            if {c, d} != {a, b} and (c[axis] > x) != (d[axis] > x):
                under += c[1 - axis] + (x - c[axis]) / (d[axis] - c[axis]) * (d[1 - axis] - c[1 - axis]) < y
        out.append((a, b) if (under % 2 == 0) == (axis == 0) else (b, a))
    return out


def mended(ring: Sequence[Point]) -> list[list[Point]]:
    """Outer rings counterclockwise, holes clockwise, the largest first. As many sides must
    lead to a corner as lead away; where rounded crossings break that, sides are found anew
    in fractions, in which nothing is rounded."""
    sides = _directed(_open(ring))
    if Counter(a for a, _ in sides) != Counter(b for _, b in sides):
        sides = _directed([(Fraction(x), Fraction(y)) for x, y in _open(ring)])
    ways: dict[Point, list[Point]] = {}
    for a, b in sides:
        ways.setdefault(a, []).append(b)
    left, out = set(sides), []
    for start in sorted(sides):
        path, (u, v) = [], start
        while (u, v) in left:
            left.discard((u, v))
            path.append(u)
            # the inside is to the right of the way back: it ends at the next side clockwise
            back = math.atan2(u[1] - v[1], u[0] - v[0])
            turn = lambda w, v=v, back=back: (back - math.atan2(w[1] - v[1], w[0] - v[0])) % (2 * math.pi) or 2 * math.pi
            u, v = v, min((w for w in ways[v] if (v, w) in left), key=turn, default=start[1])
        out += _split(path)
    out = [[(float(x), float(y)) for x, y in part] for part in out]
    return sorted(out, key=lambda x: -abs(signed_area(x)))


def hull(points: Sequence[Point]) -> list[Point]:
    """Corners of the convex hull, counterclockwise (monotone chain)."""
    pts = sorted(set(points))

    def chain(seq):
        out: list[Point] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(pts) + chain(pts[::-1]) if len(pts) > 2 else pts


def clipped(ring: Sequence[Point], convex: list[Point]) -> list[Point]:
    """What of a ring lies in a convex, counterclockwise one; its area is exact, though parts
    of a hollow ring stay joined by sides that run to and fro."""
    out = _open(ring)
    for (ax, ay), (bx, by) in _sides(convex):
        off = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x, y in out]
        cut: list[Point] = []
        for k, (p, q) in enumerate(_sides(out)):
            a, b = off[k], off[(k + 1) % len(out)]
            if a >= 0:
                cut.append(p)
            if (a >= 0) != (b >= 0):
                f = a / (a - b)
                cut.append((p[0] + f * (q[0] - p[0]), p[1] + f * (q[1] - p[1])))
        out = cut
    return out


def _points(listed) -> list[Point]:
    return [(p["x"], p["y"]) for p in listed or [] if p and p["x"] is not None and p["y"] is not None]


def _struct(ring: list[Point]) -> list[dict]:
    return [{"x": x, "y": y} for x, y in ring]


def mend_rings(df: DataFrame, key: str, ring: str) -> DataFrame:
    """key, part, hole, ring, area of each ring (array of struct x, y) that is not empty: its
    simple parts, by falling size, each closed by its order alone."""

    def run(batches):
        for b in batches:
            keys, parts, holes, rings, areas = [], [], [], [], []
            for k, listed in zip(b.column("k").to_pylist(), b.column("ring").to_pylist(), strict=True):
                for n, x in enumerate(mended(_points(listed))):
                    area = signed_area(x)
                    keys.append(k)
                    parts.append(n)
                    holes.append(area < 0)
                    rings.append(_struct(x))
                    areas.append(abs(area))
            yield pa.record_batch([pa.array(keys, b.schema.field("k").type), pa.array(parts, pa.int32()), pa.array(holes, pa.bool_()), pa.array(rings, RING), pa.array(areas, pa.float64())], names=["k", "part", "hole", "ring", "area"])

    rows = df.select(F.col(key).alias("k"), F.col(ring).cast(RING_SQL).alias("ring"))
    return rows.mapInArrow(run, f"k {dict(rows.dtypes)['k']}, part int, hole boolean, ring {RING_SQL}, area double").withColumnRenamed("k", key)


#: Corners of partial hulls that a task holds before it hands them on.
HELD = 200_000


def hull_corners(points: DataFrame, group: str) -> DataFrame:
    """group, x, y: the corners of each task's part of each group's hull."""

    def run(batches):
        held: dict = {}
        n = 0

        def flushed(kind):
            rows = [(g, x, y) for g, ring in held.items() for x, y in ring]
            g, x, y = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.record_batch([pa.array(g, kind), pa.array(x, pa.float64()), pa.array(y, pa.float64())], names=["g", "x", "y"])

        kind = None
        for b in batches:
            kind = b.schema.field("g").type
            own: dict = {}
            for g, x, y in zip(*(b.column(c).to_pylist() for c in ("g", "x", "y")), strict=True):
                own.setdefault(g, []).append((x, y))
            for g, pts in own.items():
                old = held.get(g, [])
                held[g] = hull(old + pts)
                n += len(held[g]) - len(old)
            if n > HELD:
                yield flushed(kind)
                held.clear()
                n = 0
        if kind is not None:
            yield flushed(kind)

    rows = points.select(F.col(group).alias("g"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x is not null and y is not null")
    return rows.mapInArrow(run, f"g {dict(rows.dtypes)['g']}, x double, y double").withColumnRenamed("g", group)


def hulls_in_units(points: DataFrame, units: DataFrame, unit: str) -> DataFrame:
    """unit, corners, hull_area, area: each unit's (unit, rings: array of rings, holes
    clockwise) hull of its own points, and what of the unit lies in it. Units without three
    points in a triangle have no area."""
    corners = hull_corners(points, unit).groupBy(unit).agg(F.collect_set(F.struct("x", "y")).alias("pts"))

    def run(batches):
        for b in batches:
            n, whole, inside = [], [], []
            for pts, rings in zip(b.column("pts").to_pylist(), b.column("rings").to_pylist(), strict=True):
                ring = hull(_points(pts))
                full = len(ring) > 2
                n.append(len(ring))
                whole.append(signed_area(ring) if full else 0.0)
                inside.append(abs(sum(signed_area(clipped(_points(r), ring)) for r in rings or [])) if full else 0.0)
            yield pa.record_batch([b.column("u"), pa.array(n, pa.int64()), pa.array(whole, pa.float64()), pa.array(inside, pa.float64())], names=["u", "corners", "hull_area", "area"])

    rows = units.select(F.col(unit).alias("u"), F.col("rings").cast(f"array<{RING_SQL}>").alias("rings")).join(corners.withColumnRenamed(unit, "u"), "u", "left")
    kind = dict(rows.dtypes)["u"]
    return rows.select("u", "rings", "pts").mapInArrow(run, f"u {kind}, corners long, hull_area double, area double").withColumnRenamed("u", unit)
