"""Rings and hulls against areas by a sweep over x."""

import random

import pytest

from meridia.operators import rings


def sweep_area(inside, *shapes):
    """Area of the points for which ``inside`` holds of the numbers of sides above them, one
    for each shape: between two neighbouring places where sides begin, end or cross, it is
    a trapezium."""
    sides = [(a, b, k) for k, ring in enumerate(shapes) for a, b in zip(ring, ring[1:] + ring[:1], strict=True) if a[0] != b[0]]
    xs = {p[0] for s in sides for p in s[:2]}
    for i, (a, b, _) in enumerate(sides):
        for c, d, _ in sides[:i]:
            r, s = (b[0] - a[0], b[1] - a[1]), (d[0] - c[0], d[1] - c[1])
            cross = r[0] * s[1] - r[1] * s[0]
            if cross:
                u = ((c[0] - a[0]) * s[1] - (c[1] - a[1]) * s[0]) / cross
                if 0 <= u <= 1:
                    xs.add(a[0] + u * r[0])
    xs, total = sorted(xs), 0.0
    for lo, hi in zip(xs, xs[1:], strict=False):
        mid = (lo + hi) / 2
        cuts = sorted((a[1] + (mid - a[0]) / (b[0] - a[0]) * (b[1] - a[1]), k) for a, b, k in sides if min(a[0], b[0]) < mid < max(a[0], b[0]))
        below = [0] * len(shapes)
        for (y, k), (z, _) in zip(cuts, cuts[1:], strict=False):
            below[k] += 1
            if inside(below):
                total += (z - y) * (hi - lo)
    return total


def ring_of(r, n):
    return [(r.uniform(0, 10), r.uniform(0, 10)) for _ in range(n)]


def test_mended_rings_by_the_sweep():
    r = random.Random(1)
    for n in (3, 4, 5, 6, 8, 12):
        for _ in range(40):
            ring = ring_of(r, n)
            parts = rings.mended(ring)
            assert sum(map(rings.signed_area, parts)) == pytest.approx(sweep_area(lambda c: c[0] % 2, ring), rel=1e-9)
            # no part crosses itself: mended again it is what it was
            assert all(len(rings.mended(p)) == 1 and set(rings.mended(p)[0]) <= set(p) for p in parts)


def test_known_rings():
    bow = [(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 4.0)]
    assert [rings.signed_area(p) for p in rings.mended(bow)] == [4.0, 4.0]
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    assert rings.mended(square) == rings.mended([*square, square[0]]) == rings.mended(square[::-1]) == [square]
    # a spike, a doubled corner, a side run twice
    assert sum(map(rings.signed_area, rings.mended([*square[:2], (5.0, 0.0), *square[1:]]))) == 4.0
    touching = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 0.0), (0.0, 4.0)]
    assert sum(map(rings.signed_area, rings.mended(touching))) == pytest.approx(sweep_area(lambda c: c[0] % 2, touching))
    assert rings.mended([]) == rings.mended([(1.0, 1.0)] * 5) == rings.mended([(0.0, 0.0), (1.0, 1.0)]) == []


def test_upright_sides_that_are_crossed():
    """A crossing on an upright side may be a last place off it: the side is upright still."""
    r = random.Random(4)
    for _ in range(2000):
        ring = [(float(r.randrange(101)), float(r.randrange(97))) for _ in range(r.randint(4, 6))]
        ring[2] = (ring[1][0], ring[2][1])
        parts = rings.mended(ring)
        assert sum(map(rings.signed_area, parts)) == pytest.approx(sweep_area(lambda c: c[0] % 2, ring), abs=1e-6)


def test_clipped_by_the_sweep():
    r = random.Random(2)
    for _ in range(150):
        convex = rings.hull(ring_of(r, r.randint(3, 12)))
        for part in rings.mended(ring_of(r, r.randint(3, 8))):
            want = sweep_area(lambda c: c[0] % 2 and c[1] % 2, part, convex)
            assert abs(rings.signed_area(rings.clipped(part, convex))) == pytest.approx(want, abs=1e-9)


def test_hulls_in_units(spark):
    r = random.Random(3)
    points = [(u, r.uniform(0, 10), r.uniform(0, 10)) for u in ("a", "b") for _ in range(400)] + [("c", 1.0, 1.0), ("c", 2.0, 2.0), ("c", 3.0, 3.0), ("a", None, 1.0)]
    hollow = [(1.0, 1.0), (9.0, 1.0), (9.0, 9.0), (5.0, 2.0), (1.0, 9.0)]
    hole = [(2.0, 1.5), (2.0, 2.0), (3.0, 2.0), (3.0, 1.5)]
    units = [("a", [hollow, hole]), ("b", [[(-5.0, -5.0), (20.0, -5.0), (20.0, 20.0), (-5.0, 20.0)]]), ("c", [hollow]), ("d", [hollow])]
    listed = spark.createDataFrame(units, "unit string, rings array<array<struct<x:double,y:double>>>")
    df = spark.createDataFrame(points, "unit string, x double, y double").repartition(5)
    got = {x.unit: x for x in rings.hulls_in_units(df, listed, "unit").collect()}
    for u, own in (("a", [hollow, hole]), ("b", units[1][1])):
        whole = rings.hull([(x, y) for v, x, y in points if v == u and x is not None])
        assert got[u].corners == len(whole) and got[u].hull_area == pytest.approx(sweep_area(lambda c: c[0], whole))
        assert got[u].area == pytest.approx(sum(s * sweep_area(lambda c: c[0] % 2 and c[1] % 2, ring, whole) for s, ring in zip((1, -1), own, strict=False)))
    assert got["c"].area == got["d"].area == 0.0 and set(got) == set("abcd")


def test_mend_table(spark):
    bow = [(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 4.0), (0.0, 0.0)]
    df = spark.createDataFrame([(1, bow), (2, None), (3, [])], "id long, ring array<struct<x:double,y:double>>")
    got = rings.mend_rings(df, "id", "ring").collect()
    assert [(r.id, r.part, r.hole, r.area, len(r.ring)) for r in got] == [(1, 0, False, 4.0, 3), (1, 1, False, 4.0, 3)]
