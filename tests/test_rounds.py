"""Regions, greedy rounds, lattice search and streamed line groups against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from meridia.operators import regions, rounds, sequences, spatial


@pytest.mark.parametrize("share,tile", [(0.3, 7), (0.55, 16), (0.62, 5)])
def test_regions_against_flood_fill(spark, share, tile):
    r = random.Random(int(share * 100))
    cells = {(s, x, y) for s in ("p", "q") for x in range(-20, 25) for y in range(-15, 20) if r.random() < share}
    left, want = set(cells), {}
    while left:
        todo, own = [left.pop()], set()
        while todo:
            s, x, y = todo.pop()
            own.add((s, x, y))
            for n in ((s, x + 1, y), (s, x - 1, y), (s, x, y + 1), (s, x, y - 1)):
                if n in left:
                    left.discard(n)
                    todo.append(n)
        first = min((y, x) for _, x, y in own)
        want |= {c: first for c in own}
    rows = list(cells) + list(cells)[:50] + [("p", None, 1)]
    got = regions.regions(spark.createDataFrame(rows, "s string, x int, y int"), ["s"], tile)
    number = lambda y, x: (y + regions.HALF) * 2 * regions.HALF + x + regions.HALF
    assert {(c.s, c.x, c.y): c.label for c in got.collect()} == {k: number(*v) for k, v in want.items()}
    sums = {(c.s, c.label): c for c in regions.reduce_regions(got, ["s"]).collect()}
    for (s, y, x), own in _groups(want).items():
        c = sums[s, number(y, x)]
        assert (c.cells, c.x0, c.x1, c.y0, c.y1) == (len(own), min(x for x, _ in own), max(x for x, _ in own), min(y for _, y in own), max(y for _, y in own))
        assert abs(c.cx - sum(x for x, _ in own) / len(own)) < 1e-9 and c.widest == max(sum(1 for _, b in own if b == y) for _, y in own)


def _groups(want):
    out = {}
    for (s, x, y), (fy, fx) in want.items():
        out.setdefault((s, fy, fx), []).append((x, y))
    return out


def test_only_regions_at_a_border_are_joined(spark, monkeypatch):
    numbered, whole = [], regions.connected_components
    monkeypatch.setattr(regions, "connected_components", lambda edges, *ends: numbered.append(edges.count()) or whole(edges, *ends))
    monkeypatch.setattr(regions, "CELLS_A_TASK", 3)
    # one over the border of x = 8, one at a border by itself, two inside a tile; and a sheet of no name
    spots = [(7, 3), (8, 3), (9, 3), (0, 5), (2, 2), (3, 2), (2, 3), (12, 12)]
    rows = [(s, x, y) for s in ("p", None) for x, y in spots]
    got = regions.regions(spark.createDataFrame(rows, "s string, x int, y int"), ["s"], 8).cache()
    number = lambda y, x: (y + regions.HALF) * 2 * regions.HALF + x + regions.HALF
    want = dict.fromkeys([(7, 3), (8, 3), (9, 3)], (3, 7)) | {(0, 5): (5, 0), (12, 12): (12, 12)} | dict.fromkeys([(2, 2), (3, 2), (2, 3)], (2, 2))
    assert {(c.s, c.x, c.y): c.label for c in got.collect()} == {(s, *k): number(*v) for s in ("p", None) for k, v in want.items()}
    assert {(c.x, c.y) for c in got.where("open").collect()} == {(7, 3), (8, 3), (9, 3), (0, 5)} and numbered == [2]
    sums = regions.reduce_regions(got, ["s"])
    assert sorted((c.s or "", c.label, c.cells, c.widest) for c in sums.collect()) == sorted((s, number(*v), n, w) for s in ("", "p") for v, n, w in [((3, 7), 3, 3), ((5, 0), 1, 1), ((2, 2), 3, 2), ((12, 12), 1, 1)])
    assert "RepartitionByExpression [s" in (plan := sums._jdf.queryExecution().optimizedPlan().toString()) and ", 3" in next(line for line in plan.splitlines() if "RepartitionByExpression [s" in line)


def test_no_cells(spark):
    assert regions.regions(spark.createDataFrame([], "x int, y int")).count() == 0


def test_colours_as_in_one_pass(spark):
    r = random.Random(8)
    edges = [(g, *r.sample(range(30), 2)) for g in (1, 2) for _ in range(120)] + [(1, 5, 5)]
    want = {}
    for g in (1, 2):
        near = {}
        for _, a, b in (e for e in edges if e[0] == g and e[1] != e[2]):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        for n in sorted(near, key=lambda n: (-len(near[n]), n)):
            used = {want[g, m] for m in near[n] if (g, m) in want}
            want[g, n] = next(c for c in range(99) if c not in used)
    got = spatial.colours(spark.createDataFrame(edges, "g int, a long, b long"), "g")
    assert {(x.g, x.node): x.colour for x in got.collect()} == want and max(want.values()) > 3


def test_told_edges_are_not_looked_at_again(spark, monkeypatch):
    open_edges, whole = [], rounds.stored

    def counted(df):
        out = whole(df)
        if "high" in df.columns:
            open_edges.append(out[0].where("colour is null").count())
        return out

    monkeypatch.setattr(rounds, "stored", counted)
    chain = spark.createDataFrame([(n + 1, n) for n in range(5)] + [(4, 2)], "low long, high long")
    nodes = spark.range(7).withColumn("name", F.concat(F.lit("n"), "id"))
    got = rounds.first_free_colours(nodes, chain)
    assert {r.name: r.colour for r in got.collect()} == {"n0": 0, "n1": 1, "n2": 0, "n3": 1, "n4": 2, "n5": 0, "n6": 0}
    assert open_edges == [6, 5, 4, 2, 1, 0, 0]
    assert rounds.first_free_colours(nodes.limit(0), chain).count() == 0


def test_colours_of_edges_given_twice(spark):
    once = [(1, 5, 2), (1, 2, 9), (1, 9, 5), (2, 5, 2)]
    got = lambda rows: sorted(tuple(r) for r in spatial.colours(spark.createDataFrame(rows, "g int, a long, b long"), "g").collect())
    assert got(once) == [(1, 2, 0), (1, 5, 1), (1, 9, 2), (2, 2, 0), (2, 5, 1)] == got(once + [(g, b, a) for g, a, b in once] + once + [(1, None, 3), (1, 7, 7)])


def test_borne_out_by_grounded_nodes(spark, monkeypatch):
    monkeypatch.setattr(spatial, "EDGES_A_TASK", 40)
    r = random.Random(13)
    edges = [tuple(r.sample(range(60), 2)) for _ in range(150)]
    rows = edges + [(b, a) for a, b in edges[:40]] + edges[:20] + [(3, 3), (None, 4), (5, None)]
    grounded, wanted = set(range(0, 60, 3)), set(range(50))
    near = {n: {m for e in edges for m in e if n in e and m != n and m in grounded} for n in wanted - grounded}
    make = lambda ids: spark.createDataFrame([(n,) for n in ids], "id long")
    got = spatial.one_hop(make(wanted), make([*grounded, 0, 3]), spark.createDataFrame(rows, "a long, b long"))
    assert {x.id: x.support for x in got.collect()} == {n: len(m) for n, m in near.items() if len(m) >= 2}
    # tasks follow the number of edges: 213 of them, 40 a task
    assert "RepartitionByExpression [id" in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and ", 6" in plan[plan.index("RepartitionByExpression [id") :].splitlines()[0]


def test_independent_as_in_one_pass(spark):
    r = random.Random(9)
    order = list(range(60))
    edges = {tuple(sorted(r.sample(order, 2), reverse=True)) for _ in range(90)}  # low is after high
    kept = []
    for n in order:
        if not any((n, k) in edges for k in kept):
            kept.append(n)
    got = rounds.independent(spark.createDataFrame([(n,) for n in order], "id long"), spark.createDataFrame(list(edges), "low long, high long"))
    assert sorted(x.id for x in got.collect()) == kept
    chain = spark.createDataFrame([(n + 1, n) for n in range(8)], "low long, high long")
    assert sorted(x.id for x in rounds.independent(spark.range(9), chain).collect()) == [0, 2, 4, 6, 8]


def test_line_groups_over_gaps(spark):
    r = random.Random(10)
    rows = [(k, r.choice([0, 30, 80, 81, 300]) + r.uniform(0, 9), r.choice([2.0, 4.0])) for k in "ab" for _ in range(150)]
    want = []
    for k in "ab":
        lines = []
        for _, p, s in sorted(x for x in rows if x[0] == k):
            hit = next((x for x in lines if abs(x[0] / x[1] - p) <= s / 2), None)
            if hit:
                hit[0] += p
                hit[1] += 1
            else:
                lines.append([p, 1])
        want += [(k, n, round(t / m, 9), m) for n, (t, m) in enumerate(lines)]
    got = sequences.line_groups(spark.createDataFrame(rows, "k string, p double, s double"), ["k"], "p", "s")
    assert sorted((x.k, x.line, round(x["mean"], 9), x.members) for x in got.collect()) == sorted(want)


def test_lattice_found_unaided(spark):
    r = random.Random(11)
    rows = []
    for k, (step, origin) in enumerate([(9.25, 3.0), (17.5, 0.5), (12.0, 11.75)]):
        rows += [(k, origin + step * n + r.uniform(-0.2, 0.2)) for n in range(-3, 18) if n % 5]
        rows += [(k, r.uniform(-40, 200)) for _ in range(3)]
    got = {x.k: x for x in sequences.lattice_search(spark.createDataFrame(rows, "k int, p double"), ["k"], "p", [8 + n / 8 for n in range(90)], 0.25, 0.1).collect()}
    for k, (step, origin) in enumerate([(9.25, 3.0), (17.5, 0.5), (12.0, 11.75)]):
        # it may be told by another line of the same lattice
        off = (got[k].start - origin) / step
        assert abs(got[k].spacing - step) < 0.05 and abs(off - round(off)) < 0.1 and got[k].lines >= 15
    assert sequences.lattice_search(spark.createDataFrame([], "k int, p double"), ["k"], "p", [1.0], 0.5, 0.1).count() == 0


def test_local_maxima_highest_first(spark):
    r = random.Random(12)
    rows = [(k, n, r.randint(0, 30)) for k in "ab" for n in range(300)]
    got = sequences.local_maxima(spark.createDataFrame(rows, "k string, n int, v int"), ["k"], "n", "v", 1.0, 7)
    for k in "ab":
        v = [x[2] for x in rows if x[0] == k]
        sd = (sum((x - sum(v) / 300) ** 2 for x in v) / 300) ** 0.5
        tops = [n for n in range(300) if v[n] > sd and (n == 0 or v[n] >= v[n - 1]) and (n == 299 or v[n] > v[n + 1])]
        kept = []
        for n in sorted(tops, key=lambda n: (-v[n], n)):
            if all(abs(n - m) >= 7 for m in kept):
                kept.append(n)
        assert sorted(x.peak for x in got.where(F.col("k") == k).collect()) == sorted(kept)


def test_labels_inside_an_ellipse_of_any_size(spark):
    r = random.Random(5)
    rows = [(e, w * r.uniform(-1, 1), h * r.uniform(-1, 1)) for e, w, h in (("a", 3000, 30), ("b", 500, 400), ("c", 1, 1), ("d", 20, 9000)) for _ in range(60)]
    labels = spark.createDataFrame(rows, "e string, x double, y double")
    shapes = spatial.ellipses(labels, "e").cache()

    def holds(s, x, y):
        dx, dy = x - s.cx, y - s.cy
        u, v = dx * math.cos(s.angle) + dy * math.sin(s.angle), dy * math.cos(s.angle) - dx * math.sin(s.angle)
        return (u / s.a) ** 2 + (v / s.b) ** 2 <= 1 + 1e-9

    want = {s.e: sum(holds(s, x, y) for e, x, y in rows if e != s.e) for s in shapes.collect()}
    assert {x.e: x.n for x in spatial.foreign_inside(shapes, labels, "e").collect()} == {k: n for k, n in want.items() if n}


def test_interior_gaps_where_they_are_found(spark):
    rows = [("a", 3), ("a", 7), ("a", 7), ("a", 8), ("b", 1), (None, 1), (None, 3)]
    got = sequences.interior_gaps(spark.createDataFrame(rows, "k string, n long"), ["k"], "n")
    assert {tuple(x) for x in got.collect()} == {("a", 4), ("a", 5), ("a", 6), (None, 2)}
    # what is missing is not dealt out again
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_interior_gaps_move_values_once(spark, monkeypatch):
    monkeypatch.setattr(sequences, "VALUES_A_TASK", 100)
    r = random.Random(14)
    rows = [(r.choice(["a", "b", None]), r.randint(-3000, 3000)) for _ in range(250)] + [("c", None), ("c", 5)]
    got = sequences.interior_gaps(spark.createDataFrame(rows, "k string, n int"), ["k"], "n")
    want = []
    for k in ("a", "b", None):
        held = {n for g, n in rows if g == k}
        want += [(k, n) for n in range(min(held), max(held)) if n not in held]
    # one exchange, in tasks by the number of values: 252 of them, 100 a task
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and ", 3), REPARTITION_BY_NUM" in plan
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and dict(got.dtypes)["n"] == "int"


def test_a_gap_is_not_held_whole(spark):
    most = 2**63 - 1
    rows = [("a", 0), ("a", 2_200_000_000), ("b", most - 3), ("b", most), ("c", -most), ("c", 3 - most)]
    got = sequences.interior_gaps(spark.createDataFrame(rows, "k string, n long"), ["k"], "n")
    assert {tuple(x) for x in got.where("k <> 'a'").collect()} == {("b", most - 2), ("b", most - 1), ("c", 1 - most), ("c", 2 - most)}
    assert [tuple(x) for x in got.where("k = 'a'").take(600)] == [("a", n) for n in range(1, 601)]
