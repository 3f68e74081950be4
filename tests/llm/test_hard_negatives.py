"""Hard negatives against all pairs, the tree's cover and pruning, and its defined cases."""

import math
from fractions import Fraction

import numpy as np
import pytest

from meridia.llm import hard_negatives as hard

SCHEMA = "vec_id long, embedding array<double>, label int, anchor_id string, q string, w string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "x", "x") for i, v, label in rows], SCHEMA)


def brute(rows, every=100, positives=5, negatives=10):
    clip = lambda s: min(2**63 - 1, max(-(2**63), s))
    fit = [(i, [math.floor(Fraction(x) * 256) for x in v], label) for i, v, label in rows if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (anchor, q, label) in enumerate(fit):
        if anchor % every:
            continue
        score = lambda v: clip(sum(x * y for x, y in zip(q, v, strict=True)))
        others = [(-score(v), i, n, other) for n, (i, v, other) in enumerate(fit) if n != a and len(v) == len(q)]
        for p, pid, _, _ in sorted(x for x in others if x[3] == label)[:positives]:
            mined = sorted(x for x in others if x[3] != label and 30 * -p <= 100 * -x[0] <= 90 * -p)
            out += [(anchor, pid, r, n[1], -p, -n[0]) for r, n in enumerate(mined[:negatives], 1)]
    return sorted(out)


def mined(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def clustered(r, n, d, centres=6, labels=4):
    c = r.standard_normal((centres, d))
    out = []
    for k in range(n):
        at = int(r.integers(centres))
        v = c[at] + 0.3 * r.standard_normal(d) if k % 3 else r.standard_normal(d)
        out.append((k, (v * r.uniform(0.2, 2)).tolist(), int(r.integers(labels)) if k % 5 else at % labels))
    return out


@pytest.mark.parametrize("tree_bytes,forest,wave", [(1 << 20, 8, 16), (4096, 2, 4)])
def test_against_all_pairs(spark, monkeypatch, tree_bytes, forest, wave):
    for name, value in (("TREE_BYTES", tree_bytes), ("FOREST", forest), ("WAVE", wave)):
        monkeypatch.setattr(hard, name, value)
    r = np.random.default_rng(2)
    rows = clustered(r, 700, 12)
    rows += [(800, rows[0][1], rows[0][2])] * 3 + [(k, rows[7][1], 2) for k in range(900, 960)]
    rows = [rows[i] for i in r.permutation(len(rows))]
    got = mined(hard.mine(frame(spark, rows), every=50))
    assert got == brute(rows, every=50) and len(got) > 300


def test_defined_cases(spark):
    v = [0.5, 0.25, 0.1]
    w = [0.3, 0.2, 0.0]
    rows = [(0, v, 1), (0, v, 1), (1, v, 1), (2, w, 2), (2, w, 2), (3, None, 1), (4, [], 1), (5, [1.0, None, 0.0], 1), (6, [float("nan"), 0.0, 0.0], 2), (7, [float("inf"), 0.0, 0.0], 2), (8, w, None), (None, v, 1), (9, [0.5, 0.25], 2), (100, [-v_ for v_ in v], 3), (101, v, 3), (200, [0.0, 0.0, 0.0], 4), (201, v, 4), (-100, [0.4, 0.3, 0.2], -1), (-1, v, -1), (300, [1.0, 2.0], 6), (301, [1.0, 2.0], 6)]
    assert mined(hard.mine(frame(spark, rows))) == brute(rows)
    assert hard.mine(frame(spark, [])).count() == 0
    assert hard.mine(frame(spark, [(1, v, 1), (2, v, 2)])).count() == 0
    assert hard.mine(frame(spark, [(0, v, 1), (2, v, 2)])).count() == 0


def test_scores_of_any_size(spark):
    rows = [(k, [10.0 ** (k % 40 * 7), 1.0, -(10.0 ** (k % 7 * 20))], k % 3) for k in range(120)]
    rows += [(200 + k, [1e8 + k, 3e7, k * 1.0], k % 2) for k in range(60)] + [(300, [1e300, 1e300, 1e300], 0), (400, [0.0, 0.0, 5e-324], 1)]
    assert mined(hard.mine(frame(spark, rows), every=20)) == brute(rows, every=20)


def grown(r, n=3000, d=16):
    rows = clustered(r, n, d)
    v = np.floor(256 * np.array([x[1] for x in rows]))
    return hard.CoverTree.of(v, np.array([x[2] for x in rows], np.int64), np.arange(n), np.arange(n))


def test_tree_covers_and_holds_every_point_once():
    tree = hard.CoverTree.unpacked(grown(np.random.default_rng(3)).packed())
    assert sorted(tree.point[tree.fresh].tolist()) == list(range(len(tree.rows)))
    x = tree.vectors / np.abs(tree.vectors).max()
    squares = (x * x).sum(axis=1)
    x = np.concatenate([x, np.sqrt(squares.max() - squares)[:, None]], axis=1)
    below = [{int(tree.point[k])} for k in range(len(tree.point))]
    for k in range(len(tree.point) - 1, -1, -1):
        children = range(tree.start[k], tree.end[k])
        for c in children:
            below[k] |= below[c]
            assert tree.radius[c] <= 2 * tree.radius[k]
        far = np.linalg.norm(x[list(below[k])] - x[tree.point[k]], axis=1).max()
        assert far <= tree.radius[k] * (1 + 1e-9) + 1e-12
        found = set(tree.label[list(below[k])].tolist())
        assert tree.only[k] == (found.pop() if len(found) == 1 else -1)


def test_descent_is_exact_and_skips():
    tree = grown(np.random.default_rng(4))
    scored = 0
    for a in range(0, 3000, 100):
        q = tree.vectors[a].astype(float)
        s = tree.vectors.astype(np.int64) @ tree.vectors[a].astype(np.int64)
        top = int(s[tree.label == tree.label[a]].max())
        windows = [(3 * top // 10 + 1, 9 * top // 10, None), (top // 2, top // 2 + abs(top) // 50, None)]
        anchor = hard.Anchor(a, int(tree.label[a]), q, windows, 10, False)
        anchor.descend(tree)
        scored += anchor.scored
        for (lo, hi, _), best in zip(windows, anchor.found, strict=True):
            fit = [(-int(s[i]), i, i) for i in range(3000) if tree.label[i] != tree.label[a] and lo <= s[i] <= hi]
            assert best == sorted(fit)[:10]
    assert scored < 0.7 * 30 * 3000, scored / 90000
