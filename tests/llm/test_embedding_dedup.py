"""Embedding near-dedup against all pairs, its estimates, and its defined cases."""

import numpy as np
import pytest

from meridia.llm import embedding_dedup as near

SCHEMA = "vec_id long, embedding array<double>, label int, component_id string, id string, digest string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "x", "x") for i, v in rows], SCHEMA)


def brute(rows, threshold=near.THRESHOLD):
    """(vec_id, n_links, component_id, kept) of each row by all pairs."""
    fit = [v is not None and len(v) > 0 and None not in v and bool(np.isfinite(v).all()) and any(v) for _, v in rows]
    unit = [np.array(v, float) / np.abs(v).max() if f else None for (_, v), f in zip(rows, fit, strict=True)]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    n = len(rows)
    root, links = list(range(n)), [0] * n

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(n):
            if a != b and fit[a] and fit[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold - 1e-15:
                links[a] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return sorted(((i, links[a], least.get(find(a)), i == least.get(find(a))) for a, (i, _) in enumerate(rows)), key=repr)


def judged(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=repr)


def crowd(r, centre, n, spread):
    return [(centre + spread * r.standard_normal(len(centre)) / np.sqrt(len(centre))).tolist() for _ in range(n)]


@pytest.mark.parametrize("cell", [near.CELL, 16])
def test_against_all_pairs(spark, cell):
    r = np.random.default_rng(1)
    centres = r.standard_normal((8, 64))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    vectors = r.standard_normal((120, 64)).tolist()
    for k, c in enumerate(centres):
        vectors += crowd(r, c, 25, 0.02 + 0.03 * k)
    vectors += [vectors[130]] * 40
    order = r.permutation(len(vectors))
    rows = [(int(i), vectors[k]) for i, k in enumerate(order)]
    assert judged(near.near_dedup(frame(spark, rows), cell=cell)) == brute(rows)


def test_defined_cases(spark):
    a, b = [1.0, 0.1, 0.0], [1.0, 0.2, 0.0]
    rows = [(1, a), (2, b), (2, b), (None, a), (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [1.0, float("nan"), 0.0]), (8, [1.0, float("inf"), 0.0]), (9, [1.0, None, 0.0]), (10, [1.0, 0.1]), (11, [1e200, 1e199, 0.0]), (12, [-1.0, -0.1, 0.0]), (13, [1e-300, 1e-301, -0.0]), (None, [0.0, 0.0, 1.0]), (None, None)]
    rows += [(20, [0.0, 1.0, 0.0]), (20, [0.0, 0.0, -1.0])]
    assert judged(near.near_dedup(frame(spark, rows))) == brute(rows)
    assert near.near_dedup(frame(spark, [])).count() == 0


def test_equal_vectors_of_one_crowd(spark):
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 else [3.0, -2.0, 1.0]) for i in range(3000)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near.near_dedup(frame(spark, rows), cell=16).collect()}
    assert got == {i: (1999, 1, i == 1) if i % 3 else (999, 0, i == 0) for i in range(3000)}


def test_other_lengths(spark):
    r = np.random.default_rng(3)
    rows = []
    for n in (1, 2, 63, 65, 200):
        for c in r.standard_normal((3, n)):
            rows += [(len(rows) + k, v) for k, v in enumerate(crowd(r, c / np.linalg.norm(c), 4, 0.1))]
    assert judged(near.near_dedup(frame(spark, rows))) == brute(rows)


def pairs_at(r, n, cosine, width=64):
    x, y = r.standard_normal((2, n, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    return x, cosine * x + np.sqrt(1 - cosine**2) * y


def test_estimates_are_unbiased_and_bounded():
    r = np.random.default_rng(5)
    for cosine in (0.3, 0.95):
        x, y = pairs_at(r, 2000, cosine)
        codes = near.Codes.of(np.concatenate([x, y]))
        again = near.Codes.unpacked(codes.packed())
        got = np.array([[float(v[0, 0]) for v in again.estimates(np.array([k]), slice(2000 + k, 2001 + k), 0.95)] for k in range(2000)])
        assert abs(got[:, 0].mean() - cosine) < 0.01
        if cosine == 0.95:
            off = (got[:, 0] - cosine) / got[:, 1]
            assert 0.7 < off.std() < 1.2 and np.abs(off).max() < near.SPREAD
        else:
            # few unlike pairs are left to be recomputed
            assert (got[:, 0] >= 0.95 - near.SPREAD * got[:, 1]).mean() < 0.01


def test_recall_of_the_cells():
    r = np.random.default_rng(6)
    for cosine, least in ((0.95, 0.985), (0.96, 0.99), (0.98, 0.999)):
        x, y = pairs_at(r, 4000, cosine)
        met = (near.Codes.of(x).cells == near.Codes.of(y).cells).any(axis=1).mean()
        assert met >= least, (cosine, met)


def test_stars_of_a_long_chain():
    n = 5000
    shuffled = np.random.default_rng(7).permutation(n)
    rows, least = near.stars(n, shuffled[:-1], shuffled[1:])
    assert len(rows) == n - 1 and set(least) == {0}
