"""Partitions that follow the data, quartering and exact quantiles, against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia.functions.numbers import rounded
from meridia.operators import aggregates, partition


def crowd(spark, seed, n):
    r = random.Random(seed)
    rows = [(k, 50 + r.random() / 100, 50 + r.random() / 100) if k % 2 else (k, r.uniform(-100, 1000), r.uniform(0, 100)) for k in range(n)]
    return rows, spark.createDataFrame(rows, "id long, x double, y double")


def test_a_crowded_spot_is_split(spark):
    rows, df = crowd(spark, 1, 4000)
    at = partition.leaves(df, 100)
    sizes = [r["count"] for r in partition.in_leaf(df, at).groupBy("_slice", "_leaf").count().collect()]
    assert sum(sizes) == 4000 and max(sizes) <= 300 and len(sizes) >= 25
    # a cell of the plain grid would hold half of them
    assert max(r["count"] for r in df.groupBy(F.floor("x"), F.floor("y")).count().collect()) >= 2000


@pytest.mark.parametrize("capacity", [20, 10_000])
def test_radius_and_boxes_as_by_all_pairs(spark, capacity):
    a, left = crowd(spark, 2, 600)
    b, right = crowd(spark, 3, 300)
    at = partition.leaves(left.unionByName(right), capacity)
    near = {(r.id, r.r_id) for r in partition.radius_join(left, right, 0.002, at).collect()}
    assert near == {(i, j) for i, x, y in a for j, u, v in b if math.hypot(x - u, y - v) <= 0.002} and near
    box = lambda df, w: df.select("id", F.col("x").alias("w"), F.col("y").alias("s"), (F.col("x") + w).alias("e"), (F.col("y") + w).alias("n"))
    got = [(r.a_id, r.b_id) for r in partition.box_overlap_join(box(left, 0.004), box(right, 30.0), at, 0.5).collect()]
    part = lambda p, q, w, z: max(0.0, min(p + w, q + z) - max(p, q))
    want = {(i, j) for i, x, y in a for j, u, v in b if part(x, u, 0.004, 30.0) * part(y, v, 0.004, 30.0) >= 0.5 * 0.004**2}
    assert len(got) == len(set(got)) and set(got) == want


def test_the_side_of_fewer_rows_goes_to_many_leaves(spark, monkeypatch):
    a, many = crowd(spark, 6, 900)
    b, few = crowd(spark, 7, 60)
    at, sent, whole = partition.leaves(many.unionByName(few), 20), [], partition.over_leaves
    monkeypatch.setattr(partition, "over_leaves", lambda rows, *box: sent.append(rows.count()) or whole(rows, *box))
    want = {(i, j) for i, x, y in a for j, u, v in b if math.hypot(x - u, y - v) <= 0.003}
    there = partition.radius_join(many, few, 0.003, at)
    back = partition.radius_join(few, many, 0.003, at)
    assert sent == [60, 60] and want
    assert sorted((r.id, r.r_id) for r in there.collect()) == sorted(want) == sorted((r.r_id, r.id) for r in back.collect())
    # leaves are read after rows are spread over tasks, by no filter before it
    assert there.columns == ["id", "x", "y", "r_id", "r_x", "r_y", "distance"]
    below = there._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[-1]
    assert "lambda" not in below


def test_rounded_in_doubles(spark):
    r = random.Random(8)
    values = [0.0, 0.07, 0.0125, 0.5] + [r.random() / 10 for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double").select(rounded(F.col("v"), 9).alias("got"), F.round("v", 9).alias("want"))
    assert all(x.got == x.want for x in df.collect()) and "floor" in df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_pairs_of_boxes_are_not_looked_up_again(spark):
    _, df = crowd(spark, 4, 200)
    box = df.select("id", F.col("x").alias("w"), F.col("y").alias("s"), (F.col("x") + 1).alias("e"), (F.col("y") + 1).alias("n"))
    plan = partition.box_overlap_join(box, box, partition.leaves(df, 20))._jdf.queryExecution().optimizedPlan().toString()
    # bounds are read by each side's rows, below the join, by no pair
    join = next(line for line in plan.splitlines() if "Join" in line)
    assert "filter(" not in plan[: plan.index(join) + len(join)]


def test_same_point_many_times(spark):
    df = spark.range(500).select("id", F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
    at = partition.leaves(df, 10)
    assert partition.radius_join(df.limit(3), df, 0.5, at).count() == 1500
    assert partition.leaves(df.limit(0)) == partition.Leaves([], [[]])


def test_quarters_until_none_is_too_full(spark):
    r = random.Random(4)
    points = [("a", r.random() ** 4 * 64, r.random() ** 4 * 64) for _ in range(300)] + [("b", 63.0, 1.0)] * 20 + [("a", 64.0, 3.0), ("c", 1.0, 1.0)]
    boxes = [("a", 0.0, 0.0, 64.0, 64.0), ("b", 0.0, 0.0, 64.0, 64.0)]
    got = partition.quarters(spark.createDataFrame(points, "k string, x double, y double"), spark.createDataFrame(boxes, "k string, west double, south double, east double, north double"), "k", 8, 5).collect()
    for g in got:
        assert g.n == sum(k == g.k and g.west <= x < g.east and g.south <= y < g.north for k, x, y in points)
        assert (g.n <= 8 or g.depth == 5) and len(g.path) == g.depth
    for k in "ab":
        own = [g for g in got if g.k == k]
        assert sum((g.east - g.west) * (g.north - g.south) for g in own) == 64 * 64
        # no leaf could have been left whole: its parent is too full
        inside = lambda p, own=own: sum(g.n for g in own if g.path.startswith(p))
        assert all(inside(g.path[:-1]) > 8 for g in own if g.depth)
    assert max(g.depth for g in got) == 5


@pytest.mark.parametrize("few", [4, 100])
def test_exact_quantiles(spark, few):
    r = random.Random(5)
    for values in ([r.gauss(0, 1) for _ in range(3000)], [r.choice([1.0, 2.0, 2.0, 7.5]) for _ in range(500)], [1e300 * r.uniform(-1, 1) for _ in range(200)], [10.0 ** r.uniform(-300, 300) for _ in range(400)], [3.0], [1.0, 2.0]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
        shares = [0, 1 / 7, 0.5, 0.999, 1]
        got = aggregates.exact_quantiles(df, "v", shares, few)
        s = np.sort(values)
        for q, g in zip(shares, got, strict=True):
            h = (len(s) - 1) * q
            a, b = s[int(h)], s[min(len(s) - 1, int(h) + 1)]
            assert g == pytest.approx(a + (b - a) * (h - int(h)), rel=1e-12)
    assert aggregates.exact_quantiles(spark.createDataFrame([(None,)], "v double"), "v", [0.5]) is None
