"""Space partitions that follow the data, and joins dealt by them.

A bounded sample of the points is cut into slices of x that hold alike many, and each slice
into leaves of y: where points crowd, leaves are small, whatever the extent. Bounds go along
as constants, MOST_LEAVES of them at most; a leaf is found by counting the bounds below a
value. The outermost leaves have no end, so that every point has exactly one."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.operators.shared import materialise, skew_join, spread

CAPACITY, SAMPLE, MOST_LEAVES = 2000, 20_000, 4096
LEAVES_A_TASK = 8


@dataclass(frozen=True)
class Leaves:
    """Inner bounds of the slices, and of the leaves of each slice."""

    xs: list[float]
    ys: list[list[float]]

    def count(self) -> int:
        return sum(len(own) + 1 for own in self.ys)

    def _below(self, bounds: Column, v: Column) -> Column:
        # never null: else a join tests the number by making it once more, before rows are spread
        return F.coalesce(F.size(F.filter(bounds, lambda b: b <= v)), F.lit(0))

    def slice_of(self, x: Column) -> Column:
        return self._below(F.from_json(F.lit(json.dumps(self.xs)), "array<double>"), x)

    def leaf_of(self, slice_: Column, y: Column) -> Column:
        rows = F.from_json(F.lit(json.dumps(self.ys)), "array<array<double>>")
        return self._below(F.element_at(rows, slice_ + 1), y)


def _bounds(values: list[float], parts: int) -> list[float]:
    """Values that part the sorted ones evenly; equal ones are not parted."""
    return sorted({values[len(values) * k // parts] for k in range(1, parts)} - {values[0]}) if values else []


def leaves(points: DataFrame, capacity: int = CAPACITY, sample: int = SAMPLE) -> Leaves:
    """Leaves of points (x, y) that hold about ``capacity`` each, from at most about ``sample``."""
    fit = points.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x is not null and y is not null")
    n = fit.count()
    share = min(1.0, sample / max(1, n))
    rows = [(r["x"], r["y"]) for r in (fit if share >= 1 else fit.sample(share, 7).limit(2 * sample)).collect()]
    wanted = min(MOST_LEAVES, -(-n // capacity))
    slices = max(1, round(wanted**0.5))
    xs = _bounds(sorted(x for x, _ in rows), slices)
    ys = []
    for k in range(len(xs) + 1):
        low, high = (xs[k - 1] if k else -float("inf")), (xs[k] if k < len(xs) else float("inf"))
        own = sorted(y for x, y in rows if low <= x < high)
        ys.append(_bounds(own, max(1, round(wanted * len(own) / max(1, len(rows))))))
    return Leaves(xs, ys)


def in_leaf(points: DataFrame, at: Leaves) -> DataFrame:
    """points with _slice and _leaf, the one leaf that holds each."""
    return points.withColumn("_slice", at.slice_of(F.col("x"))).withColumn("_leaf", at.leaf_of(F.col("_slice"), F.col("y")))


def over_leaves(rows: DataFrame, at: Leaves, west: Column, south: Column, east: Column, north: Column) -> DataFrame:
    """rows with _slice and _leaf, once for every leaf that their box touches."""
    out = rows.withColumn("_slice", F.explode(F.sequence(at.slice_of(west), at.slice_of(east))))
    return out.withColumn("_leaf", F.explode(F.sequence(at.leaf_of(F.col("_slice"), south), at.leaf_of(F.col("_slice"), north))))


def radius_join(left: DataFrame, right: DataFrame, radius: float, at: Leaves, prefix: str = "r_") -> DataFrame:
    """Pairs of rows (x, y) no further apart than the radius, with their distance; the right
    side's columns get a prefix. The side of fewer rows goes to every leaf that its radius
    touches, the other to the one leaf that holds it, so that no pair comes twice; rows are
    dealt to tasks by their number and leaves by theirs, as pairs may be many more."""
    kept = {c: prefix + c for c in right.columns}
    here, there = spread(left, "x", "y"), spread(right, "x", "y")
    touched = lambda df: over_leaves(df, at, F.col("x") - radius, F.col("y") - radius, F.col("x") + radius, F.col("y") + radius)
    few = left.count() < right.count()
    a, b = (touched(here), in_leaf(there, at)) if few else (in_leaf(here, at), touched(there))
    tasks = -(-at.count() // LEAVES_A_TASK)
    # what a leaf's rows are held against, one by one, is held in memory: the side of one leaf
    a, b = (df.repartition(tasks, "_slice", "_leaf") for df in (a, b.withColumnsRenamed(kept)))
    j = a.join(b.hint("merge"), ["_slice", "_leaf"]) if few else b.join(a.hint("merge"), ["_slice", "_leaf"])
    dx, dy = F.col("x") - F.col(prefix + "x"), F.col("y") - F.col(prefix + "y")
    d = F.sqrt(dx * dx + dy * dy)
    return j.where(d <= radius).select(*left.columns, *kept.values(), d.alias("distance"))


def box_overlap_join(left: DataFrame, right: DataFrame, at: Leaves, least: float = 0.15) -> DataFrame:
    """Pairs of boxes (id, w, s, e, n) that share at least a part of the smaller one's area; a
    pair counts in the leaf that holds the south-west corner of what it shares. That leaf is
    the later of the two in which the boxes' own corners are, so that pairs compare numbers
    and no bounds."""

    def dealt(df: DataFrame, p: str) -> DataFrame:
        c = F.col
        # numbered before they are dealt: the first slice, and in each slice the first leaf
        first = df.where("e > w and n > s").withColumn("_first", at.slice_of(c("w")))
        out = first.withColumn("_slice", F.explode(F.sequence("_first", at.slice_of(c("e"))))).withColumn("_low", at.leaf_of(c("_slice"), c("s")))
        out = out.withColumn("_leaf", F.explode(F.sequence("_low", at.leaf_of(c("_slice"), c("n")))))
        return out.select(*[c(k).alias(p + k) for k in ("id", "w", "s", "e", "n")], c("_first").alias(p + "first"), c("_low").alias(p + "low"), "_slice", "_leaf")

    j = dealt(left, "a_").join(dealt(right, "b_").hint("merge"), ["_slice", "_leaf"])
    w, s = F.greatest("a_w", "b_w"), F.greatest("a_s", "b_s")
    width, height = F.least("a_e", "b_e") - w, F.least("a_n", "b_n") - s
    smaller = F.least((F.col("a_e") - F.col("a_w")) * (F.col("a_n") - F.col("a_s")), (F.col("b_e") - F.col("b_w")) * (F.col("b_n") - F.col("b_s")))
    j = j.where((F.col("_slice") == F.greatest("a_first", "b_first")) & (F.col("_leaf") == F.greatest("a_low", "b_low")) & (width > 0) & (height > 0))
    return j.withColumn("share", width * height / smaller).where(F.col("share") >= least).select("a_id", "b_id", "share")


def quarters(points: DataFrame, boxes: DataFrame, key: str, limit: int, depth: int) -> DataFrame:
    """key, path, depth, west, south, east, north, n: boxes (key and sides, half open) that hold
    over ``limit`` of their key's points (key, x, y) are quartered until none does, or until
    ``depth``. Only what is too full is looked at again; quarters without points are there,
    too. A path names the quarters taken: 1 for the east, 2 more for the north."""
    sides = ["west", "south", "east", "north"]
    c, full, done = F.col, None, None
    open_ = materialise(boxes.select(key, F.lit("").alias("path"), *[c(s).cast("double").alias(s) for s in sides]))
    held = points.select(key, c("x").cast("double").alias("x"), c("y").cast("double").alias("y")).join(open_, key)
    held = materialise(held.where((c("x") >= c("west")) & (c("x") < c("east")) & (c("y") >= c("south")) & (c("y") < c("north"))).select(key, "path", "x", "y"))
    for level in range(depth + 1):
        counts = held.groupBy(key, "path").agg(F.count("*").alias("n"))
        counted = materialise(open_.join(counts, [key, "path"], "left").fillna({"n": 0}).withColumn("depth", F.lit(level)))
        settled = counted.where((c("n") <= limit) | F.lit(level == depth))
        done = settled if done is None else done.unionByName(settled)
        full = counted.where((c("n") > limit) & F.lit(level < depth))
        if not full.limit(1).count():
            break
        mid = full.select(key, "path", *sides, ((c("west") + c("east")) / 2).alias("mx"), ((c("south") + c("north")) / 2).alias("my"))
        # a full box may hold most of the points that are left
        inside = skew_join(held, mid.select(key, "path", "mx", "my"), [key, "path"], "inner")
        quarter = (c("x") >= c("mx")).cast("int") + 2 * (c("y") >= c("my")).cast("int")
        held = materialise(inside.select(key, F.concat("path", quarter.cast("string")).alias("path"), "x", "y"))
        q = c("q")
        parts = mid.withColumn("q", F.explode(F.array(*map(F.lit, range(4)))))
        east, north = q.bitwiseAND(F.lit(1)) == 1, q.bitwiseAND(F.lit(2)) == 2
        open_ = materialise(parts.select(key, F.concat("path", q.cast("string")).alias("path"), F.when(east, c("mx")).otherwise(c("west")).alias("west"), F.when(north, c("my")).otherwise(c("south")).alias("south"), F.when(east, c("east")).otherwise(c("mx")).alias("east"), F.when(north, c("north")).otherwise(c("my")).alias("north")))
    return done.select(key, "path", "depth", *sides, "n")
