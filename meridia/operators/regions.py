"""Connected regions of occupied cells, and what is reduced over each.

Cells (x, y), whole numbers, are dealt to tiles of TILE x TILE, so that no task sees more
than one tile's cells at a time. Within a tile, runs of cells in a row are joined to the runs
they touch in the row before; regions of different tiles are then joined where cells meet
across a border, by an equality on the border's cells, and their graph's components give one
label to each region, however many tiles it covers: its first cell by (y, x). A region that
touches no border of its tile is whole there, and is neither joined nor numbered."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.operators.shared import connected_components, materialise, skew_join

TILE = 256
#: Cells of a task that sums regions which are whole in it.
CELLS_A_TASK = 250_000
#: A cell as one number: y above x, both from -2^30 to 2^30.
HALF = 1 << 30


def _number(x: Column, y: Column) -> Column:
    return (y.cast("long") + HALF) * (2 * HALF) + x.cast("long") + HALF


def tile_labels(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of a tile's distinct cells, in order of y then x, the index of its region's
    first cell: runs first, then the runs that touch."""
    new = np.ones(len(x), bool)
    new[1:] = (np.diff(y) != 0) | (np.diff(x) != 1)
    run = np.cumsum(new) - 1
    start = np.flatnonzero(new)
    left, right = x[start], x[np.append(start[1:], len(x)) - 1]
    rows = y[start]
    root = list(range(len(start)))

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    above = 0
    for k in range(len(start)):
        # runs are in order: those before ``above`` end left of this one, or in rows long past
        while above < k and (rows[above] < rows[k] - 1 or rows[above] == rows[k] - 1 and right[above] < left[k]):
            above += 1
        a = above
        while a < k and rows[a] == rows[k] - 1 and left[a] <= right[k]:
            p, q = sorted((find(a), find(k)))
            root[q] = p
            a += 1
    return start[np.array([find(k) for k in range(len(start))], np.int64)][run] if len(x) else np.zeros(0, np.int64)


def _label_tiles(keys: Sequence[str], tile: int):
    def run(batches):
        for b in batches:
            lists = b.column("cells")
            offsets, flat = lists.offsets.to_numpy(), lists.values
            at, xs, ys, labels, opens = [], [], [], [], []
            for k in range(b.num_rows):
                rows = flat.slice(offsets[k], offsets[k + 1] - offsets[k])
                x, y = (rows.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("x", "y"))
                order = np.lexsort((x, y))
                x, y = x[order], y[order]
                first = tile_labels(x, y)
                at.append(np.full(len(x), k))
                xs.append(x)
                ys.append(y)
                labels.append((y[first] + HALF) * (2 * HALF) + x[first] + HALF)
                border = np.zeros(len(x), bool)
                border[first[np.isin(x % tile, (0, tile - 1)) | np.isin(y % tile, (0, tile - 1))]] = True
                opens.append(border[first])
            join = lambda parts, kind=np.int64: np.concatenate([np.zeros(0, kind), *parts])
            own = [b.column(c).take(pa.array(join(at))) for c in keys]
            yield pa.record_batch([*own, pa.array(join(xs)), pa.array(join(ys)), pa.array(join(labels)), pa.array(join(opens, bool))], names=[*keys, "x", "y", "label", "open"])

    return run


def regions(cells: DataFrame, keys: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """keys, x, y, label, open of the distinct cells: cells that touch by a side, within the
    keys' sheet, have one label, the (y, x) number of the region's first cell; a region is
    open if it touches its tile's border. Only open ones may go on in another tile."""
    keys = list(keys)
    whole = cells.select(*keys, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).where("x is not null and y is not null").distinct()
    spot = lambda c: F.floor(F.col(c) / tile).cast("long")
    tiles = whole.groupBy(*keys, spot("x").alias("_tx"), spot("y").alias("_ty")).agg(F.collect_list(F.struct("x", "y")).alias("cells"))
    kinds = dict(whole.dtypes)
    named = materialise(tiles.select(*keys, "cells").mapInArrow(_label_tiles(keys, tile), ", ".join([f"{k} {kinds[k]}" for k in keys] + ["x long", "y long", "label long", "open boolean"])))
    met, bordering = [], named.where("open")
    for axis, other in (("x", "y"), ("y", "x")):
        last = bordering.where(F.pmod(F.col(axis), F.lit(tile)) == tile - 1).select(*keys, (F.col(axis) + 1).alias(axis), other, F.col("label").alias("a"))
        first = bordering.where(F.pmod(F.col(axis), F.lit(tile)) == 0).select(*keys, axis, other, F.col("label").alias("b"))
        met.append(skew_join(last, first, [*keys, "x", "y"], "inner").select(*keys, "a", "b"))
    edges = materialise(met[0].unionByName(met[1]).distinct())
    ends = edges.select(*keys, F.col("a").alias("label")).unionByName(edges.select(*keys, F.col("b").alias("label")))
    ids = materialise(ends.distinct().withColumn("id", F.monotonically_increasing_id()))
    for end in ("a", "b"):
        edges = skew_join(edges, ids.select(*keys, F.col("label").alias(end), F.col("id").alias(f"{end}_id")), [*keys, end], "inner")
    parts = connected_components(edges, "a_id", "b_id")
    known = ids.join(parts.select(F.col("node").alias("id"), "component"), "id")
    least = known.groupBy("component").agg(F.min("label").alias("least"))
    final = materialise(known.join(least, "component").select(*keys, "label", "least"))
    joined = skew_join(bordering, final, [*keys, "label"]).withColumn("label", F.coalesce("least", "label"))
    out = [*keys, "x", "y", "label", "open"]
    return named.where("not open").select(out).unionByName(joined.select(out))


def reduce_regions(labelled: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, label, cells, x0, x1, y0, y1, cx, cy, widest: each region's size, box, centre of
    mass and the most cells that it has in a row; partial sums by row, then by region. A
    region that is not open holds a tile's cells at most, and goes to one task at once."""
    within = labelled.where("not open")
    tasks = max(1, -(-within.count() // CELLS_A_TASK))
    return _sums(within.repartition(tasks, *keys, "label"), keys).unionByName(_sums(labelled.where("open"), keys))


def _sums(labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    rows = labelled.groupBy(*keys, "label", "y").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.sum("x").alias("sx"))
    return rows.groupBy(*keys, "label").agg(
        F.sum("n").alias("cells"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), (F.sum("sx") / F.sum("n")).alias("cx"), (F.sum(F.col("y") * F.col("n")) / F.sum("n")).alias("cy"), F.max("n").alias("widest")
    )


def cell_number(x: Column, y: Column) -> Column:
    """The number that labels are made of."""
    return _number(x, y)
