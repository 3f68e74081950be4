"""Hard-negative mining with cover trees over norm-augmented candidates.

Vectors become integer vectors, floor(256 x) by component, and a score is an integer inner
product. An anchor's positives are its POSITIVES best rows of its own label; for each of
them the hard negatives are the NEGATIVES best rows of other labels whose score lies in the
window LOW % to HIGH % of the positive's.

Candidates get one more coordinate, the root of what their squared norm lacks of the
tree's largest, so that all lie on one sphere and nearer means a larger inner product. A cover tree
holds them: a node of a level covers what lies within 2^level of its point, and knows how
far its farthest descendant really lies. From the covering radius r and the score s of a
node's point, every descendant's score is within

    s + min(|q| r, D r - r^2 / 2)   and   s - min(|q| r, D r + r^2 / 2),

with D the distance of anchor and point on the sphere. Nodes are taken best bound first;
nodes outside all the anchor's windows, below what it has already found, or without a
label it looks for are skipped with all they hold. What is left at the leaves is scored
exactly, in whole numbers.

How it is dealt: a bounded sample of rows (at most TOP) stands for the top of one tree; each
row goes to its nearest, and what gathers there is cut into trees of at most about
TREE_BYTES. FOREST trees make a group. A group's trees, sorted first, and then the anchors
one by one stream through a task, so that a task holds FOREST trees and no more. No anchor or
candidate passes through the driver but the sample. A first wave runs over every
WAVE-th group; the anchors take the scores it has found along to the others, which then hand
on only what beats them. Results are merged by anchor and window.

Defined cases: rows whose vec_id, label or vector is null, or whose vector is empty or has
null or non-finite components, take no part; rows of other lengths are no candidates; an
anchor's own row is no positive, other rows of its vec_id are; an anchor id on several rows
is an anchor each time; repeated rows count one by one; ties go to the smaller vec_id, then
to the row read first; scores beyond the range of a long become that end of it
before they are compared; negative positives have no window, and a positive of score 0 the
window 0; no anchors, or no candidates: no rows; other columns, whatever their names, are
left out.
"""

from __future__ import annotations

import heapq
import io
import math
from dataclasses import dataclass, fields as columns_of

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.llm.common import ROW, fields, materialise, met_in_groups, skew_join, with_row_key
from meridia.llm.topk import LEAST, MOST, usable

POSITIVES, NEGATIVES, LOW, HIGH, EVERY = 5, 10, 30, 90, 100
TOP, TREE_BYTES, FOREST, WAVE = 64, 1 << 20, 8, 16
#: A node that would hold fewer is not worth a visit: its points hang below its parent one by
#: one, as does the rest once so many nodes in a row have come out as small.
LEAF, MISSES = 128, 32


@dataclass
class CoverTree:
    """Nodes in order of depth: number of the node's point, whether it is the point's first
    node, farthest descendant, children (from, to), labels as a mask of 64 bits, and the one
    label of all it holds or -1. Points: vectors, label, vec_id, row."""

    point: np.ndarray
    fresh: np.ndarray
    radius: np.ndarray
    start: np.ndarray
    end: np.ndarray
    mask: np.ndarray
    only: np.ndarray
    vectors: np.ndarray
    label: np.ndarray
    ids: np.ndarray
    rows: np.ndarray

    @staticmethod
    def of(vectors: np.ndarray, label: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> CoverTree:
        x = vectors / (np.abs(vectors).max(initial=0) or 1.0)
        squares = (x * x).sum(axis=1)
        x = np.concatenate([x, np.sqrt(np.maximum(0, squares.max() - squares))[:, None]], axis=1)
        away = lambda c, of: np.sqrt(np.square(x[of] - x[c]).sum(axis=1))
        root = int(np.square(x - x.mean(axis=0)).sum(axis=1).argmin())
        rest = np.delete(np.arange(len(x)), root)
        point, fresh, radius, start, end = [root], [True], [], [], []
        todo = [(rest, away(root, rest))]
        for members, far in todo:  # grows: a node's place in it is its number
            own = point[len(radius)]
            radius.append(float(far.max(initial=0)))
            start.append(len(point))
            if len(members) <= LEAF or radius[-1] == 0:
                made = [(int(m), True, members[:0], far[:0]) for m in members]
            else:
                reach = 2.0 ** (math.ceil(math.log2(radius[-1])) - 1)
                near = far <= reach
                made, singles, missed = [], [], 0
                if near.sum() >= LEAF:
                    made.append((own, False, members[near], far[near]))
                else:
                    singles.append(members[near])
                members = members[~near]
                while len(members) and missed < MISSES:
                    centre, rest = int(members[0]), members[1:]
                    far = away(centre, rest)
                    near = far <= reach
                    if near.sum() >= LEAF:
                        made.append((centre, True, rest[near], far[near]))
                        missed = 0
                    else:
                        singles += [members[:1], rest[near]]
                        missed += 1
                    members = rest[~near]
                made += [(int(m), True, members[:0], far[:0]) for m in np.concatenate([*singles, members])]
            point += [m[0] for m in made]
            fresh += [m[1] for m in made]
            todo += [(m[2], m[3]) for m in made]
            end.append(len(point))
        names, index = np.unique(label, return_inverse=True)
        mask = np.left_shift(np.uint64(1), _bit(label[point]))
        only = names[index[point]].astype(np.int64)
        several = np.zeros(len(point), bool)
        for k in range(len(point) - 1, -1, -1):
            a, b = start[k], end[k]
            if b > a:
                mask[k] |= np.bitwise_or.reduce(mask[a:b])
                several[k] = several[a:b].any() or (only[a:b] != only[k]).any()
        only[several] = -1
        narrow = next((t for t in (np.int16, np.int32) if np.abs(vectors).max(initial=0) <= np.iinfo(t).max), np.float64)
        # a radius is rounded up, as it is kept
        array = lambda v, t: np.array(v, t)
        return CoverTree(array(point, np.int32), array(fresh, bool), array(radius, np.float64) * (1 + 1e-12), array(start, np.int32), array(end, np.int32), mask, np.where(several, -1, only), vectors.astype(narrow), label, ids, rows)

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f.name: getattr(self, f.name) for f in columns_of(self)})
        return out.getvalue()

    @staticmethod
    def unpacked(raw: bytes) -> CoverTree:
        with np.load(io.BytesIO(raw)) as kept:
            return CoverTree(**{f.name: kept[f.name] for f in columns_of(CoverTree)})

    def __post_init__(self):
        self.most = float(np.abs(self.vectors).max(initial=0))
        self.scale = self.most or 1.0
        self._typed: dict = {}
        self.norm = None

    def matrix(self, kind):
        """The vectors in order of the nodes, as float32, float64 or whole numbers of any size."""
        if kind not in self._typed:
            v = self.vectors[self.point]
            self._typed[kind] = np.frompyfunc(int, 1, 1)(v) if kind is object else v.astype(kind)
        return self._typed[kind]

    def scores(self, q: np.ndarray, a: int, b: int, top: float) -> np.ndarray:
        """Exact scores of nodes a to b with an anchor whose largest component is top."""
        most = max(self.most * top * max(1, len(q)), self.most, top)
        kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else object
        m = self.matrix(kind)[a:b]
        if kind is object:
            whole = m @ np.frompyfunc(int, 1, 1)(q)
            return np.array([min(MOST, max(LEAST, int(s))) for s in whole], np.int64)
        return (m @ q.astype(kind)).astype(np.int64)

    def near(self, q: np.ndarray, a: int, b: int) -> np.ndarray:
        """Inner products of nodes and anchor, both scaled to largest component one."""
        return self.matrix(np.float64)[a:b] / self.scale @ q


def _bit(label: np.ndarray) -> np.ndarray:
    return (label % 64).astype(np.uint64)


class Anchor:
    """An anchor and its windows (low, high, floor), each with the best found so far.
    ``positive``: it looks for rows of its own label, else for those of others."""

    def __init__(self, row: int, label: int, q: np.ndarray, windows: list[tuple[int, int, int | None]], k: int, positive: bool):
        self.row, self.label, self.q, self.k, self.positive = row, label, q, k, positive
        self.top = float(np.abs(q).max(initial=0))
        self.scaled = q / (self.top or 1.0)
        self.length = float(np.linalg.norm(self.scaled))
        self.low = np.array([w[0] for w in windows], np.int64)
        self.high = np.array([w[1] for w in windows], np.int64)
        floor = np.array([w[0] if w[2] is None else max(w[0], w[2]) for w in windows], np.int64)
        self.floor = floor  # a window takes nothing below it
        self.found: list[list[tuple[int, int, int]]] = [[] for _ in windows]  # (-score, vec_id, row)
        self.scored = 0

    def take(self, tree: CoverTree, a: int, b: int, scores: np.ndarray) -> None:
        """Nodes a to b, where they are their points' first and have the right label."""
        at = tree.point[a:b]
        fit = tree.fresh[a:b] & ((tree.label[at] == self.label) == self.positive) & (scores >= self.floor.min()) & (scores <= self.high.max())
        if self.positive:
            fit &= tree.rows[at] != self.row
        at, scores = at[fit], scores[fit]
        if not len(at):
            return
        for w, best in enumerate(self.found):
            fit = np.flatnonzero((scores >= self.floor[w]) & (scores <= self.high[w]))
            if len(fit) > self.k:
                cut = np.partition(scores[fit], len(fit) - self.k)[len(fit) - self.k]
                fit = fit[scores[fit] >= cut]
            if len(fit):
                best += zip((-scores[fit]).tolist() if scores[fit].min() > LEAST else [-int(s) for s in scores[fit]], tree.ids[at[fit]].tolist(), tree.rows[at[fit]].tolist(), strict=True)
                best.sort()
                del best[self.k :]
                if len(best) == self.k:
                    self.floor[w] = max(self.floor[w], -best[-1][0])

    def bounds(self, tree: CoverTree, a: int, b: int, norm: float) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest scores below nodes a to b, in the anchor's and tree's scale."""
        near, r = tree.near(self.scaled, a, b), tree.radius[a:b]
        d = np.sqrt(np.maximum(0, self.length**2 + norm**2 - 2 * near))
        up = np.where(r < d, d * r - r * r / 2, d * d / 2)
        slack = 1e-9 * (self.length * norm + 1e-300)
        return near - np.minimum(self.length * r, d * r + r * r / 2) - slack, near + np.minimum(self.length * r, up) + slack

    def descend(self, tree: CoverTree) -> None:
        if tree.vectors.shape[1] != len(self.q):
            return
        if tree.norm is None:
            tree.norm = float(np.sqrt(np.square(tree.vectors / tree.scale).sum(axis=1).max(initial=0)))
        unit = lambda x: np.asarray(x, np.float64) / tree.scale / (self.top or 1.0)
        high = unit(self.high)
        bit = np.uint64(1) << np.uint64(self.label % 64)

        def open_(a: int, b: int) -> list[tuple[float, int]]:
            """Nodes of a to b below which something may be found."""
            if self.positive:
                useful = (tree.mask[a:b] & bit) != 0
            else:
                useful = tree.only[a:b] != self.label if self.label != -1 else np.ones(b - a, bool)
            useful &= tree.end[a:b] > tree.start[a:b]
            if not useful.any():
                return []
            low, up = self.bounds(tree, a, b, tree.norm)
            floor = unit(self.floor)
            fits = ((up[:, None] >= floor - np.abs(floor) * 1e-12) & (low[:, None] <= high + np.abs(high) * 1e-12)).any(axis=1) & useful
            return [(-float(up[k]), a + int(k)) for k in np.flatnonzero(fits)]

        self.take(tree, 0, 1, tree.scores(self.q, 0, 1, self.top))
        heap = open_(0, 1)
        while heap:
            up, node = heapq.heappop(heap)
            least = float(unit(self.floor.min()))
            if -up < least - abs(least) * 1e-12:
                break
            a, b = int(tree.start[node]), int(tree.end[node])
            self.scored += b - a
            self.take(tree, a, b, tree.scores(self.q, a, b, self.top))
            for x in open_(a, b):
                heapq.heappush(heap, x)


def _vectors(column: pa.Array) -> list[np.ndarray]:
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]


def _nearest(sent):
    """The sampled row that each row is nearest to, among those of its length."""

    def run(batches):
        tops = sent.value
        for b in batches:
            out = np.zeros(b.num_rows, np.int32)
            vectors = _vectors(b.column("q"))
            sizes = np.array([len(v) for v in vectors], np.int32)
            for n, (m, squares, scale) in tops.items():
                at = np.flatnonzero(sizes == n)
                if len(at):
                    x = np.stack([vectors[k] for k in at])
                    # too large to be squared: any cell will do
                    with np.errstate(over="ignore", invalid="ignore"):
                        out[at] = np.argmin(np.nan_to_num(squares - 2 * (x / scale) @ m.T, nan=0.0), axis=1)
            yield pa.record_batch([*(b.column(c) for c in (ROW, "vec_id", "label", "q")), pa.array(sizes), pa.array(out)], names=[ROW, "vec_id", "label", "q", "dim", "spot"])

    return run


def _planted(batches):
    for b in batches:
        lists = b.column("all")
        offsets, flat = lists.offsets.to_numpy(), lists.values
        out = []
        for k in range(b.num_rows):
            rows = flat.slice(offsets[k], offsets[k + 1] - offsets[k])
            numbers, ids, label = (rows.field(c).to_numpy(zero_copy_only=False) for c in (ROW, "vec_id", "label"))
            order = np.argsort(numbers, kind="stable")
            vectors = rows.field("q").to_pylist()
            out.append(CoverTree.of(np.array([vectors[i] for i in order], np.float64), label[order], ids[order], numbers[order]).packed())
        yield pa.record_batch([pa.array(out, pa.binary())], names=["tree"])


def forests(rows: DataFrame) -> tuple[DataFrame, int]:
    """(g, tree): the cover trees over all rows (_row, vec_id, label, q) and the group of
    each; and the number of groups."""
    spark = rows.sparkSession
    sizes = rows.groupBy(F.size("q").alias("dim")).agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum(F.ceil(F.col("n") * F.col("dim") * 8 / TREE_BYTES)).alias("t")).first()["t"] or 0
    n_top = int(min(TOP, max(1, total)))
    sample = rows.select(ROW, "q").orderBy(F.xxhash64(ROW), ROW).limit(n_top).collect()  # at most TOP vectors
    tops = {}
    for n in {len(r["q"]) for r in sample}:
        m = np.array([r["q"] for r in sample if len(r["q"]) == n], np.float64)
        scale = np.abs(m).max(initial=0) or 1.0
        tops[n] = (m / scale, np.square(m / scale).sum(axis=1), scale)
    sent = spark.sparkContext.broadcast(tops)
    spots = materialise(rows.mapInArrow(_nearest(sent), f"{ROW} long, vec_id long, label long, q array<double>, dim int, spot int"))
    counts = spots.groupBy("dim", "spot").agg(F.count("*").alias("n"))
    parts = counts.select("dim", "spot", F.ceil(F.col("n") * F.col("dim") * 8 / TREE_BYTES).cast("int").alias("parts"))
    dealt = skew_join(spots, parts, ["dim", "spot"], "inner").withColumn("part", F.pmod(F.xxhash64(ROW), F.col("parts")).cast("int"))
    lists = dealt.groupBy("dim", "spot", "part").agg(F.collect_list(F.struct(ROW, "vec_id", "label", "q")).alias("all"))
    trees = materialise(lists.select("all").mapInArrow(_planted, "tree binary").withColumn("number", F.monotonically_increasing_id()))
    groups = max(1, -(-trees.count() // FOREST))
    return trees.select(F.pmod(F.xxhash64("number"), F.lit(groups)).cast("int").alias("g"), "tree"), groups


_FOUND = f"{ROW} long, w int, hit long, hit_row long, score long"


def _searched(k: int, positive: bool):
    """The k best by anchor and window within each group; a group's trees come first."""

    def run(batches):
        group, trees = None, []
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            g, raw, row, label = (b.column(c).to_pylist() for c in ("g", "tree", ROW, "label"))
            vectors, windows = _vectors(b.column("q")), b.column("windows").to_pylist()
            for i in range(b.num_rows):
                if g[i] != group:
                    group, trees = g[i], []
                if raw[i] is not None:
                    trees.append(CoverTree.unpacked(raw[i]))
                    continue
                anchor = Anchor(row[i], label[i], vectors[i], [(w["low"], w["high"], w["floor"]) for w in windows[i]], k, positive)
                for tree in trees:
                    anchor.descend(tree)
                for w, best in enumerate(anchor.found):
                    for score, name, hit in best:
                        for c, v in zip(out, (row[i], w, name, hit, -score), strict=True):
                            c.append(v)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=[ROW, "w", "hit", "hit_row", "score"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy(ROW, "w").orderBy(F.desc("score"), "hit", "hit_row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(trees: DataFrame, groups: int, anchors: DataFrame, k: int, positive: bool) -> DataFrame:
    """_row, w, hit, hit_row, score, rank: each anchor's k best in each of its windows.
    Anchors: _row, label, q, windows (array of structs low, high, floor)."""

    def through(part: DataFrame, own: DataFrame, spots: Column) -> DataFrame:
        return met_in_groups(part, own, spots, groups).mapInArrow(_searched(k, positive), _FOUND)

    every = F.sequence(F.lit(0), F.lit(groups - 1))
    first = materialise(_best(through(trees.where(F.col("g") % WAVE == 0), anchors, F.filter(every, lambda g: g % WAVE == 0)), k).drop("rank"))
    if groups == 1:
        return _best(first, k)
    # what the first wave has found bounds the rest
    kth = first.groupBy(ROW, "w").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k)
    floors = kth.groupBy(ROW).agg(F.map_from_entries(F.collect_list(F.struct("w", "least"))).alias("floors"))
    raised = F.transform("windows", lambda x, w: F.struct(x["low"].alias("low"), x["high"].alias("high"), F.element_at("floors", w).alias("floor")))
    told = anchors.join(floors, ROW, "left").withColumn("windows", raised).select(*anchors.columns)
    rest = through(trees.where(F.col("g") % WAVE != 0), told, F.filter(every, lambda g: g % WAVE != 0))
    return _best(first.unionByName(rest), k)


def mine(vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of vectors
    (vec_id, embedding, label); see the module's text."""
    read = usable(fields(with_row_key(vectors.select("vec_id", "embedding", F.col("label").cast("long").alias("label"))), "vec_id", "embedding", "label"))
    rows = materialise(read.where("label is not null"))
    trees, groups = forests(rows)
    own = rows.where(F.col("vec_id") % every == 0).select(ROW, "label", "q")
    window = lambda lo, hi: F.struct(lo.alias("low"), hi.alias("high"), F.lit(None).cast("long").alias("floor"))
    anchors = own.withColumn("windows", F.array(window(F.lit(LEAST), F.lit(MOST))))
    found = materialise(search(trees, groups, anchors, positives, True).select(ROW, F.col("rank").alias("w"), F.col("hit").alias("positive_id"), F.col("score").alias("positive_score")))
    # low % and high % of the positive's score, rounded inwards
    share = lambda p: F.col("positive_score").cast("decimal(38,0)") * p / 100
    bounds = found.where("positive_score >= 0").select(ROW, "w", window(F.ceil(share(low)).cast("long"), F.floor(share(high)).cast("long")).alias("window"))
    windows = bounds.groupBy(ROW).agg(F.array_sort(F.collect_list(F.struct("w", "window"))).alias("windows")).select(ROW, F.col("windows.window").alias("windows"))
    mined = search(trees, groups, own.join(windows, ROW), negatives, False)
    # the first positives are those of no negative score, so that windows count as positives do
    named = found.join(rows.select(ROW, F.col("vec_id").alias("anchor_id")), ROW)
    out = mined.select(ROW, (F.col("w") + 1).alias("w"), "rank", F.col("hit").alias("negative_id"), F.col("score").alias("negative_score")).join(named, [ROW, "w"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
