"""Units, ellipses, components and colours over points and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions import geo
from meridia.operators.rounds import first_free_colours
from meridia.operators.shared import connected_components, materialise


def point_in_units(points: DataFrame, units: DataFrame, cell: float) -> DataFrame:
    """Each point's unit: the first, by ``place``, whose ring holds it; null outside all.
    units: unit, place, ring. Rings go to the cells of their extent, points to one."""
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    at = lambda c: F.floor(c / cell).cast("long")
    dealt = units.withColumn("_cx", F.explode(F.sequence(at(F.array_min(xs)), at(F.array_max(xs))))).withColumn("_cy", F.explode(F.sequence(at(F.array_min(ys)), at(F.array_max(ys)))))
    p = points.withColumns({"_cx": at(F.col("x")), "_cy": at(F.col("y"))})
    hit = F.when(geo.in_ring(F.col("x"), F.col("y"), F.col("ring")), F.struct("place", "unit"))
    # by row, so that rows of one id each keep their own place
    rows = p.withColumn("_row", F.struct(*points.columns))
    found = rows.select("_row", "_cx", "_cy", "x", "y").distinct().join(dealt, ["_cx", "_cy"]).groupBy("_row").agg(F.min(hit).alias("_h"))
    return rows.join(found, "_row", "left").withColumn("unit", F.col("_h.unit")).select(*points.columns, "unit")


def lattice_coverage(boxes: DataFrame, west: float, south: float, columns: int, rows: int, step: float) -> DataFrame:
    """Share of a lattice's sample points that any box (w, s, e, n) holds. A box lists the
    lattice places it covers itself, so that no point is tried against every box."""
    span = lambda a, b, o, n: F.sequence(F.greatest(F.lit(0), F.ceil((F.col(a) - o) / step)).cast("int"), F.least(F.lit(n - 1), F.floor((F.col(b) - o) / step)).cast("int"))
    some = lambda a, b, o, n: F.greatest(F.lit(0), F.ceil((F.col(a) - o) / step)) <= F.least(F.lit(n - 1), F.floor((F.col(b) - o) / step))
    inside = boxes.where(some("w", "e", west, columns) & some("s", "n", south, rows))
    held = inside.withColumn("i", F.explode(span("w", "e", west, columns))).withColumn("j", F.explode(span("s", "n", south, rows))).select("i", "j").distinct()
    return held.agg((F.count("*") / F.lit(float(columns * rows))).alias("share"))


# -- ellipses ---------------------------------------------------------------------------

FLOOR_KM, GUARD_KM, TOLERANCE = 4.0, 90.0, 1e-9


def ellipses(labels: DataFrame, entity: str, floor: float = FLOOR_KM) -> DataFrame:
    """The least scaled ellipse around each entity's labels (x, y in kilometres): centre,
    angle of the main axis, half-extents of ``floor`` at least, scaled to hold the
    farthest own label."""
    shape = labels.groupBy(entity).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.coalesce(F.lit(0.5) * F.atan2(2 * F.covar_pop("x", "y"), F.var_pop("x") - F.var_pop("y")), F.lit(0.0)).alias("angle"))
    j = labels.join(shape, entity)
    u, v = _frame("x", "y")
    half = j.withColumns({"u": u, "v": v}).groupBy(entity).agg(F.greatest(F.lit(floor), F.max(F.abs("u"))).alias("a0"), F.greatest(F.lit(floor), F.max(F.abs("v"))).alias("b0"))
    j = j.join(half, entity).withColumns({"u": u, "v": v})
    scale = j.groupBy(entity).agg(F.greatest(F.lit(1.0), F.max(F.sqrt(F.pow(F.col("u") / F.col("a0"), 2) + F.pow(F.col("v") / F.col("b0"), 2)))).alias("k"))
    return shape.join(half, entity).join(scale, entity).select(entity, "cx", "cy", "angle", (F.col("a0") * F.col("k")).alias("a"), (F.col("b0") * F.col("k")).alias("b"))


def _frame(x: str, y: str) -> tuple[Column, Column]:
    dx, dy = F.col(x) - F.col("cx"), F.col(y) - F.col("cy")
    return dx * F.cos("angle") + dy * F.sin("angle"), dy * F.cos("angle") - dx * F.sin("angle")


def foreign(shapes: DataFrame, labels: DataFrame, entity: str, reach: float) -> DataFrame:
    """Labels of other entities near each ellipse, met by cells of ``reach`` kilometres,
    which must be no less than the half-axes plus the growth allowed."""
    at = lambda c: F.floor(F.col(c) / reach).cast("long")
    around = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    e = shapes.withColumn("_i", around).withColumn("_j", around).withColumns({"_cx": at("cx") + F.col("_i"), "_cy": at("cy") + F.col("_j")}).drop("_i", "_j")
    other = labels.select(F.col(entity).alias("other"), "x", "y", at("x").alias("_cx"), at("y").alias("_cy"))
    u, v = _frame("x", "y")
    return e.join(other, ["_cx", "_cy"]).where(F.col("other") != F.col(entity)).withColumns({"u": F.abs(u), "v": F.abs(v)}).drop("_cx", "_cy")


def foreign_inside(shapes: DataFrame, labels: DataFrame, entity: str, least: float = 180.0) -> DataFrame:
    """entity, n: how many labels of other entities each ellipse holds (those that hold any),
    however large it is. Cells are ``least`` wide, or so many times twice that an ellipse's
    box is no wider: it goes to four of them at most, a label to one of each width in use."""
    c = F.col
    half = lambda p, q: F.sqrt(F.pow(c("a") * p, 2) + F.pow(c("b") * q, 2)) * (1 + 1e-6)
    e = shapes.withColumns({"_hx": half(F.cos("angle"), F.sin("angle")), "_hy": half(F.sin("angle"), F.cos("angle"))})
    e = materialise(e.withColumn("_cell", least * F.pow(2.0, F.greatest(F.lit(0.0), F.ceil(F.log2(2 * F.greatest("_hx", "_hy") / least)).cast("double")))))
    at = lambda v: F.floor(v / c("_cell")).cast("long")
    span = lambda v, h: F.explode(F.sequence(at(c(v) - c(h)), at(c(v) + c(h))))
    dealt = e.withColumn("_cx", span("cx", "_hx")).withColumn("_cy", span("cy", "_hy"))
    widths = e.select("_cell").distinct()
    other = labels.select(c(entity).alias("other"), "x", "y").crossJoin(F.broadcast(widths)).withColumns({"_cx": at(c("x")), "_cy": at(c("y"))})
    u, v = _frame("x", "y")
    met = dealt.join(other, ["_cell", "_cx", "_cy"]).where(c("other") != c(entity)).where(F.pow(u / c("a"), 2) + F.pow(v / c("b"), 2) <= 1 + TOLERANCE)
    return met.groupBy(entity).agg(F.count("*").alias("n"))


def grow(shapes: DataFrame, labels: DataFrame, entity: str, guard: float = GUARD_KM, steps: int = 40) -> DataFrame:
    """How far both half-axes can grow, up to ``guard``, before a foreign label comes
    inside; 0 where one is inside already. The least of the per-label roots is the root
    for all, so each label is bisected alone. Adds grown, stopper and at_guard."""
    near = foreign(shapes, labels, entity, 2 * guard)
    inside = lambda g: F.pow(F.col("u") / (F.col("a") + g), 2) + F.pow(F.col("v") / (F.col("b") + g), 2) <= 1.0 + TOLERANCE
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(float(guard)).alias("hi"))

    def halve(acc, _):
        mid = (acc["lo"] + acc["hi"]) / 2
        return F.when(inside(mid), F.struct(acc["lo"].alias("lo"), mid.alias("hi"))).otherwise(F.struct(mid.alias("lo"), acc["hi"].alias("hi")))

    root = F.when(inside(F.lit(0.0)), 0.0).when(~inside(F.lit(float(guard))), float(guard)).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda acc: acc["lo"]))
    limit = near.withColumn("root", root).groupBy(entity).agg(F.min("root").alias("grown"), F.min_by("other", F.struct("root", "other")).alias("stopper"), F.array_sort(F.collect_set(F.when(F.col("root") == 0, F.col("other")))).alias("enclosed"))
    out = shapes.join(limit, entity, "left").withColumn("grown", F.coalesce("grown", F.lit(float(guard))))
    return out.withColumn("at_guard", F.col("grown") >= guard).withColumn("enclosed", F.coalesce("enclosed", F.array().cast("array<string>")))


def outside_own(shapes: DataFrame, labels: DataFrame, entity: str, tolerance: float = 0.02) -> DataFrame:
    """Own labels outside their ellipse: the invariant is that there are none."""
    u, v = _frame("x", "y")
    return labels.join(shapes, entity).where(F.pow(u / F.col("a"), 2) + F.pow(v / F.col("b"), 2) > 1 + tolerance)


# -- graphs -----------------------------------------------------------------------------


#: Edges of a task that tells them apart.
EDGES_A_TASK = 500_000


def one_hop(candidates: DataFrame, grounded: DataFrame, edges: DataFrame, least: int = 2) -> DataFrame:
    """Candidates that ``least`` grounded nodes or more bear out over an edge (a, b). Only
    nodes grounded by themselves count, so nothing is borne out in chains. Edges may come more
    than once and either way round; of each, the end that is not grounded is borne out, if the
    other is. They are told apart in tasks by their number, whatever the session's setting."""
    c = F.col
    ground = materialise(grounded.select("id").distinct())
    tasks = max(1, -(-edges.count() // EDGES_A_TASK))
    marked = lambda end: ground.select(c("id").alias(end), F.lit(True).alias(f"_{end}"))
    met = edges.select("a", "b").join(marked("a"), "a", "left").join(marked("b"), "b", "left")
    bare = c("_a").isNull()
    one = met.where(bare != c("_b").isNull()).select(F.when(bare, c("a")).otherwise(c("b")).alias("id"), F.when(bare, c("b")).otherwise(c("a")).alias("by"))
    held = one.repartition(tasks, "id", "by").distinct().groupBy("id").agg(F.count("*").alias("support"))
    return candidates.join(ground, "id", "left_anti").join(held.where(c("support") >= least), "id")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of edges (a, b): the least node reachable, however far."""
    return connected_components(edges, "a", "b")


def colours(edges: DataFrame, group: str) -> DataFrame:
    """Greedy colouring by falling degree, then node: each group (a sheet) by itself, in
    rounds over the nodes that wait for no other, so that no group meets in one task. Edges
    may come more than once and either way round."""
    c = F.col
    pairs = materialise(edges.select(group, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    ends = pairs.select(group, c("a").alias("node")).unionByName(pairs.select(group, c("b").alias("node")))
    nodes = materialise(ends.groupBy(group, "node").agg(F.count("*").alias("degree")).withColumn("id", F.monotonically_increasing_id()))
    named = lambda end: nodes.select(group, c("node").alias(end), c("degree").alias(f"{end}_degree"), c("id").alias(f"{end}_id"))
    met = pairs.join(named("a"), [group, "a"]).join(named("b"), [group, "b"])
    # of equal degree, a comes first: it is the lesser
    first = c("a_degree") >= c("b_degree")
    ordered = met.select(F.when(first, c("b_id")).otherwise(c("a_id")).alias("low"), F.when(first, c("a_id")).otherwise(c("b_id")).alias("high"))
    return first_free_colours(nodes.select("id", group, "node"), ordered).select(group, "node", "colour")


def nearest_other_source(labels: DataFrame, key: str, source: str, distance: str) -> DataFrame:
    return labels.withColumn("_n", F.row_number().over(Window.partitionBy(key, source).orderBy(distance))).where("_n = 1").drop("_n")
