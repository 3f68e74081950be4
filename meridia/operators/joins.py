"""Joins: precedence, upsert, pairs, cells, nearest, greedy matching, names.

Spatial joins go by cells: both sides are dealt to square cells no smaller than the
radius, met by equality of cells, and tested exactly. No side is compared whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.operators.shared import connected_components, materialise


def left_default(left: DataFrame, right: DataFrame, key: str, defaults: dict[str, str]) -> DataFrame:
    """Left join; what the right side lacks gets its coded default."""
    return left.join(right, key, "left").fillna(defaults)


def precedence_merge(sources: Sequence[tuple[str, DataFrame]], key: str, value: str) -> DataFrame:
    """key, value, basis: for each key the value of the first source that has one."""
    out = None
    for place, (name, df) in enumerate(sources):
        part = df.where(F.col(value).isNotNull()).select(key, F.col(value), F.lit(name).alias("basis"), F.lit(place).alias("place"))
        out = part if out is None else out.unionByName(part)
    best = out.groupBy(key).agg(F.min(F.struct("place", value, "basis")).alias("b"))
    return best.select(key, F.col(f"b.{value}").alias(value), "b.basis")


def rename_by_alias(values: Column, aliases: dict[str, str]) -> Column:
    """An array's values with those that have an alias renamed."""
    if not aliases:
        return values
    known = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.transform(values, lambda v: F.coalesce(F.try_element_at(known, v), v))


def ordered_union(first: Column, more: Column, aliases: dict[str, str]) -> Column:
    """The first array's values, then those of the other, renamed, that are new; in order."""
    return F.array_distinct(F.concat(first, rename_by_alias(more, aliases)))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows by key, the new one where there are both."""
    rest = [c for c in old.columns if c != key]
    a, b = old.select(key, F.struct(*rest).alias("o")), new.select(key, F.struct(*rest).alias("n"))
    return a.join(b, key, "full_outer").select(key, F.coalesce("n", "o").alias("r")).select(key, "r.*")


def replace_source(old: DataFrame, new: DataFrame, column: str, value: str) -> DataFrame:
    """All rows of one source replaced, those of others as they were."""
    return old.where(~F.col(column).eqNullSafe(F.lit(value))).unionByName(new)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def flagged_pairs(df: DataFrame, keys: Sequence[str], ident: str, flag: Column) -> DataFrame:
    """Groups of exactly two rows of which exactly one is flagged: its id and the other's."""
    grouped = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(flag.cast("int")).alias("f"), F.max(F.when(flag, F.col(ident))).alias("flagged"), F.max(F.when(~flag, F.col(ident))).alias("other"))
    return grouped.where("n = 2 and f = 1").drop("n", "f")


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("long")


def radius_join(left: DataFrame, right: DataFrame, radius: float, prefix: str = "r_") -> DataFrame:
    """Pairs of rows (x, y) no further apart than the radius, with their distance. The
    right side's columns get a prefix; the left side goes to the nine cells around it. Both
    sides are dealt out: rows made from keys are many more bytes than their files, by which
    Spark would send a side through the driver."""
    b = right.select(*[F.col(c).alias(prefix + c) for c in right.columns]).withColumns({"_cx": _cell(F.col(prefix + "x"), radius), "_cy": _cell(F.col(prefix + "y"), radius)})
    around = F.explode(F.array(*[F.lit(d) for d in (-1, 0, 1)]))
    a = left.withColumn("_dx", around).withColumn("_dy", around).withColumns({"_cx": _cell(F.col("x"), radius) + F.col("_dx"), "_cy": _cell(F.col("y"), radius) + F.col("_dy")})
    d = F.sqrt(F.pow(F.col("x") - F.col(prefix + "x"), 2) + F.pow(F.col("y") - F.col(prefix + "y"), 2))
    return a.join(b.hint("merge"), ["_cx", "_cy"]).withColumn("distance", d).where(F.col("distance") <= radius).drop("_cx", "_cy", "_dx", "_dy")


def greedy_match(early: DataFrame, late: DataFrame, radius: float) -> DataFrame:
    """One-to-one pairs (id, late_id, distance): each early point's nearest late point,
    ascending by distance, each late point once. Every early point has one candidate, so
    the greedy pass is the same as the least distance for each late point."""
    near = radius_join(early.select("id", "x", "y"), late.select("id", "x", "y"), radius)
    one = first_per_key(near, ["id"], [F.col("distance"), F.col("r_id")])
    return first_per_key(one, ["r_id"], [F.col("distance"), F.col("id")]).select("id", F.col("r_id").alias("late_id"), "distance")


def match_counts(early: DataFrame, late: DataFrame, radii: Sequence[float]) -> DataFrame:
    """radius, matched, early_only, late_only. Pairs are found once, at the greatest radius:
    a point's nearest partner stays its nearest within any radius that holds it."""
    matched = greedy_match_within(early, late, radii)
    a, b = early.agg(F.count("*").alias("a")), late.agg(F.count("*").alias("b"))
    wanted = early.sparkSession.createDataFrame([(float(r),) for r in radii], "radius double")
    counts = wanted.join(matched.groupBy("radius").agg(F.count("*").alias("matched")), "radius", "left").fillna({"matched": 0})
    return counts.crossJoin(F.broadcast(a)).crossJoin(F.broadcast(b)).select("radius", "matched", (F.col("a") - F.col("matched")).alias("early_only"), (F.col("b") - F.col("matched")).alias("late_only"))


def greedy_match_within(early: DataFrame, late: DataFrame, radii: Sequence[float]) -> DataFrame:
    """radius, id, late_id, distance: greedy_match for each of several radii."""
    near = radius_join(early.select("id", "x", "y"), late.select("id", "x", "y"), max(radii))
    one = first_per_key(near, ["id"], [F.col("distance"), F.col("r_id")])
    each = one.withColumn("radius", F.explode(F.array(*[F.lit(float(r)) for r in radii]))).where("distance <= radius")
    return first_per_key(each, ["radius", "r_id"], [F.col("distance"), F.col("id")]).select("radius", "id", F.col("r_id").alias("late_id"), "distance")


def box_overlap_join(left: DataFrame, right: DataFrame, size: float, least: float = 0.15) -> DataFrame:
    """Pairs of boxes (id, w, s, e, n) that share at least a part of the smaller one's
    area. A box goes to all cells that it covers; a pair counts in the cell that holds
    the south-west corner of what it shares, so no pair comes twice."""

    def dealt(df: DataFrame, p: str) -> DataFrame:
        cells = lambda a, b: F.sequence(_cell(F.col(a), size), _cell(F.col(b), size))
        out = df.where("e > w and n > s").withColumn("_cx", F.explode(cells("w", "e"))).withColumn("_cy", F.explode(cells("s", "n")))
        return out.select(*[F.col(c).alias(p + c) for c in ("id", "w", "s", "e", "n")], "_cx", "_cy")

    j = dealt(left, "a_").join(dealt(right, "b_").hint("merge"), ["_cx", "_cy"])
    w, s = F.greatest("a_w", "b_w"), F.greatest("a_s", "b_s")
    width, height = F.least("a_e", "b_e") - w, F.least("a_n", "b_n") - s
    smaller = F.least((F.col("a_e") - F.col("a_w")) * (F.col("a_n") - F.col("a_s")), (F.col("b_e") - F.col("b_w")) * (F.col("b_n") - F.col("b_s")))
    j = j.where((_cell(w, size) == F.col("_cx")) & (_cell(s, size) == F.col("_cy")) & (width > 0) & (height > 0))
    return j.withColumn("share", width * height / smaller).where(F.col("share") >= least).select("a_id", "b_id", "share")


def nearest_1d(left: DataFrame, right: DataFrame, x: str, grid: str, width: float, partition: Sequence[str] = ()) -> DataFrame:
    """Each left value's nearest right value; the lower one on a tie. Values are dealt to
    cells of the line, ``width`` wide; within a cell an ordered pass gives the last grid value
    at or before and the first at or after, and each cell is told the nearest grid value
    below and above it, by an order over the cells alone."""
    keys = list(partition)
    cell = F.floor(F.col("_x") / width).cast("long")
    a = left.withColumns({"_x": F.col(x).cast("double"), "_g": F.lit(None).cast("double")})
    b = right.select(*keys, F.col(grid).cast("double").alias("_x")).where("_x is not null").distinct().withColumn("_g", F.col("_x"))
    both = a.withColumn("_own", F.lit(True)).unionByName(b.withColumn("_own", F.lit(False)), allowMissingColumns=True).withColumn("_cell", cell)
    line = Window.partitionBy(*keys).orderBy("_cell")
    cells = both.groupBy(*keys, "_cell").agg(F.min("_g").alias("_low"), F.max("_g").alias("_high"))
    told = cells.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_cell").alias("_kc"),
        F.last("_high", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1)).alias("_below"), F.first("_low", ignorenulls=True).over(line.rowsBetween(1, Window.unboundedFollowing)).alias("_above"),
    )
    order = Window.partitionBy(*keys, "_cell").orderBy("_x")
    before = F.last("_g", ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first("_g", ignorenulls=True).over(order.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    near = both.withColumns({"_b": before, "_a": after}).where("_own")
    on = near["_cell"].eqNullSafe(told["_kc"])
    for k in keys:
        on = on & near[k].eqNullSafe(told[f"_k_{k}"])
    out = near.join(told, on, "left").withColumns({"_b": F.coalesce("_b", "_below"), "_a": F.coalesce("_a", "_above")})
    low = F.col("_b").isNotNull() & (F.col("_a").isNull() | (F.col("_x") - F.col("_b") <= F.col("_a") - F.col("_x")))
    nearest = F.when(F.col("_x").isNotNull(), F.when(low, F.col("_b")).otherwise(F.col("_a")))
    return out.withColumn("nearest", nearest).withColumn("distance", F.abs(F.col("_x") - F.col("nearest"))).select(*left.columns, "nearest", "distance")


def winner_and_runner_up(scored: DataFrame, key: str, entity: str, distance: str) -> DataFrame:
    """The nearest entity of each key, and the nearest of another entity."""
    best = scored.groupBy(key, entity).agg(F.min(distance).alias("d"))
    ranked = best.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("d", entity))).where("n <= 2")
    pick = lambda n, c: F.max(F.when(F.col("n") == n, F.col(c)))
    return ranked.groupBy(key).agg(pick(1, entity).alias("winner"), pick(1, "d").alias("winner_distance"), pick(2, entity).alias("runner_up"), pick(2, "d").alias("runner_up_distance"))


def resolve_names(names: DataFrame, name: str, variants: DataFrame, prefixes: Sequence[str], full: str) -> DataFrame:
    """Canonical names in three steps: as it stands, with its prefix written in full, with
    it dropped; the first that the vocabulary (variant, canonical) knows, else the name."""
    head = f"^(?:{'|'.join(prefixes)})\\s+"
    v = variants  # Spark sends it to all tasks if it is small, and deals it out if not
    steps = (F.col(name), F.regexp_replace(name, head, full + " "), F.regexp_replace(name, head, ""))
    out = names
    for k, step in enumerate(steps):
        out = out.withColumn("_k", step).join(v.select(F.col("variant").alias("_k"), F.col("canonical").alias(f"_c{k}")), "_k", "left").drop("_k")
    found = F.coalesce("_c0", "_c1", "_c2")
    return out.withColumn("canonical", F.coalesce(found, F.col(name))).withColumn("matched", found.isNotNull()).drop("_c0", "_c1", "_c2")


def source_agreement(labels: DataFrame, entity: str, source: str, order: Column) -> DataFrame:
    """Entities on two sources or more: the first label of each of the two earliest
    sources, side by side. labels: entity, source, x, y."""
    firsts = first_per_key(labels, [entity, source], [order])
    ranked = firsts.withColumn("k", F.row_number().over(Window.partitionBy(entity).orderBy(source))).where("k <= 2")
    pick = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    both = ranked.groupBy(entity).agg(F.count("*").alias("n"), *[pick(k, c).alias(f"{c}{k}") for k in (1, 2) for c in (source, "x", "y")])
    return both.where("n = 2").drop("n")


def word_windows(df: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(key, _w): hashes of a text's runs of so many words, the whole text, each run once."""
    w = F.regexp_extract_all(F.col(text), F.lit("[^ \t\n\x0B\f\r]+"), F.lit(0))
    rows = df.select(key, w.alias("_ws")).where(F.size("_ws") >= words)
    runs = F.transform(F.sequence(F.lit(1), F.size("_ws") - (words - 1)), lambda i: F.xxhash64(F.array_join(F.slice("_ws", i, words), " ")))
    return rows.select(key, F.explode(F.array_distinct(runs)).alias("_w"))


def shared_windows(items: DataFrame, item: str, docs: DataFrame, doc: str, text: str, words: int) -> DataFrame:
    """item, n: how many documents hold a run of so many words of the item's text, anywhere
    in it. An equality join on the runs: Spark sends the items' round if they are small,
    and deals both sides by run if not. Hits are counted by document, so the pairs that
    meet are distinct first."""
    hits = word_windows(docs, doc, text, words).join(word_windows(items, item, text, words), "_w").select(item, doc).distinct()
    return items.select(item).join(hits.groupBy(item).agg(F.count("*").alias("n")), item, "left").fillna({"n": 0})


def first_and_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n and the last n rows of each group's ranking, with their place and end; a
    row of a short group comes once. Two partial top-n passes, no whole sort of a group."""
    up = df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n).withColumn("side", F.lit("first"))
    back = [c.desc_nulls_last() for c in order]
    down = df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*back))).where(F.col("place") <= n).withColumn("side", F.lit("last"))
    size = df.groupBy(*keys).agg(F.count("*").alias("_size"))
    last = down.join(size, list(keys)) if keys else down.crossJoin(F.broadcast(size))
    return up.unionByName(last.where(F.col("_size") - F.col("place") >= n).drop("_size"))


#: Eastings of a sheet that a northing meets in one part.
LINES_A_PART = 2000


def line_intersections(lines: DataFrame, sheet: str) -> DataFrame:
    """sheet, i, j, x, y: where a sheet's eastings (x - tan_e y = u) and northings (y - tan_n x
    = v) cross. lines: sheet, axis ('e' or 'n'), number, constant, tan. Pairs are within a
    sheet; a sheet's eastings are dealt to as many parts as leave LINES_A_PART to one, were
    all on one sheet, and its northings go to each, so that no sheet is one task."""
    e = lines.where("axis = 'e'").select(sheet, F.col("number").alias("i"), F.col("constant").alias("u"), F.col("tan").alias("tan_e"))
    n = lines.where("axis = 'n'").select(sheet, F.col("number").alias("j"), F.col("constant").alias("v"), F.col("tan").alias("tan_n"))
    c, det = F.col, 1 - F.col("tan_e") * F.col("tan_n")
    parts = max(1, -(-e.count() // LINES_A_PART))
    e = e.withColumn("_part", F.pmod(F.xxhash64("i", "u"), F.lit(parts)))
    n = n.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return e.join(n.hint("merge"), [sheet, "_part"]).where(det != 0).select(sheet, "i", "j", ((c("u") + c("tan_e") * c("v")) / det).alias("x"), ((c("v") + c("tan_n") * c("u")) / det).alias("y"))


#: Pixels ahead and aside, and degrees, within which a fragment continues another (fixed values).
AHEAD, ASIDE, TURN = 26.0, 5.0, 35.0


def corridor_links(fragments: DataFrame, ahead: float = AHEAD, aside: float = ASIDE, turn: float = TURN) -> DataFrame:
    """(a, b, a_end, b_end): ends of two fragments of which one lies in the corridor ahead of
    the other, where both point about the same way. fragments: id, x0, y0, x1, y1 (its ends)
    and ax, ay (its axis, a unit vector from the first end to the second)."""
    c = F.col
    two = F.array(F.struct(F.lit(0).alias("k"), c("x0").alias("x"), c("y0").alias("y"), (-c("ax")).alias("ox"), (-c("ay")).alias("oy")), F.struct(F.lit(1).alias("k"), c("x1").alias("x"), c("y1").alias("y"), c("ax").alias("ox"), c("ay").alias("oy")))
    ends = fragments.select("id", "ax", "ay", F.explode(two).alias("e")).select("id", "ax", "ay", "e.*")
    near = radius_join(ends, ends, ahead).where("id <> r_id")
    dx, dy = c("r_x") - c("x"), c("r_y") - c("y")
    forward, side = dx * c("ox") + dy * c("oy"), F.abs(dy * c("ox") - dx * c("oy"))
    held = near.where((forward > 0) & (forward <= ahead) & (side <= aside) & (F.abs(c("ax") * c("r_ax") + c("ay") * c("r_ay")) >= F.cos(F.radians(F.lit(float(turn))))))
    swap = c("id") > c("r_id")
    pick = lambda p, q: F.when(swap, c(q)).otherwise(c(p))
    return held.select(pick("id", "r_id").alias("a"), pick("r_id", "id").alias("b"), pick("k", "r_k").alias("a_end"), pick("r_k", "k").alias("b_end")).distinct()


#: Pixels between characters of a line and of their baselines, and the share by which heights
#: may differ (fixed values).
GAP, BASELINE, HEIGHT_SHARE = 70.0, 5.0, 0.30


def without_line_neighbours(boxes: DataFrame, sheet: str, gap: float = GAP, baseline: float = BASELINE, share: float = HEIGHT_SHARE) -> DataFrame:
    """Boxes (sheet, id, x0, y0, x1, y1; y1 the foot) beside which no other stands as the next
    character would: close, on the same baseline, of about the same height. Boxes are dealt
    to the cells that they and the gap around them cover."""
    at = lambda c, size: F.floor(c / size).cast("long")
    c, p = F.col, "o_"
    other = boxes.select(*[F.col(n).alias(p + n) for n in (sheet, "id", "x0", "y0", "x1", "y1")])
    other = other.withColumn("_cx", F.explode(F.sequence(at(c(p + "x0"), gap), at(c(p + "x1"), gap)))).withColumn("_cy", at(c(p + "y1"), baseline))
    own = boxes.withColumn("_cx", F.explode(F.sequence(at(c("x0") - gap, gap), at(c("x1") + gap, gap)))).withColumn("_dy", F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)]))).withColumn("_cy", at(c("y1"), baseline) + c("_dy"))
    height = c("y1") - c("y0")
    beside = F.greatest(c(p + "x0") - c("x1"), c("x0") - c(p + "x1")) <= gap
    level = F.abs(c(p + "y1") - c("y1")) <= baseline
    alike = F.abs((c(p + "y1") - c(p + "y0")) - height) <= share * height
    met = own.join(other, (own["_cx"] == other["_cx"]) & (own["_cy"] == other["_cy"]) & (own[sheet] == other[p + sheet]) & (own["id"] != other[p + "id"]) & beside & level & alike, "left_semi")
    return boxes.join(met.select(sheet, "id").distinct(), [sheet, "id"], "left_anti")


def linked_runs(fragments: DataFrame, passes: int = 3) -> DataFrame:
    """id, members, x0, y0, x1, y1, ax, ay: fragments joined into runs. Each pass links what the
    corridors join, and a run's longer axis lets the next pass link ends that a dash alone
    could not orient; it ends when a pass finds no new link. What a pass hands on is one
    row a run."""
    c = F.col
    state = fragments.select("id", F.lit(1).cast("long").alias("members"), "x0", "y0", "x1", "y1", "ax", "ay")
    for _ in range(passes):
        state = materialise(state)
        links = materialise(corridor_links(state))
        if not links.limit(1).count():
            break
        run = state.join(connected_components(links, "a", "b").withColumnRenamed("node", "id"), "id", "left").withColumn("run", F.coalesce("component", "id"))
        ends = run.select("run", "members", F.explode(F.array(F.struct(c("x0").alias("x"), c("y0").alias("y"), F.lit(1).alias("first")), F.struct(c("x1").alias("x"), c("y1").alias("y"), F.lit(0).alias("first")))).alias("e")).select("run", "members", "e.*")
        axis = ends.groupBy("run").agg((F.lit(0.5) * F.atan2(2 * F.covar_pop("x", "y"), F.var_pop("x") - F.var_pop("y"))).alias("t"), F.sum(c("members") * c("first")).alias("n"))
        along = ends.join(axis, "run").withColumn("u", c("x") * F.cos("t") + c("y") * F.sin("t"))
        far = F.struct("u", "x", "y")
        state = along.groupBy("run").agg(F.first("n").alias("members"), F.min(far).alias("p"), F.max(far).alias("q"))
        dx, dy = c("q.x") - c("p.x"), c("q.y") - c("p.y")
        size = F.sqrt(dx * dx + dy * dy)
        unit = lambda d: F.when(size > 0, d / size).otherwise(0.0)
        state = state.select(c("run").alias("id"), c("members").cast("long").alias("members"), c("p.x").alias("x0"), c("p.y").alias("y0"), c("q.x").alias("x1"), c("q.y").alias("y1"), unit(dx).alias("ax"), unit(dy).alias("ay"))
    return state


def nearest_by_source(scored: DataFrame, key: str, source: str, entity: str, distance: str) -> DataFrame:
    """key, entity, source, distance (the pooled winner), runner_up, runner_up_distance (the
    nearest of another entity), sources_naming, sources_agreeing, by_source (array of source,
    entity, distance: each source's own nearest). scored holds the labels within reach, a row a
    key and label; ties go to the lesser entity, then source. Each source's nearest is a
    partial minimum; a key has as many rows after it as sources and entities."""
    nearest = lambda *by: F.min(F.struct(F.col(distance).alias("d"), F.col(entity).alias("e"), F.col(source).alias("s"))).alias("b")
    own = scored.groupBy(key, source).agg(nearest()).groupBy(key).agg(F.min("b").alias("w"), F.array_sort(F.collect_list(F.struct("b.s", "b.e", "b.d"))).alias("by_source"))
    ranked = scored.groupBy(key, entity).agg(F.min(distance).alias("d")).withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("d", entity))).where("n = 2")
    second = ranked.select(F.col(key).alias("_k"), F.col(entity).alias("runner_up"), F.col("d").alias("runner_up_distance"))
    agreeing = F.size(F.filter("by_source", lambda b: b["e"].eqNullSafe(F.col("w")["e"])))
    return own.join(second, F.col(key) == F.col("_k"), "left").select(key, F.col("w.e").alias("entity"), F.col("w.s").alias("source"), F.col("w.d").alias("distance"), "runner_up", "runner_up_distance", F.size("by_source").alias("sources_naming"), agreeing.alias("sources_agreeing"), "by_source")


def shared_corners(open_: DataFrame, grounded: DataFrame, radius: float, most_off: float) -> DataFrame:
    """sheet, distance, neighbour: sheets borne out by a corner of a grounded one, the nearest
    within the radius, of the same zone and another sheet. Both sides: sheet, zone, x, y, a row
    a corner; open sheets carry off, how far the catalogue puts them, and are only tried up
    to ``most_off``. Grounded sheets are no open ones, so that nothing is borne out in chains."""
    tried = open_.where(F.col("off") <= most_off).join(grounded.select("sheet").distinct().hint("merge"), "sheet", "left_anti")
    near = radius_join(tried, grounded.select("sheet", "zone", "x", "y"), radius).where((F.col("zone") == F.col("r_zone")) & (F.col("sheet") != F.col("r_sheet")))
    return near.groupBy("sheet").agg(F.min(F.struct("distance", F.col("r_sheet").alias("n"))).alias("b")).select("sheet", F.col("b.distance").alias("distance"), F.col("b.n").alias("neighbour"))


def missing_last(c: Column, sentinel) -> Column:
    """A sort key under which a missing value counts as the sentinel."""
    return F.coalesce(c, F.lit(sentinel))
