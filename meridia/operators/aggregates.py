"""Aggregations: distributions, medians, votes, shares, density, fits.

Each has a partial stage: what is shuffled is one row a group and task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distribution(df: DataFrame, c: str, seen: str) -> DataFrame:
    """Counts by value with the place where each was first seen, which settles ties."""
    return df.groupBy(c).agg(F.count("*").alias("n"), F.min(seen).alias("first_seen"))


def upper_median(df: DataFrame, keys: Sequence[str], c: str) -> DataFrame:
    """keys, upper_median: the upper of the two middle values when their number is even. By
    the values' counts, so a group's equal values are one row and none is collected."""
    counts = df.where(F.col(c).isNotNull()).groupBy(*keys, c).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy(c)
    upto = F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("_n").over(Window.partitionBy(*keys))
    placed = counts.withColumn("_upto", upto).withColumn("_total", total)
    return placed.where("_upto > floor(_total / 2)").groupBy(*keys).agg(F.min(c).alias("upper_median"))


def envelope(df: DataFrame, keys: Sequence[str], margin: float = 0.0) -> DataFrame:
    """keys, west, south, east, north, n: what all boxes of a group lie in, and a margin."""
    m = F.lit(float(margin))
    return df.groupBy(*keys).agg((F.min("west") - m).alias("west"), (F.min("south") - m).alias("south"), (F.max("east") + m).alias("east"), (F.max("north") + m).alias("north"), F.count("*").alias("n"))


def summary(df: DataFrame, counts: dict[str, Column], extremes: dict[str, Column], distributions: Sequence[str]) -> DataFrame:
    """One row that sums up a table: how many rows, how many each condition holds for, the
    least and greatest of each measure, and a map of counts by value of each column named:
    a column of few values. One pass for the first three, a small join for each map."""
    measures = [a for k, c in extremes.items() for a in (F.min(c).alias(f"least_{k}"), F.max(c).alias(f"greatest_{k}"))]
    out = df.agg(F.count("*").alias("rows"), *[F.count_if(c).alias(k) for k, c in counts.items()], *measures)
    for c in distributions:
        by = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).agg(F.count("*").alias("n"))
        ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "v", "n")))
        pairs = F.transform(ordered, lambda x: F.struct(x["v"].alias("key"), x["n"].alias("value")))
        out = out.crossJoin(F.broadcast(by.agg(F.map_from_entries(pairs).alias(f"by_{c}"))))
    return out


def vote(df: DataFrame, keys: Sequence[str], value: str, seen: str) -> DataFrame:
    """The most frequent value of each group, its votes and all; ties to the first seen."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(seen).alias("first"))
    best = F.max_by(F.struct(F.col(value).alias("v"), F.col("n").alias("n")), F.struct("n", -F.col("first")))
    return counts.groupBy(*keys).agg(best.alias("b"), F.sum("n").alias("total")).select(*keys, F.col("b.v").alias("winner"), F.col("b.n").alias("votes"), "total")


def resolve(df: DataFrame, keys: Sequence[str], value: str, scores: Sequence[Column]) -> DataFrame:
    """The value with the greatest scores, compared one after the other."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*scores)).alias("resolved"))


def share_of_total(df: DataFrame, c: str) -> DataFrame:
    """Adds each row's share of the total, a single row that is sent to all."""
    return df.crossJoin(F.broadcast(df.agg(F.sum(c).alias("_total")))).withColumn("share", F.col(c) / F.col("_total")).drop("_total")


def reconcile(df: DataFrame, c: str, stated: float) -> DataFrame:
    """The sum against a stated total: difference and per cent of the stated."""
    s = F.sum(c)
    return df.agg(s.alias("total"), F.lit(float(stated)).alias("stated"), (F.lit(float(stated)) - s).alias("difference"), ((F.lit(float(stated)) - s) / F.lit(float(stated)) * 100).alias("percent"))


def assert_reconciled(df: DataFrame, c: str, stated: float, tolerance: float) -> DataFrame:
    """As reconcile, but a difference beyond the tolerance fails the job."""
    out = reconcile(df, c, stated)
    return out.withColumn("ok", F.coalesce(F.assert_true(F.abs("difference") <= tolerance, "the stated total is stale").cast("boolean"), F.lit(True)))


def density(units: DataFrame, points: DataFrame, unit: str, area: Column, floor: float) -> DataFrame:
    """Count, density and basis for each unit, those without points too: measured from
    the floor on, too little read below it, no sheet without any area."""
    counts = points.groupBy(unit).agg(F.count("*").alias("n"))
    out = units.join(counts, unit, "left").fillna({"n": 0}).withColumn("area", area)
    basis = F.when(F.col("area") >= floor, "measured").when(F.col("area") > 0, "too_little_read").otherwise("no_sheet")
    return out.withColumn("basis", basis).withColumn("density", F.when(F.col("basis") == "measured", F.col("n") / F.col("area")))


#: Parts that an interval is counted by, and values few enough to be fetched.
PARTS, FEW = 1024, 2048


def exact_quantiles(df: DataFrame, c: str, shares: Sequence[float], few: int = FEW) -> list[float] | None:
    """The column's quantiles, between neighbouring values as their shares fall: exact, by
    counting. Intervals that hold a wanted place are counted in PARTS until they hold few
    values, or one value many times; each pass is a partial aggregate, and the driver gets
    counts, ends and those few values. Nulls are left out; None where nothing is left."""
    v = df.select(F.col(c).cast("double").alias("v")).where("v is not null")
    n, low, high = v.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    places = sorted({k for q in shares for k in (int((n - 1) * q), min(n - 1, int((n - 1) * q) + 1))})
    known: dict[int, float] = {}
    open_ = [(low, high, 0, n)]  # least and greatest value, values before it, values in it
    while open_:
        wide = [o for o in open_ if o[0] < o[1] and o[3] > few]
        for lo, hi, before, m in open_:
            if lo == hi:
                known |= dict.fromkeys((k for k in places if before <= k < before + m), lo)
            elif m <= few:
                values = sorted(r["v"] for r in v.where(F.col("v").between(lo, hi)).collect())
                known |= {k: values[k - before] for k in places if before <= k < before + m}
        open_ = []
        for lo, hi, before, m in wide:
            # halved first, so that the width of an interval over all doubles is still one
            part = F.least(F.floor((F.col("v") / 2 - F.lit(lo) / 2) / (F.lit(hi) / 2 - F.lit(lo) / 2) * PARTS), F.lit(PARTS - 1))
            counted = sorted(map(tuple, v.where(F.col("v").between(lo, hi)).groupBy(part.alias("p")).agg(F.min("v"), F.max("v"), F.count("*")).collect()))
            for _, a, b, size in counted:
                if any(before <= k < before + size for k in places):
                    open_.append((a, b, before, size))
                before += size
    out = []
    for q in shares:
        h = (n - 1) * q
        a, b = known[int(h)], known[min(n - 1, int(h) + 1)]
        out.append(a + (b - a) * (h - int(h)))
    return out


def quantile_classes(df: DataFrame, c: str, classes: int = 7) -> DataFrame:
    """Each row's class by quantile breaks, from 1; all in class 1 if there are fewer rows
    than classes, or no values. The breaks are a few constants."""
    breaks = exact_quantiles(df, c, [k / classes for k in range(1, classes)]) or []
    if not breaks or df.where(F.col(c).isNotNull()).limit(classes).count() < classes:
        return df.withColumn("class", F.lit(1))
    above = F.array(*map(F.lit, breaks))
    return df.withColumn("class", (1 + F.size(F.filter(above, lambda b: b < F.col(c)))).cast("int"))


def dedup_merge(df: DataFrame, key: str, seen: str, carried: Sequence[str], merged: Sequence[str], all_true: Sequence[str] = ()) -> DataFrame:
    """One row a key: carried columns of the row seen first, merged ones as sorted
    distinct lists, and flags that hold only if they hold for all."""
    aggs = [F.min_by(c, seen).alias(c) for c in carried] + [F.array_sort(F.collect_set(c)).alias(c) for c in merged] + [F.bool_and(c).alias(c) for c in all_true]
    return df.groupBy(key).agg(*aggs)


# -- fits: sums, centred for their condition, and a closed solution --------------------


def _solve2(sxx, sxy, syy, bx, by):
    det = sxx * syy - sxy * sxy
    return (bx * syy - by * sxy) / det, (by * sxx - bx * sxy) / det


def affine_fit(df: DataFrame, keys: Sequence[str], x: str, y: str, targets: Sequence[str]) -> DataFrame:
    """Least-squares coefficients t = a x + b y + c of each target: columns a_t, b_t, c_t.
    Groups without two independent directions get nulls."""
    means = df.groupBy(*keys).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"), *[F.avg(t).alias(f"_m{t}") for t in targets])
    j = _with(df, means, keys)
    dx, dy = F.col(x) - F.col("_mx"), F.col(y) - F.col("_my")
    sums = [F.sum(dx * dx).alias("_xx"), F.sum(dx * dy).alias("_xy"), F.sum(dy * dy).alias("_yy")]
    for t in targets:
        dt = F.col(t) - F.col(f"_m{t}")
        sums += [F.sum(dx * dt).alias(f"_x{t}"), F.sum(dy * dt).alias(f"_y{t}")]
    firsts = [F.first(c).alias(c) for c in ("_mx", "_my", *[f"_m{t}" for t in targets])]
    out = j.groupBy(*keys).agg(*sums, *firsts, F.count("*").alias("n"))
    sound = F.col("_xx") * F.col("_yy") - F.col("_xy") * F.col("_xy") > 1e-9 * F.col("_xx") * F.col("_yy")
    cols = []
    for t in targets:
        a, b = _solve2(F.col("_xx"), F.col("_xy"), F.col("_yy"), F.col(f"_x{t}"), F.col(f"_y{t}"))
        a, b = F.when(sound, a), F.when(sound, b)
        cols += [a.alias(f"a_{t}"), b.alias(f"b_{t}"), (F.col(f"_m{t}") - a * F.col("_mx") - b * F.col("_my")).alias(f"c_{t}")]
    return out.select(*keys, "n", *cols)


def _with(df: DataFrame, one: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(one, list(keys)) if keys else df.crossJoin(F.broadcast(one))


def affine_residuals(df: DataFrame, fit: DataFrame, keys: Sequence[str], x: str, y: str, targets: Sequence[str]) -> DataFrame:
    j = _with(df, fit, keys)
    d = [F.col(t) - (F.col(f"a_{t}") * F.col(x) + F.col(f"b_{t}") * F.col(y) + F.col(f"c_{t}")) for t in targets]
    return j.withColumn("residual", F.sqrt(sum((r * r for r in d[1:]), d[0] * d[0])))


def leave_one_out(df: DataFrame, keys: Sequence[str], x: str, y: str, targets: Sequence[str]) -> DataFrame:
    """Each row's error under the fit to the other rows of its group, from the group's
    sums less its own part; null where fewer than four rows remain."""
    means = df.groupBy(*keys).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"), *[F.avg(t).alias(f"_m{t}") for t in targets])
    j = _with(df, means, keys)
    values = {"_1": F.lit(1.0), "_x": F.col(x) - F.col("_mx"), "_y": F.col(y) - F.col("_my")} | {f"_t{t}": F.col(t) - F.col(f"_m{t}") for t in targets}
    j = j.withColumns(values)
    left = [("_1", "_1"), ("_1", "_x"), ("_1", "_y"), ("_x", "_x"), ("_x", "_y"), ("_y", "_y")] + [(a, f"_t{t}") for t in targets for a in ("_1", "_x", "_y")]
    sums = j.groupBy(*keys).agg(*[F.sum(F.col(a) * F.col(b)).alias(f"S{a}{b}") for a, b in left])
    j = _with(j, sums, keys)
    s = lambda a, b: F.col(f"S{a}{b}") - F.col(a) * F.col(b)
    n, sx, sy = s("_1", "_1"), s("_1", "_x"), s("_1", "_y")
    cxx, cxy, cyy = s("_x", "_x") - sx * sx / n, s("_x", "_y") - sx * sy / n, s("_y", "_y") - sy * sy / n
    squares = None
    for t in targets:
        st = s("_1", f"_t{t}")
        a, b = _solve2(cxx, cxy, cyy, s("_x", f"_t{t}") - sx * st / n, s("_y", f"_t{t}") - sy * st / n)
        r = F.col(f"_t{t}") - (st / n + a * (F.col("_x") - sx / n) + b * (F.col("_y") - sy / n))
        squares = r * r if squares is None else squares + r * r
    out = j.withColumn("loo_error", F.when(n >= 4, F.sqrt(squares)))
    return out.drop(*[c for c in out.columns if c.startswith(("_", "S_"))])


def principal_axis(x: Column, y: Column) -> Column:
    """Angle of the longest axis in radians, from variances and covariance."""
    return F.lit(0.5) * F.atan2(2 * F.covar_pop(x, y), F.var_pop(x) - F.var_pop(y))


def mode(df: DataFrame, keys: Sequence[str], c: str) -> DataFrame:
    """keys, mode, votes: each group's most frequent value, the least of equals; nulls do not
    count. Values are counted first, so that no group is in one place."""
    counts = df.where(F.col(c).isNotNull()).groupBy(*keys, c).agg(F.count("*").alias("votes"))
    return counts.groupBy(*keys).agg(F.min(F.struct((-F.col("votes")).alias("n"), F.col(c).alias("v"))).alias("b")).select(*keys, F.col("b.v").alias("mode"), (-F.col("b.n")).alias("votes"))
