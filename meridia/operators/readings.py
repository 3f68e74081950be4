"""What is made of marks and texts that were read off scans, as tables: agreement of several
readings, labels of a graticule, marks outside of type, profiles of glyphs, the lean of a
grid, and the placing of sheets by their grid lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.operators import aggregates as agg
from meridia.operators import joins
from meridia.operators import sequences as seq


def agreed_readings(readings: DataFrame, keys: Sequence[str], low: int, high: int) -> DataFrame:
    """keys, km, votes, metres: the kilometres that readings (keys, line, km, metre) of all
    lines give, with their votes, and the metres that two passes over one line agree on:
    the last digits are read badly, and count only so. Values beyond low to high metres
    are left out."""
    sound = readings.where(F.col("km").between(low // 1000, high // 1000))
    same = sound.groupBy(*keys, "line", "km", "metre").agg(F.count("*").alias("n"))
    value = F.col("km") * 1000 + F.col("metre")
    metres = F.collect_set(F.when((F.col("n") > 1) & value.between(low, high), value))
    return same.groupBy(*keys, "km").agg(F.sum("n").alias("votes"), F.array_sort(metres).alias("metres"))


def label_minutes(text: Column) -> Column:
    """The centesimal minutes that a graticule label can mean, as parts of a grade: groups of
    two digits that are a whole ten; a digit alone is a bare grade, and so none."""
    groups = F.filter(F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)), lambda g: F.length(g) <= 2)
    number = lambda g: g.cast("int")
    meant = F.filter(groups, lambda g: (F.length(g) == 1) | ((number(g) % 10 == 0) & (number(g) > 0)))
    return F.transform(meant, lambda g: F.when(F.length(g) == 1, 0.0).otherwise(number(g) / 100.0))


#: Confidence and height that make a token type, and pixels around it (fixed values).
CONFIDENCE, TALLEST, PAD = 20.0, 40, 2


def type_boxes(tokens: DataFrame, sheet: str) -> DataFrame:
    """Boxes (sheet, x0, y0, x1, y1) of the tokens (text, conf, x, y, w, h) that are type."""
    c = F.col
    sure = tokens.where((F.trim("text") != "") & (c("conf") > CONFIDENCE) & (c("h") <= TALLEST))
    return sure.select(sheet, (c("x") - PAD).alias("x0"), (c("y") - PAD).alias("y0"), (c("x") + c("w") + PAD).alias("x1"), (c("y") + c("h") + PAD).alias("y1"))


def outside_boxes(points: DataFrame, boxes: DataFrame, sheet: str, cell: float) -> DataFrame:
    """Points (sheet, x, y, ...) that no box of their sheet holds. Boxes are dealt to the cells
    they cover, points to their own."""
    c, at = F.col, lambda x: F.floor(x / cell).cast("long")
    dealt = boxes.select(F.col(sheet).alias("_sheet"), "x0", "y0", "x1", "y1", F.explode(F.sequence(at(c("x0")), at(c("x1")))).alias("_bx")).withColumn("_by", F.explode(F.sequence(at(c("y0")), at(c("y1")))))
    own = points.withColumns({"_cx": at(c("x")), "_cy": at(c("y"))})
    held = (c("x") >= c("x0")) & (c("x") < c("x1")) & (c("y") >= c("y0")) & (c("y") < c("y1"))
    return own.join(dealt, (own[sheet] == dealt["_sheet"]) & (own["_cx"] == dealt["_bx"]) & (own["_cy"] == dealt["_by"]) & held, "left_anti").drop("_cx", "_cy")


#: Rows and shares of a dome on a stem above a disc (fixed values).
DISC_LEAST, STEM_LEAST, WAIST_SHARE, DOME_SHARE = 9, 3, 0.50, (0.40, 0.90)


def waisted(widths: Column) -> Column:
    """struct<dome, waist, disc, waist_row, fits> of a mark's widths by row, from above: the
    disc is the widest row of the lower half, the dome the widest above it, the waist the
    narrowest between; it fits if the waist is narrow, the dome of the right share, and the
    disc the larger. Rows count from 0; the first of equal rows stands."""
    indexed = F.transform(widths, lambda w, i: F.struct(w.cast("double").alias("w"), (-i).alias("k")))
    low = F.transform(widths, lambda w, i: F.struct(w.cast("double").alias("w"), i.alias("k")))
    middle = F.floor(F.size(widths) / 2).cast("int")
    disc = F.array_max(F.slice(indexed, middle + 1, F.greatest(F.size(widths) - middle, F.lit(0))))

    def from_disc(d: Column) -> Column:
        row = -d["k"]
        dome = F.array_max(F.slice(indexed, F.lit(1), row))

        def from_dome(m: Column) -> Column:
            waist = F.array_min(F.slice(low, 1 - m["k"], row + m["k"] + 1))
            fits = (d["w"] >= DISC_LEAST) & (row >= STEM_LEAST) & (row + m["k"] >= STEM_LEAST) & (waist["w"] <= WAIST_SHARE * d["w"])
            fits = fits & m["w"].between(DOME_SHARE[0] * d["w"], DOME_SHARE[1] * d["w"]) & (d["w"] > m["w"])
            return F.struct(m["w"].alias("dome"), waist["w"].alias("waist"), d["w"].alias("disc"), waist["k"].alias("waist_row"), fits.alias("fits"))

        return F.when(row > 0, F.transform(F.array(dome), from_dome)[0])

    return F.when(F.size(widths) > 1, F.transform(F.array(disc), from_disc)[0])


def best_angle(profiles: DataFrame, keys: Sequence[str], angle: str, pos: str, c: str, lags: Sequence[int], near: float | None = None) -> DataFrame:
    """keys, angle, lag, strength: the angle whose profile repeats itself most at one of the
    lags (sum of products over the sum of squares). With ``near``, the coarse angles (whole
    ones) are tried first and then only those so close to the best."""

    def strongest(df: DataFrame) -> DataFrame:
        r = seq.autocorrelation(df, [*keys, angle], pos, c, lags)
        power = df.groupBy(*keys, angle).agg(F.sum(F.col(c) * F.col(c)).alias("_p"))
        s = r.join(power, [*keys, angle]).withColumn("strength", F.when(F.col("_p") > 0, F.col("r") / F.col("_p")).otherwise(0.0))
        return s.groupBy(*keys).agg(F.max_by(F.struct(angle, "lag", "strength"), F.struct("strength", -F.col(angle), -F.col("lag"))).alias("b")).select(*keys, f"b.{angle}", "b.lag", "b.strength")

    if near is None:
        return strongest(profiles)
    coarse = strongest(profiles.where(F.col(angle) == F.rint(angle))).select(*keys, F.col(angle).alias("_best"))
    return strongest(profiles.join(coarse, list(keys)).where(F.abs(F.col(angle) - F.col("_best")) <= near).drop("_best"))


def rank_of(scores: DataFrame, keys: Sequence[str], c: str, marked: Column) -> DataFrame:
    """keys, marked, above, share_below: where the best of the marked rows stands among all
    scores of its group: how many score higher, and the share that scores lower."""
    best = scores.groupBy(*keys).agg(F.max(F.when(marked, F.col(c))).alias("marked"))
    j = scores.join(best, list(keys)).groupBy(*keys, "marked")
    return j.agg(F.count_if(F.col(c) > F.col("marked")).alias("above"), (F.count_if(F.col(c) < F.col("marked")) / F.count("*")).alias("share_below")).where("marked is not null")


def place_sheets(lines: DataFrame, anchors: DataFrame, sheet: str, step: float = 1000.0) -> DataFrame:
    """sheet, n, coefficients (a, b, c easting; d, e, f northing), rms: the map from pixels to
    ground that the crossings of a sheet's grid lines give. lines as line_intersections has
    them, numbered in grid steps; anchors: sheet, east, north of the lines numbered 0,
    northings falling with their number. Sheets without two lines an axis are left out."""
    crossings = joins.line_intersections(lines, sheet).join(anchors, sheet)
    ground = crossings.select(sheet, "x", "y", (F.col("east") + F.col("i") * step).alias("e"), (F.col("north") - F.col("j") * step).alias("n"))
    fit = agg.affine_fit(ground, [sheet], "x", "y", ["e", "n"]).withColumnRenamed("n", "crossings")
    residual = agg.affine_residuals(ground, fit, [sheet], "x", "y", ["e", "n"]).groupBy(sheet).agg(F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("rms"))
    return fit.where("a_e is not null").join(residual, sheet)
