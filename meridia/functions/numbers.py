"""Numbers: parsers of stated measures, bands, grades, scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def decimal(c: Column) -> Column:
    """A double from text with a decimal comma or point."""
    return F.replace(c, F.lit(","), F.lit(".")).try_cast("double")


def rounded(c: Column, places: int) -> Column:
    """A double of 0 or more to so many places, in doubles throughout as SQL engines round;
    F.round goes by way of decimals, which costs more than the pair that is rounded."""
    return F.floor(c * 10.0**places + 0.5) / F.lit(10.0**places)


def scale_denominator(c: Column, marker: str = "chelle") -> Column:
    """The first denominator of 10 or more in the segments that speak of a scale."""
    segments = F.filter(F.split(c, r"\|"), lambda s: s.contains(marker))
    found = F.flatten(F.transform(segments, lambda s: F.regexp_extract_all(s, F.lit(r"1\s*:\s*([0-9][0-9 .]*)"), F.lit(1))))
    values = F.transform(found, lambda d: F.regexp_replace(d, "[^0-9]", "").try_cast("long"))
    return F.try_element_at(F.filter(values, lambda v: v >= 10), F.lit(1))


def dms(degrees: Column, minutes: Column, seconds: Column, side: Column) -> Column:
    """Signed decimal degrees; west and south are negative."""
    size = degrees + minutes / 60.0 + seconds / 3600.0
    return F.when(F.upper(side).isin("W", "S", "O"), -size).otherwise(size)


def coded_dms(c: Column) -> Column:
    """``E0133000`` as degrees; null for any other form."""
    part = lambda k: F.regexp_extract(c, r"^([EWNS])([0-9]{3})([0-9]{2})([0-9]{2})$", k)
    return F.when(part(1) != "", dms(part(2).try_cast("double"), part(3).try_cast("double"), part(4).try_cast("double"), part(1)))


#: A stated pair of sides, and centimetres of a unit, in the order they are looked for
#: (fixed values, as are the limits below).
PAIR = r"([0-9]+(?:[.,][0-9]+)?)\s*[x×]\s*([0-9]+(?:[.,][0-9]+)?)"
SIDE_UNITS = ((r"\s*cm", 1.0), (r"\s*mm", 0.1), (r"\s*m\b", 100.0))


def dimensions(c: Column) -> Column:
    """struct<width, height, area> in centimetres from a stated size: the first pair in
    centimetres anywhere in the text, else in millimetres, else in metres; a pair without
    unit is metres if both are under 10, centimetres up to 250, and millimetres beyond.
    Blanks around a decimal comma are repaired. Sides beyond 1 to 1000 cm make it null."""
    fixed = F.regexp_replace(c, r"([0-9])\s*,\s*([0-9])", "$1,$2")

    def sides(pattern: str, factor) -> Column:
        a, b = (decimal(F.regexp_extract(fixed, pattern, k)) for k in (1, 2))
        f = F.lit(factor) if factor else F.when(F.greatest(a, b) < 10, 100.0).when(F.greatest(a, b) <= 250, 1.0).otherwise(0.1)
        return F.when(fixed.rlike(pattern), F.struct((a * f).alias("width"), (b * f).alias("height")))

    found = F.coalesce(*[sides(PAIR + unit, factor) for unit, factor in SIDE_UNITS], sides(PAIR, None))
    width, height = found["width"], found["height"]
    return F.when(width.between(1, 1000) & height.between(1, 1000), F.struct(width.alias("width"), height.alias("height"), (width * height).alias("area")))


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """struct<west, south, east, north> from two opposite corners in any order."""
    return F.struct(F.least(x1, x2).alias("west"), F.least(y1, y2).alias("south"), F.greatest(x1, x2).alias("east"), F.greatest(y1, y2).alias("north"))


#: Metres of a degree at the equator and of latitude; half of the last stated unit in
#: degrees; minutes that a sheet's sides lie between (fixed values).
METRES_LON, METRES_LAT = 111_320.0, 111_132.0
HALF_UNIT = {"degree": 0.5, "minute": 0.5 / 60, "second": 0.5 / 3600, "finer": 0.5 / 3600}
WIDTH_MINUTES, HEIGHT_MINUTES = (12.0, 32.0), (7.0, 16.0)


def uncertainty(b: Column, metres_per_pixel: Column) -> Column:
    """What a stated box (struct<west, south, east, north>) and a scan's pixel let one place a
    point by: half of the finest unit that a side is stated in, in metres; two pixels for
    the grid and four for a symbol's centre; whether the sheet's size is plausible."""
    unit = stated_unit(b["west"], b["east"], b["north"], b["south"])
    half = F.lit(HALF_UNIT["finer"])
    for name, size in HALF_UNIT.items():
        half = F.when(unit == name, size).otherwise(half)
    middle = (b["north"] + b["south"]) / 2
    width, height = (b["east"] - b["west"]) * 60, (b["north"] - b["south"]) * 60
    coarse = unit.isin("degree", "minute")
    return F.struct(
        unit.alias("corner_unit"), F.round(half * METRES_LON * F.cos(F.radians(middle))).alias("lon_m"), F.round(half * METRES_LAT).alias("lat_m"), F.round(width, 2).alias("width_arcmin"), F.round(height, 2).alias("height_arcmin"),
        (width.between(*WIDTH_MINUTES) & height.between(*HEIGHT_MINUTES)).alias("plausible"), F.round(2 * metres_per_pixel).alias("grid_m"), F.round(4 * metres_per_pixel).alias("symbol_m"),
        F.when(coarse, "kilometric_grid").otherwise("kilometric_grid (bbox usable as fallback)").alias("control"),
    )


def band(c: Column, rules: Sequence[tuple[float, str]], beyond: str, missing: str = "unknown", closed: bool = True) -> Column:
    """The first band whose ceiling holds the value: up to the ceiling if ``closed``, else
    below it."""
    out = F.lit(beyond)
    for ceiling, label in reversed(rules):
        out = F.when((c <= ceiling) if closed else (c < ceiling), label).otherwise(out)
    return F.when(c.isNull(), missing).otherwise(out)


def grade(score: Column, floors: Sequence[tuple[float, str]], below: str) -> Column:
    """The first grade whose floor the score reaches; floors fall."""
    out = F.lit(below)
    for floor, label in reversed(floors):
        out = F.when(score >= floor, label).otherwise(out)
    return out


def completeness(*present: Column) -> Column:
    out = F.lit(0)
    for p in present:
        out = out + F.coalesce(p, F.lit(False)).cast("int")
    return out


def stated_unit(*degrees: Column) -> Column:
    """The finest unit that several coordinates are stated in: each is taken to be in the
    coarsest unit that it is a whole multiple of."""
    rank = lambda x: F.when(F.abs(x - F.rint(x)) < 1e-6, 0).when(F.abs(x * 60 - F.rint(x * 60)) < 1e-4, 1).when(F.abs(x * 3600 - F.rint(x * 3600)) < 1e-2, 2).otherwise(3)
    ranks = [rank(d) for d in degrees]
    finest = F.greatest(*ranks) if len(ranks) > 1 else ranks[0]
    return F.element_at(F.array(*[F.lit(x) for x in ("degree", "minute", "second", "finer")]), finest + 1)


def dpi(width_px: Column, height_px: Column, width_cm: Column, height_cm: Column, sheets: Column | None = None) -> Column:
    """Dots an inch of a scan, longest side over longest side. With ``sheets``, only where
    that is empty, null or 1: a scan shows one sheet, and a catalogue measures the set."""
    out = F.greatest(width_px, height_px) / (F.greatest(width_cm, height_cm) / 2.54)
    return out if sheets is None else F.when(F.coalesce(sheets.cast("string"), F.lit("")).isin("", "1"), out)
