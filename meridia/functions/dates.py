"""Partial dates: bounds, precision, periods, years in running text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meridia.functions.text import ordinal


def first_year(c: Column) -> Column:
    """The first year from 1000 to 2029 in a text."""
    return F.regexp_extract(c, r"(1[0-9]{3}|20[0-2][0-9])", 1).try_cast("int")


def _token_bounds(token: Column) -> Column:
    """struct<low, high> of ``1888``, ``188.`` or ``18..``; null unless the token is two to four
    digits, the first 1 or 2, and dots."""
    digits = F.regexp_extract(F.trim(token), r"^([12][0-9]{1,3})[.\s]*$", 1)
    return F.when(digits != "", F.struct(F.rpad(digits, 4, "0").try_cast("int").alias("low"), F.rpad(digits, 4, "9").try_cast("int").alias("high")))


def _bounds(text: Column) -> Column:
    """struct<low, high> of a text: an ISO date, or tokens between dashes and strokes."""
    bare = F.regexp_replace(F.trim(text), r"^[\[\]]+|[\[\]]+$", "")
    # an ISO date holds dashes too, so it is tried before the text is split at them
    iso = F.regexp_extract(bare, r"^([0-9]{4})-[0-9]{2}-[0-9]{2}$", 1).try_cast("int")
    found = F.filter(F.transform(F.split(bare, r"\s*[-/]\s*"), _token_bounds), lambda x: x.isNotNull())

    def spread(f: Column) -> Column:
        ends = F.struct(F.array_min(F.transform(f, lambda x: x["low"])).alias("low"), F.array_max(F.transform(f, lambda x: x["high"])).alias("high"))
        return F.when(F.size(f) > 0, ends)

    # the tokens are read once, in a list of one
    return F.when(iso.isNotNull(), F.struct(iso.alias("low"), iso.alias("high"))).otherwise(F.transform(F.array(found), spread)[0])


def bounds(texts: Column) -> Column:
    """struct<low, high> of the first of several texts that states a date; else null."""
    return F.try_element_at(F.filter(F.transform(texts, _bounds), lambda x: x.isNotNull()), F.lit(1))


def earliest(c: Column) -> Column:
    return _bounds(c)["low"]


def latest(c: Column) -> Column:
    return _bounds(c)["high"]


def century(low: Column, high: Column) -> Column:
    """A label if both bounds lie in one century, else empty."""
    return F.coalesce(F.when(F.floor(low / 100) == F.floor(high / 100), F.concat(ordinal(F.floor(low / 100) + 1), F.lit(" c."))), F.lit(""))


def precision(low: Column, high: Column) -> Column:
    span = high - low
    return F.when(low.isNull() | high.isNull(), "none").when(span == 0, "exact").when(span <= 9, "decade").when(span <= 99, "century").otherwise("multi")


def period(year: Column, cut: int, before: str, after: str) -> Column:
    y = year.try_cast("int")
    return F.when(y.isNull(), "unknown").when(y < cut, before).otherwise(after)


def decade(year: Column) -> Column:
    return F.concat(F.left(year.cast("string"), F.lit(3)), F.lit("0s"))


def years_in(c: Column, low: int, high: int) -> Column:
    """Distinct years of a plausible range in a text, sorted."""
    found = F.transform(F.regexp_extract_all(c, F.lit(r"\b([0-9]{4})\b"), F.lit(1)), lambda y: y.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda y: y.between(low, high))))


def date_label(low: Column, high: Column) -> Column:
    return F.when(low.isNull(), "n.d.").when(low == high, low.cast("string")).otherwise(F.concat_ws("–", low.cast("string"), high.cast("string")))


def century_key(label: Column) -> Column:
    """A number to sort century labels by; 99 without one."""
    return F.coalesce(F.regexp_replace(label, "[^0-9]", "").try_cast("int"), F.lit(99))


def survey_gap(early: Column, late: Column) -> Column:
    """struct<same_survey, gap>: whether two lists of survey years state the same years (both
    some), and the years from the early list's last to the late one's; null if either is empty."""
    some = (F.coalesce(F.size(early), F.lit(0)) > 0) & (F.coalesce(F.size(late), F.lit(0)) > 0)
    same = some & (F.size(F.array_except(early, late)) == 0) & (F.size(F.array_except(late, early)) == 0)
    return F.struct(F.coalesce(same, F.lit(False)).alias("same_survey"), F.when(some, F.array_max(late) - F.array_max(early)).alias("gap"))
