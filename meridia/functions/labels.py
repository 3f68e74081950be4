"""Patterns of printed labels and the values after them, put together from named pieces.

A label is spelled as it is printed; what a scan or a typist may change about it follows by
rule: case, accents, and the kind and number of blanks. Values are numbers of so many digits,
angles, words. Groups are counted where a value is caught."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAGS = "(?iuU)"
#: Letters of a word, accented ones and hyphens included, and what may stand between parts.
WORD, BLANKS = r"\p{L}[\p{L}-]*", r"\s*"
#: Signs that stand for degrees, minutes and seconds; a second's may be two of a minute's.
DEGREE, MINUTE, SECOND = "°", "['ʹ′]", "(?:''|[″\"])"


def _letter(c: str) -> str:
    """A printed letter with or without its accents, composed or not."""
    plain = unicodedata.normalize("NFD", c)[0]
    kin = sorted({x for x in map(chr, range(0xC0, 0x180)) if unicodedata.normalize("NFD", x)[0] == plain})
    return f"[{plain}{''.join(kin)}]\\p{{M}}*" if plain.isalpha() and plain != c else "\\" + c if not c.isalnum() else c


def spelled(label: str) -> str:
    """The label however it is written."""
    return r"\s+".join("".join(map(_letter, word)) for word in label.split())


def digits(least: int, most: int | None = None) -> str:
    return f"[0-9]{{{least},{most or least}}}"


def caught(piece: str) -> str:
    return f"({piece})"


def maybe(piece: str) -> str:
    return f"(?:{piece})?"


def either(*pieces: str) -> str:
    return f"(?:{'|'.join(pieces)})"


def row(*pieces: str, between: str = BLANKS) -> str:
    """One piece after another, blanks between them."""
    return between.join(pieces)


def angle() -> str:
    """Degrees, minutes and seconds, three groups; the last two may be missing."""
    part = lambda size, sign: row(caught(digits(1, size)), sign)
    return row(part(3, DEGREE), maybe(part(2, MINUTE)), maybe(part(2, SECOND)))


def sides() -> str:
    """West to east over north to south: a letter and an angle four times, 16 groups."""
    side = lambda letters: row(caught(f"[{letters}]"), angle())
    span = lambda letters: row(side(letters), "-{1,2}", side(letters))
    return row(span("EW"), "/", span("NS"))


def after(text: Column, label: str, value: str, between: str = BLANKS) -> Column:
    """What the value's group holds where it follows the label; null where nothing does."""
    return F.nullif(F.trim(F.regexp_extract(text, FLAGS + row(spelled(label), value, between=between), 1)), F.lit(""))


def follows(text: Column, label: str) -> Column:
    """The text after the first label, null where there is none."""
    return F.when(text.rlike(FLAGS + spelled(label)), F.regexp_extract(text, FLAGS + "(?s)" + spelled(label) + "(.*)", 1))


def year_of(text: Column) -> Column:
    return text.try_cast("int")
