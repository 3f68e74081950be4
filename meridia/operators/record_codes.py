"""Codes of a catalogue record by ordered rules over its words: how the sheet was made,
whether in colour, who issued it, what kind of work it is, what research it is fit for.

Words are looked for in folded text (lower case, no accents), anywhere in a field."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from meridia.functions import text as tx
from meridia.operators.rules import decision_list

# The words of each code, in the order in which codes are tried.
MANUSCRIPT_KINDS = ("manuscrit", "manuscript")
MANUSCRIPT_SIGNS = ("manuscrit", "manuscript", " ms ", " ms.", " ms;", "ms.", "au lavis", "a la plume", "sur calque")
PRINT_SIGNS = ("grav", "lithogr", "imprim", "impr.", "estampe", "typogr", "heliograv", "photograv")
COLOUR_SIGNS = ("en coul", "coul.", "col.", ", col", "couleur", "colorie")
MONOCHROME_SIGNS = ("en noir", "n. et b", "noir et blanc", "monochrome")
ISSUERS = (
    ("military_survey", ("service geographique de l'armee", "service geographique de l armee", "depot de la guerre", "ministere de la guerre", "war office", "etat-major", "etat major")),
    ("hydrographic", ("depot des cartes et plans de la marine", "service hydrographique", "hydrograph", "depot general de la marine", "ministere de la marine")),
    ("civil_survey", ("institut geographique national", "service topographique", "institut national de", "cadastre")),
    ("scholarly", ("societe de geographie", "universite", "institut de france", "ecole francaise", "academie", "musee")),
)
NO_PUBLISHER = ("s.n.", "sn]", "inconnu", "unknown", "[s. n.]")
GENRES = (("atlas", ("atlas",)), ("plan", ("plan",)), ("view", ("view", "vue")), ("map", ("map", "carte")))


def _folded(*fields: Column) -> Column:
    """Fields as one folded text; a missing one is empty."""
    return F.concat_ws(" ", *[F.coalesce(tx.fold(f), F.lit("")) for f in fields])


def _holds(words: Column, signs: Sequence[str]) -> Column:
    return tx.contains_any(words, signs)


def _named(publisher: Column) -> Column:
    """Whether a publisher is stated that is not another word for none."""
    folded = _folded(publisher)
    return (folded != "") & ~_holds(folded, NO_PUBLISHER)


def production_mode(kind: Column, physical: Column, creators: Column, description: Column, publisher: Column) -> Column:
    """manuscript, printed or unknown; a named publisher makes a sheet printed that no word
    of its description tells about."""
    by_hand = _holds(_folded(kind), MANUSCRIPT_KINDS) | _holds(_folded(physical), MANUSCRIPT_SIGNS)
    by_press = _holds(_folded(physical, creators, description), PRINT_SIGNS)
    return decision_list([(by_hand, "manuscript"), (by_press | _named(publisher), "printed")], "unknown")


def colour(physical: Column) -> Column:
    words = _folded(physical)
    return decision_list([(_holds(words, COLOUR_SIGNS), "colour"), (_holds(words, MONOCHROME_SIGNS), "monochrome")], "unknown")


def authority(publisher: Column, creators: Column) -> Column:
    """The first kind of issuer whose words publisher or creators hold; else commercial, if a
    publisher is named."""
    words = _folded(publisher, F.lit("|"), creators)
    return decision_list([*((_holds(words, signs), code) for code, signs in ISSUERS), (_named(publisher), "commercial")], "unknown")


def genre(kind: Column) -> Column:
    words = _folded(kind)
    return decision_list([(_holds(words, signs), code) for code, signs in GENRES], "other")


def research_tier(scale_class: Column, scan_class: Column, has_image: Column) -> Column:
    """What a sheet is fit for: measured on, if its scale and scan both serve; looked at, if
    it can be; else only cited."""
    is_in = lambda c, *v: F.coalesce(c.isin(*v), F.lit(False))
    legible = is_in(scan_class, "high", "medium")
    measurable = is_in(scale_class, "large", "medium") & legible
    return decision_list([(measurable, "1_analytic"), (legible | F.coalesce(has_image, F.lit(False)), "2_contextual")], "3_reference")
