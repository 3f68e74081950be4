"""Coding rules of a catalogue of maps: what kind of drawing a record is, whether it can be
placed, what it covers, and on which evidence a code rests. All are column expressions over
one row; every code comes with its reasons or its basis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from meridia.operators.rules import decision_list, reasons

#: Tiers of placing a sheet on the ground, best first (fixed values).
DIRECT, CONTROL, WARP, NOT_PLACEABLE = "1_direct", "2_control_points", "3_warp_only", "4_not_georeferenceable"


def geometry_tier(
    year: Column, genre: Column, authority: Column, chart_title: Column, has_scale: Column, resolution: Column, partner: Column, has_box: Column, surveyors: Sequence[str]
) -> Column:
    """struct<geometric, tier, blockers>. The class follows from genre, authority and year;
    the tier from the class, raised where a box and a scale locate a survey or chart,
    lowered where the scan or the scale is lacking, and lowered to a warp where a partner
    hosts the image and no box is stated. Blockers list all that stands in the way."""
    coarse = resolution.isin("low", "unknown")
    yes = lambda c: F.coalesce(c, F.lit(False))
    geometric = decision_list(
        [
            (genre == "atlas", "atlas_volume"), (genre == "view", "sketch_view"), (yes(authority.isin(*surveyors) & (year >= 1830)), "survey"),
            (yes((year >= 1600) & (yes(authority == "hydrographic") | yes(chart_title))), "chart"), (yes(year >= 1700), "early_modern"),
        ],
        "sketch",
    )
    first = F.when(geometric == "survey", DIRECT).when(geometric.isin("chart", "early_modern"), CONTROL).otherwise(WARP)
    moved = F.when(has_box & has_scale & geometric.isin("survey", "chart"), DIRECT).when((first == DIRECT) & (coarse | ~has_scale), CONTROL).otherwise(first)
    whole = geometric.isin("atlas_volume", "sketch_view")
    tier = F.when(whole, NOT_PLACEABLE).when(partner & ~has_box, WARP).otherwise(moved)
    blockers = reasons([
        (partner, "no IIIF (partner-hosted)"), (coarse, "scan resolution low or unknown"), (~has_scale, "no stated scale"),
        (geometric == "atlas_volume", "atlas volume: georeference individual plates, not the record"), (geometric == "sketch_view", "perspective view, not a plan"),
        (partner & ~whole, "image not on IIIF; fetch from the holding library"),
    ])
    return F.struct(geometric.alias("geometric"), tier.alias("tier"), blockers.alias("blockers"))


def qualification(layers: Column, relevant: Sequence[str], distributional: Sequence[str], main_subject: Column, tier: Column) -> Column:
    """struct<layers, level>: direct evidence needs a layer that shows a distribution, the
    subject itself, and a sheet that can be placed; with any relevant layer it is indirect."""
    lit = lambda names: F.array(*[F.lit(n) for n in names])
    found = F.array_sort(F.array_intersect(layers, lit(relevant)))
    direct = (F.size(F.array_intersect(found, lit(distributional))) > 0) & F.coalesce(main_subject, F.lit(False)) & tier.isin(DIRECT, CONTROL)
    level = F.when(F.size(found) == 0, "none").when(direct, "direct").otherwise("indirect")
    return F.struct(F.array_join(found, " | ").alias("layers"), level.alias("level"))


def coverage_scope(regions: Column, national: Column, supranational: Column, band: Column, urban: Column, coastal: Column, series_sheet: Column) -> Column:
    """What a record covers: a town plan is local whatever else its title names, and a coast
    is a strip, not the territory."""
    n = F.size(regions)
    return decision_list(
        [
            (urban & (n <= 1), "locality"), (coastal & ~urban, "coastal_strip"), (series_sheet, "locality"), (national, "national"), (supranational, "supranational"),
            (n >= 2, "multi_region"), ((n == 1) & (band == "topographic"), "locality"), (n == 1, "single_region"),
        ],
        "undetermined",
    )


def completeness(scope: Column, partition: Column, share: Column, seen: Column, seen_note: Column) -> Column:
    """struct<complete, note, basis> of a record's coverage: what was seen on the image
    decides, then the scope, a text that names a part, and the share of the country that a
    stated box covers (from .95 on all of it, from .60 on a part); else it stays open."""
    per_cent = F.concat(F.format_string("%.0f", F.round(share * 100, 0)), F.lit("%"))
    part = F.lit("Catalogue text names a sheet of a set.")
    covers = F.concat(F.lit("Extent covers "), F.when(share >= 0.95, "").otherwise("only "), per_cent, F.lit(" of the country's bounding box."))
    cases = [
        (seen.isNotNull(), seen, F.coalesce(seen_note, F.lit("")), "image"),
        (scope != "national", F.lit("no"), F.lit(""), "title_and_gazetteer"),
        (partition, F.lit("partial"), part, "title_and_gazetteer"),
        (share >= 0.95, F.lit("yes"), covers, "bbox_geometry"),
        (share >= 0.60, F.lit("partial"), covers, "bbox_geometry"),
        (share.isNotNull(), F.lit("no"), covers, "bbox_geometry"),
    ]
    one = lambda c, n, b: F.struct(c.alias("complete"), n.alias("note"), F.lit(b).alias("basis"))
    out = one(F.lit("unverified"), F.lit("National in title; completeness not verified against the image."), "title_and_gazetteer")
    for test, complete, note, basis in reversed(cases):
        out = F.when(test, one(complete, note, basis)).otherwise(out)
    return out


def orientation(stated: Column, genre: Column, year: Column) -> Column:
    """struct<orientation, basis>: mostly a presumption from the year."""
    cases = [
        (stated, "stated_in_record", "orientation mentioned in catalogue text"),
        (genre == "view", "uncertain", "perspective view: oriented to the viewer, not to north"),
        (year >= 1700, "presumed_north", "European printed cartography after 1700 is north-up by convention"),
        (year < 1700, "uncertain", "pre-1700: portolans and siege views are frequently not north-up"),
    ]
    one = lambda v, b: F.struct(F.lit(v).alias("orientation"), F.lit(b).alias("basis"))
    out = one("uncertain", "undated")
    for test, value, basis in reversed(cases):
        out = F.when(F.coalesce(test, F.lit(False)), one(value, basis)).otherwise(out)
    return out


def settlement_focus(urban_text: Column, environs_text: Column, band: Column, genre: Column) -> Column:
    return decision_list(
        [
            (urban_text | ((genre == "plan") & (band == "topographic")), "urban_plan"), (environs_text, "town_and_hinterland"),
            (band.isin("topographic", "regional"), "rural_regional"), (band.isin("synoptic", "overview"), "small_scale_no_settlement_detail"),
        ],
        "undetermined",
    )


def evidence_status(forms: Column, seen_before: Column, strong_terms: Column, names: Column) -> Column:
    """struct<status, basis>: what an inspection saw (``forms``, null where there was none)
    goes before an earlier one, and both before what the catalogue's words suggest."""
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    one = lambda s, b: F.struct(s.alias("status"), F.lit(b).alias("basis"))
    inspected = one(F.when(F.size(forms) > 0, "observed").otherwise("none_seen"), "inspected")
    return (
        F.when(forms.isNotNull(), inspected)
        .when(F.coalesce(seen_before, F.lit(False)), one(F.lit("observed"), "inspected"))
        .when(some(strong_terms) | some(names), one(F.lit("catalogued"), "catalogue"))
        .otherwise(one(F.lit("unknown"), "none"))
    )
