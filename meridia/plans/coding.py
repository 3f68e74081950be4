"""Queries on the coding rules, over records made from the order table's columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridia.operators import coding
from meridia.plans.common import t

QUERIES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


#: A record's fields from an order's, written alike for both engines.
RECORD = {
    "year": "CASE WHEN o_orderkey % 17 <> 0 THEN 1500 + o_orderkey % 450 END",
    "genre": "CASE o_orderpriority WHEN '1-URGENT' THEN 'atlas' WHEN '2-HIGH' THEN 'view' WHEN '5-LOW' THEN 'plan' ELSE 'map' END",
    "authority": "CASE o_orderstatus WHEN 'F' THEN 'military' WHEN 'O' THEN 'hydrographic' ELSE 'private' END",
    "chart_title": "o_custkey % 5 = 0",
    "has_scale": "o_totalprice > 100000",
    "resolution": "CASE WHEN o_totalprice < 60000 THEN 'low' WHEN o_totalprice < 90000 THEN 'unknown' ELSE 'high' END",
    "partner": "o_custkey % 3 = 0",
    "has_box": "o_custkey % 2 = 0",
    "band": "CASE o_custkey % 5 WHEN 0 THEN 'topographic' WHEN 1 THEN 'regional' WHEN 2 THEN 'synoptic' WHEN 3 THEN 'overview' ELSE 'unknown' END",
    "share": "CASE WHEN o_custkey % 2 = 0 THEN (o_orderkey % 101) / 100.0 END",
    "k": "o_orderkey % 12",
}
_SQL = "SELECT o_orderkey, " + ", ".join(f"{e} AS {n}" for n, e in RECORD.items()) + " FROM orders"


def _records(spark, d):
    return t(spark, d, "orders").selectExpr("o_orderkey", *[f"{e} AS {n}" for n, e in RECORD.items()])


_GEOMETRY = """
WITH c AS (SELECT *, CASE WHEN genre = 'atlas' THEN 'atlas_volume' WHEN genre = 'view' THEN 'sketch_view'
  WHEN authority IN ('military', 'cadastre') AND year IS NOT NULL AND year >= 1830 THEN 'survey'
  WHEN year IS NOT NULL AND year >= 1600 AND (authority = 'hydrographic' OR chart_title) THEN 'chart'
  WHEN year IS NOT NULL AND year >= 1700 THEN 'early_modern' ELSE 'sketch' END AS geometric FROM (%s)),
p AS (SELECT *, CASE WHEN geometric IN ('atlas_volume', 'sketch_view') THEN '4_not_georeferenceable'
  WHEN partner AND NOT has_box THEN '3_warp_only'
  WHEN has_box AND has_scale AND geometric IN ('survey', 'chart') THEN '1_direct'
  WHEN geometric = 'survey' THEN CASE WHEN resolution IN ('low', 'unknown') OR NOT has_scale THEN '2_control_points' ELSE '1_direct' END
  WHEN geometric IN ('chart', 'early_modern') THEN '2_control_points' ELSE '3_warp_only' END AS tier FROM c)
""" % _SQL


@query(_GEOMETRY + """SELECT o_orderkey, geometric, tier, concat_ws('; ', CASE WHEN partner THEN 'no IIIF (partner-hosted)' END, CASE WHEN resolution IN ('low', 'unknown') THEN 'scan resolution low or unknown' END,
  CASE WHEN NOT has_scale THEN 'no stated scale' END, CASE geometric WHEN 'atlas_volume' THEN 'atlas volume: georeference individual plates, not the record' WHEN 'sketch_view' THEN 'perspective view, not a plan' END,
  CASE WHEN partner AND geometric NOT IN ('atlas_volume', 'sketch_view') THEN 'image not on IIIF; fetch from the holding library' END) AS blockers FROM p""")
def q_geometry_tier(spark, d):
    return _records(spark, d).select("o_orderkey", _tier().alias("g")).select("o_orderkey", "g.*")


def _tier():
    c = F.col
    return coding.geometry_tier(c("year"), c("genre"), c("authority"), c("chart_title"), c("has_scale"), c("resolution"), c("partner"), c("has_box"), ("military", "cadastre"))


@query(_GEOMETRY + """SELECT o_orderkey, array_to_string(list_sort(list_filter(l, lambda x: x IN ('tribes', 'water', 'estates'))), ' | ') AS layers,
CASE WHEN len(list_filter(l, lambda x: x IN ('tribes', 'water', 'estates'))) = 0 THEN 'none' WHEN len(list_filter(l, lambda x: x IN ('tribes', 'estates'))) > 0 AND chart_title AND tier IN ('1_direct', '2_control_points') THEN 'direct' ELSE 'indirect' END AS level
FROM (SELECT *, list_filter([CASE WHEN k % 2 = 0 THEN 'water' END, CASE WHEN k % 3 = 0 THEN 'tribes' END, CASE WHEN k % 5 = 0 THEN 'roads' END, CASE WHEN k = 7 THEN 'estates' END], lambda x: x IS NOT NULL) AS l FROM p)""")
def q_qualification(spark, d):
    c = F.col
    layers = F.array_compact(F.array(F.when(c("k") % 2 == 0, "water"), F.when(c("k") % 3 == 0, "tribes"), F.when(c("k") % 5 == 0, "roads"), F.when(c("k") == 7, "estates")))
    told = coding.qualification(layers, ("tribes", "water", "estates"), ("tribes", "estates"), c("chart_title"), _tier()["tier"])
    return _records(spark, d).select("o_orderkey", told.alias("q")).select("o_orderkey", "q.*")


_SCOPE = """SELECT *, CASE WHEN urban AND n <= 1 THEN 'locality' WHEN coastal AND NOT urban THEN 'coastal_strip' WHEN series THEN 'locality' WHEN national THEN 'national' WHEN supra THEN 'supranational'
  WHEN n >= 2 THEN 'multi_region' WHEN n = 1 AND band = 'topographic' THEN 'locality' WHEN n = 1 THEN 'single_region' ELSE 'undetermined' END AS scope
FROM (SELECT *, k %% 4 AS n, k IN (1, 6) AS urban, k = 9 AS coastal, k = 10 AS series, k IN (0, 3, 4, 8) AS national, k = 7 AS supra FROM (%s))""" % _SQL


@query(f"""SELECT o_orderkey, scope, CASE WHEN seen IS NOT NULL THEN seen WHEN scope <> 'national' THEN 'no' WHEN chart_title THEN 'partial' WHEN share >= 0.95 THEN 'yes' WHEN share >= 0.6 THEN 'partial' WHEN share IS NOT NULL THEN 'no' ELSE 'unverified' END AS complete,
CASE WHEN seen IS NOT NULL THEN 'as seen' WHEN scope <> 'national' THEN '' WHEN chart_title THEN 'Catalogue text names a sheet of a set.' WHEN share >= 0.95 THEN 'Extent covers ' || CAST(round(share * 100) AS INT) || '% of the country''s bounding box.'
  WHEN share IS NOT NULL THEN 'Extent covers only ' || CAST(round(share * 100) AS INT) || '% of the country''s bounding box.' ELSE 'National in title; completeness not verified against the image.' END AS note,
CASE WHEN seen IS NOT NULL THEN 'image' WHEN scope = 'national' AND NOT chart_title AND share IS NOT NULL THEN 'bbox_geometry' ELSE 'title_and_gazetteer' END AS basis
FROM (SELECT *, CASE WHEN genre = 'view' THEN 'yes' END AS seen FROM ({_SCOPE}))""")
def q_coverage(spark, d):
    c, k = F.col, F.col("k")
    regions = F.slice(F.array(*[F.lit(x) for x in "abc"]), F.lit(1), (k % 4).cast("int"))
    scope = coding.coverage_scope(regions, k.isin(0, 3, 4, 8), k == 7, c("band"), k.isin(1, 6), k == 9, k == 10)
    seen = F.when(c("genre") == "view", "yes")
    told = coding.completeness(c("scope"), c("chart_title"), c("share").cast("double"), seen, F.lit("as seen"))
    return _records(spark, d).withColumn("scope", scope).select("o_orderkey", "scope", told.alias("q")).select("o_orderkey", "scope", "q.*")


@query(f"""SELECT o_orderkey, CASE WHEN k = 5 THEN 'stated_in_record' WHEN genre <> 'view' AND year >= 1700 THEN 'presumed_north' ELSE 'uncertain' END AS orientation,
CASE WHEN k = 5 THEN 'orientation mentioned in catalogue text' WHEN genre = 'view' THEN 'perspective view: oriented to the viewer, not to north' WHEN year >= 1700 THEN 'European printed cartography after 1700 is north-up by convention'
  WHEN year < 1700 THEN 'pre-1700: portolans and siege views are frequently not north-up' ELSE 'undated' END AS basis,
CASE WHEN k = 3 OR genre = 'plan' AND band = 'topographic' THEN 'urban_plan' WHEN k = 4 THEN 'town_and_hinterland' WHEN band IN ('topographic', 'regional') THEN 'rural_regional' WHEN band IN ('synoptic', 'overview') THEN 'small_scale_no_settlement_detail' ELSE 'undetermined' END AS focus
FROM ({_SQL})""")
def q_orientation_focus(spark, d):
    c, k = F.col, F.col("k")
    focus = coding.settlement_focus(k == 3, k == 4, c("band"), c("genre"))
    return _records(spark, d).select("o_orderkey", coding.orientation(k == 5, c("genre"), c("year")).alias("o"), focus.alias("focus")).select("o_orderkey", "o.*", "focus")


@query(f"""SELECT o_orderkey, CASE WHEN k IN (0, 1) THEN 'observed' WHEN k = 2 THEN 'none_seen' WHEN k = 3 THEN 'observed' WHEN k IN (4, 5, 6) THEN 'catalogued' ELSE 'unknown' END AS status,
CASE WHEN k <= 3 THEN 'inspected' WHEN k <= 6 THEN 'catalogue' ELSE 'none' END AS basis FROM ({_SQL})""")
def q_evidence_status(spark, d):
    k, word = F.col("k"), lambda x: F.array(F.lit(x))
    none = F.array().cast("array<string>")
    forms = F.when(k <= 1, word("label")).when(k == 2, none)
    told = coding.evidence_status(forms, k == 3, F.when(k == 4, word("a")).otherwise(none), F.when(k.isin(5, 6), word("b")))
    return _records(spark, d).select("o_orderkey", told.alias("q")).select("o_orderkey", "q.*")
