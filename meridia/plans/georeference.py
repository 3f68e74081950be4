"""Queries on grids, anchors, shifts, zones, frames and margins; their sheets are made
from the keys of parts and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridia.functions import geo
from meridia.operators import georeference as gr
from meridia.plans.common import t

QUERIES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _parts(spark, d):
    return t(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_name", "p_type")


_AXES = "SELECT p_partkey AS k, 5 + p_partkey % 9 AS el, 5 + p_partkey % 7 AS nl, CASE WHEN p_partkey % 11 = 0 THEN CAST('nan' AS DOUBLE) ELSE p_partkey % 5 END AS eg, CAST(p_partkey % 6 AS DOUBLE) AS ng, 150 + (p_partkey % 13) * 0.3370071 AS ep, 150 + (p_partkey % 17) * 0.7370071 AS np, (p_partkey % 10) * 0.1370071 AS ea, (p_partkey % 4) * 0.2170071 AS na FROM part"


@query(f"""WITH a AS ({_AXES}), c AS (SELECT *, el >= 8 AND NOT isnan(eg) AND eg <= 3 AS ec, nl >= 8 AND ng <= 3 AS nc FROM a),
p AS (SELECT *, CASE WHEN ec AND nc THEN (ep + np) / 2 WHEN ec AND abs(np - ep) / ep <= 0.05 THEN ep WHEN nc AND abs(ep - np) / np <= 0.05 THEN np END AS px FROM c)
SELECT k, px IS NOT NULL AS has_grid, CASE WHEN ec AND nc THEN 'both_axes' WHEN px IS NOT NULL THEN 'one_axis_confirmed_by_spacing' ELSE 'not_detected' END AS basis,
round_even(px, 1) AS px_per_km, CAST(round_even(px / (20 / 25.4), 0) AS BIGINT) AS scan_dpi, round_even(1000 / px, 2) AS metres_per_px, round_even((ea - na) / 2, 2) AS rotation FROM p""")
def q_grid_verdict(spark, d):
    k = F.col("k")
    e = F.struct((5 + k % 9).alias("lines"), F.when(k % 11 == 0, float("nan")).otherwise((k % 5).cast("double")).alias("gap_iqr"), (150 + (k % 13) * 0.3370071).alias("px_per_km"), ((k % 10) * 0.1370071).alias("angle"))
    n = F.struct((5 + k % 7).alias("lines"), (k % 6).cast("double").alias("gap_iqr"), (150 + (k % 17) * 0.7370071).alias("px_per_km"), ((k % 4) * 0.2170071).alias("angle"))
    return _parts(spark, d).select("k", gr.grid_verdict(e, n).alias("g")).select("k", "g.*")


#: Two vocabularies of part names, and the patterns of a legend and of a margin.
MARKERS = {"tools": ("anvill", "rodsmall"), "sizes": ("largewidget", "oldwidget", "promo")}
LEGEND, MARGIN = "ECONOMY|cold", "new|SMALL"


def _near(m: str) -> str:
    cap = max(1, min(2, len(m) // 5))
    return f"(contains(s, '{m}') OR (length(s) > 0 AND len(list_filter(range(1, greatest(1, length(s) - {len(m)} + {cap} + 1) + 1), lambda i: {' OR '.join(f'levenshtein(substr(s, i, {w}), {chr(39)}{m}{chr(39)}) <= {cap}' for w in range(len(m) - cap, len(m) + cap + 1))})) > 0))::INT"


@query(f"""WITH s AS (SELECT p_partkey AS k, p_name || ' ' || p_type AS raw, regexp_replace(strip_accents(lower(p_name || ' ' || p_type)), '[^a-z]', '', 'g') AS s FROM part),
h AS (SELECT k, {' + '.join(map(_near, MARKERS['tools']))} AS a, {' + '.join(map(_near, MARKERS['sizes']))} AS b, regexp_matches(raw, '{LEGEND}') AS has_legend, regexp_matches(raw, '{MARGIN}') AS m FROM s)
SELECT k, CASE WHEN NOT has_legend AND a + b = 0 THEN CASE WHEN m THEN 'no_symbol_legend' ELSE 'unread' END WHEN a + b = 0 THEN 'legend_present_edition_unread' WHEN a = b THEN 'ambiguous' WHEN a > b THEN 'tools' ELSE 'sizes' END AS variant,
CASE WHEN NOT has_legend AND a + b = 0 AND m THEN 'band_read' WHEN a + b = 0 THEN 'none' WHEN a = b THEN 'tied' WHEN greatest(a, b) >= 2 THEN 'strong' ELSE 'weak' END AS confidence, has_legend, greatest(a, b) AS hits FROM h""")
def q_edition(spark, d):
    raw = F.concat_ws(" ", "p_name", "p_type")
    return _parts(spark, d).select("k", gr.edition(raw, MARKERS, LEGEND, MARGIN).alias("e")).select("k", "e.*")


_ANCHOR = "SELECT p_partkey AS k, p_partkey % 13 = 0 AS refused, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 4 END AS support, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 6 END AS votes, p_partkey % 7 AS matched, CASE WHEN p_partkey % 8 <> 0 THEN (p_partkey % 9) * 150.0 END AS cat, CASE WHEN p_partkey % 10 < 3 THEN (p_partkey % 21) * 11.0 END AS near FROM part"


@query(f"""SELECT k, basis, basis <> '' AS confident, class FROM (SELECT k, CASE WHEN refused THEN '' WHEN support >= 2 THEN 'printed_corners' WHEN votes >= 3 AND votes / greatest(matched, 1) >= 0.7 AND cat < 1000 THEN 'label_vote' WHEN near IS NOT NULL THEN 'neighbour_corner' ELSE '' END AS basis,
CASE WHEN near <= 100 THEN 'corner_fit' WHEN near > 100 THEN 'corner_fit_coarse' END AS class FROM ({_ANCHOR}))""")
def q_anchor_basis(spark, d):
    k = F.col("k")
    near = F.when(k % 10 < 3, (k % 21) * 11.0)
    basis = gr.anchor_basis(k % 13 == 0, F.when(k % 3 == 0, k % 4), F.when(k % 5 != 0, k % 6), k % 7, F.when(k % 8 != 0, (k % 9) * 150.0), near)
    return _parts(spark, d).select("k", basis.alias("basis"), gr.precision_class(near).alias("class")).withColumn("confident", gr.anchor_confident(F.col("basis")))


_SHIFT = "SELECT p_partkey AS k, CASE WHEN p_partkey % 7 <> 0 THEN p_partkey % 5 - 2 END AS we, p_partkey % 4 - 1 AS wn, p_partkey % 6 AS se, CASE WHEN p_partkey % 9 <> 0 THEN p_partkey % 5 END AS sn, p_partkey % 3 = 0 AS prov, p_partkey % 2 AS ae FROM part"


@query(f"""WITH s AS ({_SHIFT}), w AS (SELECT *, CASE WHEN prov THEN 2 ELSE 3 END AS fl, coalesce(we, 0) AS xe, coalesce(sn, 0) AS yn FROM s), v AS (SELECT *, xe <> 0 AND se < fl AS be, wn <> 0 AND yn < fl AS bn FROM w),
z AS (SELECT *, CASE WHEN be THEN 0 ELSE xe END - ae AS de, CASE WHEN bn THEN 0 ELSE wn END AS dn FROM v), o AS (SELECT *, (de <> 0 OR dn <> 0) AND abs(de) + abs(dn) > 3 AS gone FROM z)
SELECT k, CASE WHEN gone THEN 0 ELSE de END AS de, CASE WHEN gone THEN 0 ELSE dn END AS dn, ae + CASE WHEN gone THEN 0 ELSE de END AS ae, CASE WHEN gone THEN 0 ELSE dn END AS an,
CASE WHEN (be AND se >= 2) OR (gone AND de <> 0) THEN 'e' ELSE '' END || CASE WHEN (bn AND yn >= 2) OR (gone AND dn <> 0) THEN 'n' ELSE '' END AS refused, TRUE AS idle FROM o""")
def q_anchor_shift(spark, d):
    """The shift, and whether a second run of the same reading would move nothing."""
    c, k = F.col, F.col("k")
    inside = lambda e, n: F.abs(e) + F.abs(n) <= 3
    reading = F.struct(F.when(k % 7 != 0, k % 5 - 2).alias("e"), (k % 4 - 1).alias("n"))
    support = F.struct((k % 6).alias("e"), F.when(k % 9 != 0, k % 5).alias("n"))
    none = F.struct(F.lit(None).cast("long").alias("e"), F.lit(None).cast("long").alias("n"))
    first = _parts(spark, d).select("k", reading.alias("r"), support.alias("s"), F.struct((k % 2).alias("e"), F.lit(0).cast("long").alias("n")).alias("a"), F.when(k < 0, none).alias("d"))
    once = first.withColumn("x", gr.kilometre_shift(c("r"), c("s"), k % 3 == 0, c("a"), c("d"), inside))
    # no longer provisional; what was decided stays decided
    twice = once.withColumn("y", gr.kilometre_shift(c("r"), c("s"), F.lit(False), c("x.applied"), c("x.from_reading"), inside))
    undecided = c("x.from_reading").isNull()
    return twice.select("k", c("x.delta.e").alias("de"), c("x.delta.n").alias("dn"), c("x.applied.e").alias("ae"), c("x.applied.n").alias("an"), F.array_join("x.refused", "").alias("refused"), (undecided | ((c("y.delta.e") == 0) & (c("y.delta.n") == 0))).alias("idle"))


@query("SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN 'north' ELSE 'south' END AS zone, s_suppkey % 3 <> s_suppkey % 2 AS switched FROM supplier")
def q_zone_choice(spark, d):
    """Corners projected in a zone of their latitude, and stated in a zone at times wrong;
    every one must come back to the zone it was projected in."""
    c, k = F.col, F.col("s_suppkey")
    lat = F.when(k % 2 == 0, 35.5 + (k % 10) / 10).otherwise(33.0 + (k % 10) / 10)
    p = t(spark, d, "supplier").select(k.alias("k"), (8.5 + (k % 23) / 10).alias("lon"), lat.alias("lat"))
    at = F.when(c("k") % 2 == 0, geo.project(c("lon"), c("lat"), geo.NORTH)).otherwise(geo.project(c("lon"), c("lat"), geo.SOUTH))
    # even keys are north's: stated right where the key's remainder by three is its parity
    right = F.when(c("k") % 2 == 0, "north").otherwise("south")
    wrong = F.when(c("k") % 2 == 0, "south").otherwise("north")
    p = p.withColumn("xy", at).withColumn("now", F.when(c("k") % 3 == c("k") % 2, right).otherwise(wrong))
    chosen = gr.zone_choice(c("xy.x"), c("xy.y"), c("lat"), c("now"), {"north": geo.NORTH, "south": geo.SOUTH})
    return p.withColumn("z", chosen).select("k", "z.zone", "z.switched")


_LINES = "SELECT p_partkey AS k, 100.25 + p_partkey % 50 AS e0, 3100.25 + p_partkey % 70 AS e1, 90.25 + p_partkey % 30 AS n0, 2090.25 + p_partkey % 40 AS n1, (p_partkey % 9 - 4) * 0.001 AS te, (p_partkey % 7 - 3) * 0.001 AS tn FROM part"


@query(f"""WITH l AS ({_LINES}), x AS (SELECT k, unnest([(e0 + te * n0) / (1 - te * tn), (e0 + te * n1) / (1 - te * tn), (e1 + te * n0) / (1 - te * tn), (e1 + te * n1) / (1 - te * tn)]) AS x, unnest([(n0 + tn * e0) / (1 - te * tn), (n0 + tn * e1) / (1 - te * tn), (n1 + tn * e0) / (1 - te * tn), (n1 + tn * e1) / (1 - te * tn)]) AS y FROM l),
f AS (SELECT k, CAST(trunc(min(x)) AS INT) AS "left", CAST(trunc(max(x)) AS INT) AS "right", CAST(trunc(min(y)) AS INT) AS top, CAST(trunc(max(y)) AS INT) AS bottom FROM x GROUP BY k)
SELECT CASE WHEN k % 19 = 0 THEN NULL ELSE "left" END AS "left", CASE WHEN k % 19 = 0 THEN NULL ELSE "right" END AS "right", CASE WHEN k % 19 = 0 THEN NULL ELSE top END AS top, CASE WHEN k % 19 = 0 THEN NULL ELSE bottom END AS bottom, k, CASE WHEN k % 19 = 0 THEN NULL ELSE round(greatest(abs(("right" - "left") / 150.0 - 20) / 20, abs((bottom - top) / 150.0 - 13) / 13) * 100, 6) END AS size_error FROM f""")
def q_frame_of_lines(spark, d):
    k = F.col("k")
    e = F.when(k % 19 == 0, F.array(F.lit(100.25))).otherwise(F.array(1500.25 + k % 3, 100.25 + k % 50, 3100.25 + k % 70))
    n = F.array(2090.25 + k % 40, 90.25 + k % 30)
    f = _parts(spark, d).withColumn("f", gr.frame_of_lines(e, n, (k % 9 - 4) * 0.001, (k % 7 - 3) * 0.001))
    return f.select("k", "f.*", F.round(gr.frame_error(F.col("f"), F.lit(150.0), F.lit(20.0), F.lit(13.0)), 6).alias("size_error"))


@query("SELECT p_partkey AS k, round(sqrt(pow(1000 + p_partkey % 17, 2) + pow(p_partkey % 5, 2)), 6) AS px_lon, round(sqrt(pow(p_partkey % 3, 2) + pow(1200 + p_partkey % 11, 2)), 6) AS px_lat, round((1.0 / (1200 + p_partkey % 11)) / (1.0 / (1000 + p_partkey % 17)) / cos(radians(33 + p_partkey % 4)), 6) AS ratio FROM part")
def q_pixel_scale(spark, d):
    k = F.col("k")
    lon, lat = gr.px_per_degree([1000.0 + k % 17, (k % 3).cast("double"), F.lit(0.0), (k % 5).cast("double"), -(1200.0 + k % 11), F.lit(0.0)])
    ratio = gr.projection_ratio([F.lit(1.0) / (1000 + k % 17), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(-1.0) / (1200 + k % 11), F.lit(0.0)], 33 + k % 4)
    return _parts(spark, d).select("k", F.round(lon, 6).alias("px_lon"), F.round(lat, 6).alias("px_lat"), F.round(ratio, 6).alias("ratio"))


_CREDIT = "CASE p_partkey % 4 WHEN 0 THEN 'Carte dressée d''après les travaux de 1898 et 1936, travaux sur le terrain' WHEN 1 THEN 'Travaux exécutés sur le terrain en 1922' WHEN 2 THEN 'illisible 1854' END"
_FOOT = "concat('Équidistance des courbes 1', p_partkey % 10, ' m. Tirage de ', CASE WHEN p_partkey % 2 = 0 THEN 'mars ' ELSE ' ' END, 1930 + p_partkey % 20, ' prix : ', p_partkey % 90, ' fr révisée en ', 1940 + p_partkey % 9, CASE p_partkey % 3 WHEN 0 THEN ' publié par le Service géographique de l''Armée en ' ELSE ' Institut Géographique National ' END, 1820 + p_partkey % 150)"
_DECL = "concat('au 1er janvier ', 1840 + p_partkey % 130)"


@query("""SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN '1898,1936' WHEN 1 THEN '1922' WHEN 2 THEN '' END AS survey_years, CASE p_partkey % 4 WHEN 0 THEN 'compiled' WHEN 1 THEN 'officers' END AS credit_form,
CAST(10 + p_partkey % 10 AS INT) AS contour_interval_m, CAST(1930 + p_partkey % 20 AS INT) AS print_run_year, CASE WHEN p_partkey % 2 = 0 THEN 'mars' END AS print_run_month, CAST(p_partkey % 90 AS INT) AS price_francs, CAST(1940 + p_partkey % 9 AS INT) AS revised,
CASE WHEN p_partkey % 3 = 0 THEN 'SGA' ELSE 'IGN' END AS publisher, CASE WHEN 1820 + p_partkey % 150 BETWEEN 1850 AND 1955 THEN CAST(1820 + p_partkey % 150 AS INT) END AS imprint_year, CASE WHEN 1840 + p_partkey % 130 BETWEEN 1850 AND 1959 THEN CAST(1840 + p_partkey % 130 AS INT) END AS declination_epoch FROM part""")
def q_margin_fields(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").alias("k"), *[F.expr(x.replace("''", "\\'")).alias(n) for x, n in ((_CREDIT, "c"), (_FOOT, "f"), (_DECL, "d"))])
    fields = p.select("k", gr.margin_fields(F.col("c"), F.col("f"), F.col("d")).alias("m")).select("k", "m.*")
    return fields.withColumn("survey_years", F.array_join("survey_years", ","))
