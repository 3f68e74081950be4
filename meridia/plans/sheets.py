"""Queries on sheets: envelopes, clips, footprints, crossing lines, linked fragments, gaps,
both ends of a ranking, and the lines that sinks write."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridia.functions import geo
from meridia.operators import aggregates as agg
from meridia.operators import joins
from meridia.operators import sequences as seq
from meridia.operators.shared import spread
from meridia.plans.common import t
from meridia.plans.spatial import _BOX, _CUST, _CUST_ONE, _boxes, _cust, _cust_one
from meridia.sources import records, tables

QUERIES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


@query("SELECT user_id, count(gap) AS n_gaps, median(gap) AS median_gap, quantile_cont(gap, 0.75) - quantile_cont(gap, 0.25) AS iqr FROM (SELECT user_id, CAST(event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS DOUBLE) AS gap FROM events) WHERE gap IS NOT NULL GROUP BY user_id")
def q_gap_stats(spark, d):
    return seq.gap_stats(t(spark, d, "events").select("user_id", "event_id"), ["user_id"], "event_id")


@query(f"SELECT id % 10 AS unit, min(w) - 0.5 AS west, min(s) - 0.5 AS south, max(e) + 0.5 AS east, max(n) + 0.5 AS north, count(*) AS n FROM ({_BOX(_CUST, 5)}) GROUP BY 1")
def q_envelope(spark, d):
    c = F.col
    boxes = _boxes(_cust(spark, d), 5).select((c("id") % 10).alias("unit"), c("w").alias("west"), c("s").alias("south"), c("e").alias("east"), c("n").alias("north"))
    return agg.envelope(boxes, ["unit"], 0.5)


@query("""SELECT count(*) AS rows, count(*) FILTER (WHERE n_chars > 1000) AS long_texts, count(*) FILTER (WHERE source IS NULL) AS unsourced, min(n_chars) AS least_chars, max(n_chars) AS greatest_chars,
(SELECT string_agg(lang || ':' || n, ',' ORDER BY n DESC, lang) FROM (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang)) AS by_lang, (SELECT string_agg(source || ':' || n, ',' ORDER BY n DESC, source) FROM (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source)) AS by_source FROM documents""")
def q_summary(spark, d):
    told = agg.summary(t(spark, d, "documents"), {"long_texts": F.col("n_chars") > 1000, "unsourced": F.col("source").isNull()}, {"chars": F.col("n_chars")}, ["lang", "source"])
    flat = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")
    return told.withColumns({c: flat(c) for c in ("by_lang", "by_source")})


@query("""WITH r AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS up, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey DESC) AS down FROM customer)
SELECT c_nationkey, c_custkey, CAST(up AS INTEGER) AS place, 'first' AS side FROM r WHERE up <= 3 UNION ALL SELECT c_nationkey, c_custkey, CAST(down AS INTEGER), 'last' FROM r WHERE down <= 3 AND up > 3""")
def q_first_last(spark, d):
    rows = t(spark, d, "customer").select("c_nationkey", "c_custkey", (-F.col("c_acctbal")).alias("o"))
    return joins.first_and_last(rows, ["c_nationkey"], [F.col("o"), F.col("c_custkey")], 3).select("c_nationkey", "c_custkey", "place", "side")


_LINES = "SELECT s_nationkey AS sheet, CASE WHEN s_suppkey % 2 = 0 THEN 'e' ELSE 'n' END AS axis, s_suppkey AS number, s_suppkey * 53 % 1000 / 10.0::DOUBLE AS constant, (s_nationkey % 7) / 100.0::DOUBLE AS tan FROM supplier"


@query(f"WITH l AS ({_LINES}) SELECT e.sheet, e.number AS i, n.number AS j, round((e.constant + e.tan * n.constant) / (1 - e.tan * n.tan), 9) AS x, round((n.constant + n.tan * e.constant) / (1 - e.tan * n.tan), 9) AS y FROM l e JOIN l n ON e.sheet = n.sheet AND e.axis = 'e' AND n.axis = 'n'")
def q_intersections(spark, d):
    k = F.col("s_suppkey")
    lines = t(spark, d, "supplier").select(F.col("s_nationkey").alias("sheet"), F.when(k % 2 == 0, "e").otherwise("n").alias("axis"), k.alias("number"), (k * 53 % 1000 / F.lit(10.0)).alias("constant"), (F.col("s_nationkey") % 7 / F.lit(100.0)).alias("tan"))
    return joins.line_intersections(lines, "sheet").select("sheet", "i", "j", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


_FRAGMENTS = f"SELECT id, x AS x0, y AS y0, x + cos(id % 3 * 0.1::DOUBLE) AS x1, y + sin(id % 3 * 0.1::DOUBLE) AS y1, cos(id % 3 * 0.1::DOUBLE) AS ax, sin(id % 3 * 0.1::DOUBLE) AS ay FROM ({_CUST})"


def _fragments(spark, d):
    c, angle = F.col, F.col("id") % 3 * F.lit(0.1)
    ax, ay = F.cos(angle), F.sin(angle)
    return _cust(spark, d).select("id", c("x").alias("x0"), c("y").alias("y0"), (c("x") + ax).alias("x1"), (c("y") + ay).alias("y1"), ax.alias("ax"), ay.alias("ay"))


@query(f"""WITH f AS ({_FRAGMENTS}), e AS (SELECT id, 0 AS k, x0 AS x, y0 AS y, -ax AS ox, -ay AS oy, ax, ay FROM f UNION ALL SELECT id, 1, x1, y1, ax, ay, ax, ay FROM f),
h AS (SELECT p.id AS a, q.id AS b, p.k AS ak, q.k AS bk, (q.x - p.x) * p.ox + (q.y - p.y) * p.oy AS forward, abs((q.y - p.y) * p.ox - (q.x - p.x) * p.oy) AS side FROM e p JOIN e q ON p.id <> q.id AND sqrt(pow(q.x - p.x, 2) + pow(q.y - p.y, 2)) <= 4 AND abs(p.ax * q.ax + p.ay * q.ay) >= cos(radians(20)))
SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b, CASE WHEN a < b THEN ak ELSE bk END AS a_end, CASE WHEN a < b THEN bk ELSE ak END AS b_end FROM h WHERE forward > 0 AND forward <= 4 AND side <= 1.5""")
def q_corridor_links(spark, d):
    return joins.corridor_links(_fragments(spark, d), 4.0, 1.5, 20.0)


@query(None)
def q_linked_runs(spark, d):
    # no SQL: each pass builds on the shapes of the last; a unit test links dashes by hand
    far = _fragments(spark, d).withColumns({c: F.col(c) * 20 for c in ("x0", "y0", "x1", "y1")})
    return joins.linked_runs(far).select("id", "members")


_GLYPHS = f"SELECT id % 3 AS sheet, id, x AS x0, y AS y0, x + 1 + id % 2 AS x1, y + 1 + id % 4 AS y1 FROM ({_CUST})"


@query(f"WITH g AS ({_GLYPHS}) SELECT sheet, id FROM g a WHERE NOT EXISTS (SELECT 1 FROM g b WHERE b.sheet = a.sheet AND b.id <> a.id AND greatest(b.x0 - a.x1, a.x0 - b.x1) <= 2 AND abs(b.y1 - a.y1) <= 0.25 AND abs((b.y1 - b.y0) - (a.y1 - a.y0)) <= 0.3 * (a.y1 - a.y0))")
def q_line_neighbours(spark, d):
    c, k = F.col, F.col("id")
    boxes = _cust(spark, d).select((k % 3).alias("sheet"), "id", c("x").alias("x0"), c("y").alias("y0"), (c("x") + 1 + k % 2).alias("x1"), (c("y") + 1 + k % 4).alias("y1"))
    return joins.without_line_neighbours(boxes, "sheet", 2.0, 0.25, 0.3).select("sheet", "id")


@query(f"""SELECT id, round(west, 9) AS west, round(south, 9) AS south, round(east, 9) AS east, round(north, 9) AS north, x BETWEEN west + 0.2 AND east - 0.2 AND y BETWEEN south + 0.2 AND north - 0.2 AS inside FROM
(SELECT id, w AS x, s AS y, CASE WHEN id % 3 = 0 THEN w ELSE w + 0.5 - (e - w) / 2 END AS west, CASE WHEN id % 3 = 0 THEN e ELSE w + 0.5 + (e - w) / 2 END AS east, CASE WHEN id % 3 = 0 THEN s ELSE s + 0.25 - (n - s) / 2 END AS south, CASE WHEN id % 3 = 0 THEN n ELSE s + 0.25 + (n - s) / 2 END AS north FROM ({_BOX(_CUST, 5)}))""")
def q_clip_box(spark, d):
    c = F.col
    box = F.struct(c("w").alias("west"), c("s").alias("south"), c("e").alias("east"), c("n").alias("north"))
    corners = F.when(c("id") % 3 != 0, F.slice(geo.box_ring(c("w"), c("s"), c("w") + 1, c("s") + 0.5), 1, 4))
    b = _boxes(_cust(spark, d), 5).select("id", "w", "s", geo.clip_box(box, corners).alias("b"))
    return b.select("id", *[F.round(c(f"b.{k}"), 9).alias(k) for k in ("west", "south", "east", "north")], geo.in_clip(c("w"), c("s"), c("b"), 0.2).alias("inside"))


@query(f"""SELECT id, round(least(a, b), 6) AS area FROM (SELECT id, (e - w) * (n - s) * pow(1 - 0.25 / (sqrt(pow(e - w, 2) + pow(n - s, 2)) / 2), 2) AS a, (e - w + 0.5) * (n - s - 0.3) * pow(1 - 0.25 / (sqrt(pow(e - w + 0.5, 2) + pow(n - s - 0.3, 2)) / 2), 2) AS b FROM ({_BOX(_CUST, 5)}))""")
def q_shared_footprint(spark, d):
    c = F.col
    ring = lambda e, n: F.slice(geo.box_ring(c("w"), c("s"), e, n), 1, 4)
    shared = geo.shared_footprint(ring(c("e"), c("n")), ring(c("e") + 0.5, c("n") - 0.3), 0.25)
    return _boxes(spread(_cust(spark, d), "id"), 5).select("id", F.round(geo.shoelace(shared), 6).alias("area"))


@query(f"SELECT id, x, y FROM ({_CUST}) WHERE id % 4 = 0 UNION ALL SELECT id, x + side * (id % 4) / 2.0::DOUBLE, y FROM ({_CUST}), (VALUES (-1), (1)) v(side) WHERE id % 4 <> 0")
def q_evidence_points(spark, d):
    at = geo.point(F.col("x"), F.col("y"))
    extent = F.when(F.col("id") % 4 != 0, (F.col("id") % 4).cast("double"))
    return _cust(spark, d).select("id", F.explode(geo.evidence_points(at, extent)).alias("p")).select("id", "p.x", "p.y")


_COEFFICIENTS = "(4 + id % 3 / 10.0::DOUBLE) AS a, 0.1::DOUBLE AS b, 0.2 * (id % 5)::DOUBLE AS d, (-4.0 - id % 2)::DOUBLE AS e"


@query(f"""SELECT id, round(sqrt(pow(a * 1000, 2) + pow(d * 1000, 2)) / 1000, 9) AS width_km, round(sqrt(pow(b * 800, 2) + pow(e * 800, 2)) / 1000, 9) AS height_km, round(sqrt(a * a + d * d), 9) AS scale_x, round(sqrt(b * b + e * e), 9) AS scale_y, round(degrees(atan2(-d, a)), 9) AS rotation_deg,
round(a * x + b * y + 7, 9) AS east, round(d * x + e * y - 3, 9) AS north, round(x, 6) AS back_x, round(y, 6) AS back_y, round(x * 0.9 + 2.33722917, 9) AS longitude FROM (SELECT id, x, y, {_COEFFICIENTS} FROM ({_CUST}))""")
def q_corner_spans(spark, d):
    k, c = F.col("id"), F.col
    a, b, dd, e = 4 + k % 3 / F.lit(10.0), F.lit(0.1), 0.2 * (k % 5), F.lit(-4.0) - k % 2
    m = (a, b, F.lit(7.0), dd, e, F.lit(-3.0))
    corner = lambda x, y: geo.point(*geo.apply_affine(m, F.lit(x), F.lit(y)))
    spans = geo.corner_spans(corner(0.0, 0.0), corner(1000.0, 0.0), corner(0.0, 800.0), (a, b), (dd, e))
    east, north = geo.apply_affine(m, c("x"), c("y"))
    back = geo.invert_affine(m, east, north)
    out = _cust(spark, d).select("id", spans.alias("s"), east.alias("east"), north.alias("north"), back[0].alias("back_x"), back[1].alias("back_y"), geo.from_grades(c("x")).alias("longitude"))
    rounded = [F.round(f"s.{n}", 9).alias(n) for n in ("width_km", "height_km", "scale_x", "scale_y", "rotation_deg")]
    return out.select("id", *rounded, *[F.round(n, 9).alias(n) for n in ("east", "north")], *[F.round(n, 6).alias(n) for n in ("back_x", "back_y")], F.round("longitude", 9).alias("longitude"))


_FEATURE = """'{"type":"Feature","geometry":{"type":"Point","coordinates":[' || x || ',' || y || ']},"properties":{"unit":"' || id % 5 || '"' || CASE WHEN id % 2 = 0 THEN ',"name":"n' || id || '"' ELSE '' END || '}}'"""


@query(f"""SELECT 0 AS part, NULL::BIGINT AS id, '{{"type":"FeatureCollection","name":"points","crs":{{"type":"name","properties":{{"name":"urn:ogc:def:crs:OGC:1.3:CRS84"}}}},"features":[' AS line UNION ALL SELECT 2, NULL, ']}}'
UNION ALL SELECT 1, id, CASE WHEN id = (SELECT min(c_custkey) FROM customer) THEN '' ELSE ',' END || {_FEATURE} FROM ({_CUST})""")
def q_feature_lines(spark, d):
    k = F.col("id")
    points = _cust(spark, d).withColumns({"unit": k % 5, "name": F.when(k % 2 == 0, F.concat(F.lit("n"), k)).otherwise(""), "_hidden": F.lit("x")})
    lines = tables.geojson_collection(tables.geojson_features(points, tables.point_geometry("x", "y"), ["unit", "name", "_hidden"]), "points", ["id"])
    return lines.select(F.col("_part").alias("part"), "id", F.col("value").alias("line"))


@query(f"""SELECT id, printf('%.10f\n%.10f\n%.10f\n%.10f\n%.10f\n%.10f', 4.25::DOUBLE, 0.5::DOUBLE, 0.25::DOUBLE, -4.5::DOUBLE, x + 2.25, y - 2.0) AS world, 'mapX,mapY,pixelX,pixelY,enable,dX,dY,residual' || chr(10) || x || ',' || y || ',10,-20,1,0,0,0' || chr(10) || x + 1 || ',' || y || ',110,-20,1,0,0,0' || chr(10)
|| x + 1 || ',' || y - 1 || ',110,-220,1,0,0,0' || chr(10) || x || ',' || y - 1 || ',10,-220,1,0,0,0' AS points FROM (SELECT c_custkey AS id, CAST(c_custkey % 100 AS DOUBLE) AS x, CAST(c_custkey % 50 AS DOUBLE) AS y FROM customer)""")
def q_sidecars(spark, d):
    c, k = F.col, F.col("c_custkey")
    rows = t(spark, d, "customer").select(k.alias("id"), (k % 100).cast("double").alias("x"), (k % 50).cast("double").alias("y"))
    rows = rows.withColumn("affine", F.array(F.lit(4.25), F.lit(0.5), F.lit(0.25), F.lit(-4.5), c("x"), c("y")))
    frame = F.struct(F.lit(10).alias("left"), F.lit(20).alias("top"), F.lit(110).alias("right"), F.lit(220).alias("bottom"))
    p = lambda x, y: geo.point(c("x") + x, c("y") + y)
    corners = {"north_west": p(0, 0), "north_east": p(1, 0), "south_east": p(1, -1), "south_west": p(0, -1)}
    return rows.select("id", tables.world_file("affine").alias("world"), tables.control_points(frame, corners).alias("points"))


@query(r"""SELECT p_brand, 3 AS part, p_partkey, '| ' || replace(p_name, '|', '\|') || ' | ' || p_size || ' |' AS line FROM part UNION ALL SELECT p_brand, 0, NULL, '## ' || p_brand || ' (' || count(*) || ')' FROM part GROUP BY p_brand
UNION ALL SELECT DISTINCT p_brand, 1, NULL::BIGINT, '| p_name | p_size |' FROM part UNION ALL SELECT DISTINCT p_brand, 2, NULL::BIGINT, '| --- | --- |' FROM part""")
def q_report_sections(spark, d):
    lines = tables.markdown_report(t(spark, d, "part"), "p_brand", ["p_name", "p_size"], ["p_partkey"])
    return lines.select("p_brand", "part", "p_partkey", F.col("value").alias("line"))


@query("""SELECT '{"rows":' || count(*) || ',"none":null,"langs":' || count(DISTINCT lang) || ',"word":"été"}' AS line FROM documents""")
def q_summary_line(spark, d):
    one = t(spark, d, "documents").agg(F.count("*").alias("rows"), F.lit(None).cast("int").alias("none"), F.count_distinct("lang").alias("langs"), F.lit("été").alias("word"))
    return tables.summary_lines(one).select(F.col("value").alias("line"))


_XML = """'<srw:record><dc:title> ' || c_name || ' &amp; co</dc:title><dc:creator>A' || CAST(c_custkey % 7 AS STRING) || '</dc:creator><dc:creator></dc:creator><dc:creator>B</dc:creator><extraRecordData><date>' || CAST(1800 + c_custkey % 99 AS STRING) || '</date></extraRecordData><date>1700</date>'
|| '<mxc:datafield tag="034" ind1=" "><mxc:subfield code="d">E0' || CAST(100000 + c_custkey AS STRING) || '</mxc:subfield><mxc:subfield code="e">x</mxc:subfield></mxc:datafield><mxc:datafield tag="255"><mxc:subfield code="a">1:50</mxc:subfield></mxc:datafield></srw:record>'"""


@query("SELECT c_custkey, c_name || ' & co' AS title, 'A' || c_custkey % 7 || '|B' AS creators, CAST(1800 + c_custkey % 99 AS VARCHAR) AS date, 'E0' || (100000 + c_custkey) || ' x' AS coordinates, '1:50' AS scale FROM customer")
def q_record_fields(spark, d):
    x = F.col("xml")
    rows = t(spark, d, "customer").select("c_custkey", F.expr(_XML).alias("xml")).withColumn("marc", records.marc_fields(x, ["034", "255"]))
    return rows.select(
        "c_custkey", records.tag_values(x, "title")[0].alias("title"), F.array_join(records.tag_values(x, "creator"), "|").alias("creators"), records.extra_value(x, "date").alias("date"),
        records.marc_values(F.col("marc"), "034", "de", " ")[0].alias("coordinates"), records.marc_values(F.col("marc"), "255", "a")[0].alias("scale"),
    )


@query(f"SELECT k, count(*) AS n, CASE WHEN k % 2 = 0 THEN 4 ELSE 1 END AS parts FROM (SELECT n_nationkey AS k FROM nation) b JOIN ({_CUST_ONE}) p ON x >= k * 4 AND x < k * 4 + 8 AND y >= 10 AND y < 90 GROUP BY k")
def q_quartered(spark, d):
    # the caller's count: points in half-open boxes; the boxes that are too full are asked by quarter
    k, c = F.col("n_nationkey"), F.col
    boxes = t(spark, d, "nation").select(k.alias("k"), (k * 4.0).alias("west"), F.lit(10.0).alias("south"), (k * 4.0 + 8).alias("east"), F.lit(90.0).alias("north"))

    def count(asked):
        cells = lambda lo, hi: F.sequence(F.floor(c(lo) / 10), F.floor(c(hi) / 10))
        named = asked.withColumn("part", F.monotonically_increasing_id()).withColumn("cx", F.explode(cells("west", "east"))).withColumn("cy", F.explode(cells("south", "north")))
        points = _cust_one(spark, d).select("x", "y", F.floor(c("x") / 10).alias("cx"), F.floor(c("y") / 10).alias("cy"))
        held = (c("x") >= c("west")) & (c("x") < c("east")) & (c("y") >= c("south")) & (c("y") < c("north"))
        met = named.join(points, ["cx", "cy"], "left").groupBy("k", "west", "south").agg(F.count_if(held).alias("n"))
        return met.select("k", "n")

    return records.quartered(boxes, c("k") % 2 == 0, count, "k").where("n > 0").select("k", "n", F.col("parts").cast("int").alias("parts"))
