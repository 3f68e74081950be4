"""Queries on readings, glyph profiles and the placing of sheets, over values made from the
tables' columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridia.operators import readings
from meridia.plans.common import t
from meridia.plans.spatial import _BOX, _CUST, _SUPP, _boxes, _cust, _supp

QUERIES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


@query("""WITH s AS (SELECT l_suppkey, l_linenumber AS line, 200 + l_partkey % 4 AS km, CAST(l_quantity AS INT) * 5 AS metre FROM lineitem), g AS (SELECT l_suppkey, line, km, metre, count(*) AS n FROM s WHERE km BETWEEN 201 AND 203 GROUP BY ALL)
SELECT l_suppkey, km, CAST(sum(n) AS BIGINT) AS votes, coalesce(list_sort(list(DISTINCT km * 1000 + metre) FILTER (WHERE n > 1 AND km * 1000 + metre BETWEEN 201100 AND 203150)), []) AS metres FROM g GROUP BY l_suppkey, km""".replace("GROUP BY ALL", "GROUP BY l_suppkey, line, km, metre"))
def q_agreed_readings(spark, d):
    c = F.col
    read = t(spark, d, "lineitem").select("l_suppkey", c("l_linenumber").alias("line"), (200 + c("l_partkey") % 4).alias("km"), (c("l_quantity").cast("int") * 5).alias("metre"))
    return readings.agreed_readings(read, ["l_suppkey"], 201100, 203150)


@query("""WITH x AS (SELECT o_orderkey, list_filter(regexp_extract_all(CAST(o_orderkey % 12 AS VARCHAR) || 'g ' || CAST(o_custkey % 130 AS VARCHAR) || '''', '[0-9]+'), lambda g: length(g) = 1 OR length(g) = 2 AND CAST(g AS INT) % 10 = 0 AND CAST(g AS INT) > 0) AS l FROM orders)
SELECT o_orderkey, list_transform(l, lambda g: CASE WHEN length(g) = 1 THEN 0.0::DOUBLE ELSE CAST(g AS INT) / 100.0::DOUBLE END) AS minutes FROM x""")
def q_label_minutes(spark, d):
    label = F.expr("CAST(o_orderkey % 12 AS STRING) || 'g ' || CAST(o_custkey % 130 AS STRING) || '\\''")
    return t(spark, d, "orders").select("o_orderkey", readings.label_minutes(label).alias("minutes"))


@query(f"""WITH b AS (SELECT id % 2 AS sheet, w - 2 AS x0, s - 2 AS y0, e + 2 AS x1, n + 2 AS y1 FROM ({_BOX(_SUPP, 7)}) WHERE id % 3 > 0 AND n - s <= 40) SELECT id, x, y FROM ({_CUST}) p WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.sheet = p.id % 2 AND x >= x0 AND x < x1 AND y >= y0 AND y < y1)""")
def q_outside_type(spark, d):
    c, k = F.col, F.col("id")
    tokens = _boxes(_supp(spark, d), 7).select((k % 2).alias("sheet"), F.lit("abc").alias("text"), F.when(k % 3 > 0, 90.0).otherwise(10.0).alias("conf"), c("w").alias("x"), c("s").alias("y"), (c("e") - c("w")).alias("w"), (c("n") - c("s")).alias("h"))
    points = _cust(spark, d).withColumn("sheet", k % 2)
    return readings.outside_boxes(points, readings.type_boxes(tokens, "sheet"), "sheet", 8.0).select("id", "x", "y")


@query("""WITH g AS (SELECT p_partkey, (4 + p_size % 7)::DOUBLE AS dome, (2 + p_size % 5)::DOUBLE AS stem, (8 + p_partkey % 10)::DOUBLE AS disc FROM part), w AS (SELECT *, greatest(dome, stem) AS top, CASE WHEN dome >= stem THEN 0 ELSE 8 END AS top_row, least(stem, disc) AS waist FROM g)
SELECT p_partkey, top AS dome, waist, disc, CASE WHEN dome = waist AND top_row = 0 THEN 0 ELSE 8 END AS waist_row, disc >= 9 AND waist <= 0.5 * disc AND top BETWEEN 0.4 * disc AND 0.9 * disc AND disc > top AS fits FROM w""")
def q_waisted(spark, d):
    c = F.col
    widths = F.concat(F.array_repeat(4 + c("p_size") % 7, 8), F.array_repeat(2 + c("p_size") % 5, 6), F.array_repeat((8 + c("p_partkey") % 10).cast("int"), 10))
    return t(spark, d, "part").select("p_partkey", readings.waisted(widths).alias("w")).select("p_partkey", "w.*")


_PROFILE = "SELECT event_type, (event_id % 5) / 2.0::DOUBLE AS angle, CAST(floor(epoch(ts) / 7200) AS BIGINT) AS h, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY event_type, angle, h"


@query(f"""WITH p AS ({_PROFILE}), r AS (SELECT a.event_type, a.angle, CAST(k AS INT) AS lag, sum(a.n * b.n) AS r FROM p a JOIN p b ON a.event_type = b.event_type AND a.angle = b.angle JOIN range(10, 15) q(k) ON b.h = a.h + k GROUP BY a.event_type, a.angle, k), w AS (SELECT event_type, angle, sum(n * n) AS p FROM p GROUP BY event_type, angle),
s AS (SELECT event_type, angle, lag, r / p AS strength FROM r JOIN w USING (event_type, angle)), c AS (SELECT event_type, angle AS best, row_number() OVER (PARTITION BY event_type ORDER BY strength DESC, angle, lag) AS k FROM s WHERE angle = round(angle)),
f AS (SELECT s.*, row_number() OVER (PARTITION BY event_type ORDER BY strength DESC, angle, lag) AS k FROM s JOIN c USING (event_type) WHERE c.k = 1 AND abs(angle - best) <= 0.5) SELECT event_type, angle, lag, round(strength, 9) AS strength FROM f WHERE k = 1""")
def q_best_angle(spark, d):
    hour = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 7200).cast("long")
    p = t(spark, d, "events").groupBy("event_type", (F.col("event_id") % 5 / F.lit(2.0)).alias("angle"), hour.alias("h")).agg(F.count("*").cast("double").alias("n"))
    return readings.best_angle(p, ["event_type"], "angle", "h", "n", range(10, 15), 0.5).withColumn("strength", F.round("strength", 9))


@query("""WITH b AS (SELECT event_type, max(value) FILTER (WHERE user_id % 50 = 7) AS marked FROM events GROUP BY event_type) SELECT event_type, marked, count(*) FILTER (WHERE value > marked) AS above, round(count(*) FILTER (WHERE value < marked) / count(*), 9) AS share_below FROM events JOIN b USING (event_type) WHERE marked IS NOT NULL GROUP BY event_type, marked""")
def q_rank_of(spark, d):
    e = t(spark, d, "events").select("event_type", "value", "user_id")
    return readings.rank_of(e, ["event_type"], "value", F.col("user_id") % 50 == 7).withColumn("share_below", F.round("share_below", 9))


@query("""WITH l AS (SELECT c_custkey // 40 AS sheet, c_custkey % 40 % 2 = 0 AS e, count(*) AS n FROM customer GROUP BY 1, 2), s AS (SELECT sheet, sum(n) FILTER (WHERE e) AS ne, sum(n) FILTER (WHERE NOT e) AS nn FROM l GROUP BY sheet)
SELECT sheet, CAST(ne * nn AS BIGINT) AS crossings, round(1000 / 3.0::DOUBLE, 6) AS a, round(sheet * 50000 - 10000 / 3.0::DOUBLE, 4) AS c, round(-1000 / 2.5::DOUBLE, 6) AS e, round(700000 + 20000 / 2.5::DOUBLE, 4) AS f, true AS exact FROM s WHERE ne > 1 AND nn > 1""")
def q_place_sheets(spark, d):
    k, c = F.col("c_custkey") % 40, F.col
    sheet = F.floor(F.col("c_custkey") / 40).cast("long")
    lines = t(spark, d, "customer").select(sheet.alias("sheet"), F.when(k % 2 == 0, "e").otherwise("n").alias("axis"), k.alias("number"), F.when(k % 2 == 0, 10 + 3.0 * k).otherwise(20 + 2.5 * k).alias("constant"), F.lit(0.0).alias("tan"))
    anchors = lines.select("sheet").distinct().select("sheet", (c("sheet") * 50000.0).alias("east"), F.lit(700000.0).alias("north"))
    out = readings.place_sheets(lines, anchors, "sheet")
    return out.select("sheet", "crossings", F.round("a_e", 6).alias("a"), F.round("c_e", 4).alias("c"), F.round("b_n", 6).alias("e"), F.round("c_n", 4).alias("f"), (c("rms") < 1e-6).alias("exact"))
