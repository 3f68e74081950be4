"""Coded lists of a record, and the small aggregates and joins beside them."""

import math
import random

import pytest
from pyspark.sql import functions as F

from meridia.functions import dates
from meridia.operators import aggregates, joins
from meridia.operators import record_codes as codes

FIELDS = "kind string, physical string, creators string, description string, publisher string"


@pytest.mark.parametrize(
    "row,want",
    [
        ((None, None, None, None, None), ("unknown", "unknown", "unknown", "other")),
        (("Carte MANUSCRITE", "gravé", None, None, "Hachette"), ("manuscript", "unknown", "commercial", "map")),
        (("Atlas et plans", "1 carte ; en couleurs", None, "Héliogravure", "s.n."), ("printed", "colour", "unknown", "atlas")),
        (("vue", "noir et blanc, col.", "Université d'Alger", None, "[Inconnu]"), ("unknown", "colour", "scholarly", "view")),
        (("plan", "sur calque", "État-Major", None, "Service topographique"), ("manuscript", "unknown", "military_survey", "plan")),
        ((None, "n. et b.", None, None, "Libr. X"), ("printed", "monochrome", "commercial", "other")),
    ],
)
def test_codes(spark, row, want):
    c = F.col
    got = spark.createDataFrame([row], FIELDS).select(codes.production_mode(c("kind"), c("physical"), c("creators"), c("description"), c("publisher")), codes.colour(c("physical")), codes.authority(c("publisher"), c("creators")), codes.genre(c("kind"))).first()
    assert tuple(got) == want


def test_tiers(spark):
    rows = [("large", "high", False, "1_analytic"), ("small", "high", None, "2_contextual"), ("large", "low", True, "2_contextual"), (None, None, None, "3_reference"), ("medium", None, False, "3_reference")]
    df = spark.createDataFrame(rows, "s string, q string, i boolean, want string")
    assert all(r.t == r.want for r in df.select(codes.research_tier(F.col("s"), F.col("q"), F.col("i")).alias("t"), "want").collect())


def test_survey_gap(spark):
    rows = [([1880, 1890], [1890, 1880], True, 0), ([1880], [1880, 1922], False, 42), ([], [1900], False, None), (None, None, False, None), ([], [], False, None)]
    df = spark.createDataFrame(rows, "a array<int>, b array<int>, same boolean, gap int")
    assert all((r.g.same_survey, r.g.gap) == (r.same, r.gap) for r in df.select(dates.survey_gap(F.col("a"), F.col("b")).alias("g"), "same", "gap").collect())


def test_mode_with_a_stated_tie(spark):
    rows = [("a", "y"), ("a", "x"), ("a", None), ("a", None), ("b", "z"), ("b", "z"), ("b", "a"), ("c", None)]
    got = sorted(map(tuple, aggregates.mode(spark.createDataFrame(rows, "k string, v string"), ["k"], "v").collect()))
    assert got == [("a", "x", 1), ("b", "z", 2)]


def test_nearest_by_source(spark):
    r = random.Random(3)
    rows = [(k, r.choice("pqr"), r.choice("ABCD"), r.choice([1.0, 2.0, 3.5])) for k in range(40) for _ in range(r.randint(1, 6))]
    got = {x.k: x for x in joins.nearest_by_source(spark.createDataFrame(rows, "k long, s string, e string, d double"), "k", "s", "e", "d").collect()}
    for k in range(40):
        own = [(d, e, s) for i, s, e, d in rows if i == k]
        w = min(own)
        each = {s: min((d, e) for d, e, t in own if t == s) for _, _, s in own}
        other = min(((d, e) for d, e, _ in own if e != w[1]), default=(None, None))
        assert (got[k].distance, got[k].entity, got[k].source) == w and (got[k].runner_up_distance, got[k].runner_up) == other
        assert got[k].sources_naming == len(each) and got[k].sources_agreeing == sum(e == w[1] for _, e in each.values())


def test_shared_corners(spark):
    open_ = [("a", 1, 0.0, 0.0, 5.0), ("a", 1, 9.0, 9.0, 5.0), ("b", 2, 0.0, 0.1, 5.0), ("c", 1, 0.0, 0.0, 99.0), ("g", 1, 0.0, 0.0, 0.0)]
    grounded = [("g", 1, 0.3, 0.0), ("h", 1, 9.0, 9.2), ("a2", 2, 50.0, 50.0)]
    got = joins.shared_corners(spark.createDataFrame(open_, "sheet string, zone int, x double, y double, off double"), spark.createDataFrame(grounded, "sheet string, zone int, x double, y double"), 0.5, 10.0)
    (row,) = got.collect()
    assert (row.sheet, row.neighbour) == ("a", "h") and math.isclose(row.distance, 0.2, rel_tol=1e-9)


def test_corners_do_not_go_through_the_driver(spark):
    c = spark.range(10).select(F.col("id").alias("sheet"), F.lit(1).alias("zone"), F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("off"))
    found = joins.shared_corners(c.where("sheet % 4 <> 0"), c.where("sheet % 4 = 0"), 1.0, 1.0)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.sheet, r.neighbour) for r in found.collect()) == [(1, 0), (3, 4), (5, 4), (7, 8), (9, 8)]
