"""Label patterns from pieces, and markup that never closes."""

import re
import time

import pytest
from pyspark.sql import functions as F

from meridia.functions import labels, text
from meridia.operators import georeference


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("printed", ["Coordonnées", "COORDONNEES", "coordonnées"])
def test_labels_however_spelled(spark, printed):
    page = f"Titre {printed} : proj. Bonne (E 10° 30' - E 12° / N 34° -- N 36° 15' 30″) Identifiant(s) : AB-1.c"
    got = one(spark, page, text.labelled_block)
    assert (got.projection, got.identifier, got.west, got.east, got.south) == ("Bonne", "AB-1.c", 10.5, 12.0, 34.0)
    assert abs(got.north - (36 + 15 / 60 + 30 / 3600)) < 1e-12


def test_a_block_of_any_length_ends_at_the_next_label(spark):
    far = "Coordonnées : " + "note " * 200 + "1:50 000, W 3° -- E 1° 30' / S 2° -- N 5° Identifiant(s) : x 1:99 000"
    got = one(spark, far, text.labelled_block)
    assert (got.scale, got.west, got.east, got.south, got.north) == (50000, -3.0, 1.5, -2.0, 5.0)
    assert one(spark, "Identifiant(s) : x", text.labelled_block) is None and one(spark, None, text.labelled_block) is None


def test_pieces():
    assert re.fullmatch(labels.angle(), "12° 5′ 7''").groups() == ("12", "5", "7")
    assert re.fullmatch(labels.angle(), "7 °").groups() == ("7", None, None)
    assert len(re.fullmatch(labels.sides(), "E 1° - E 2° / N 3° -- S 4° 1'").groups()) == 16
    assert re.fullmatch(labels.digits(2, 3), "12") and not re.fullmatch(labels.digits(2, 3), "1")


@pytest.mark.parametrize(
    "title,want",
    [
        ("N° IV [3] - B 12 . C 7, Le Kef / x", ("IV", 4, "12", "7", "B12-C7", "Le Kef")),
        ("no xlix, [Tunis].", ("XLIX", 49, "", "", "", "")),
        ("No XLIX , [Tunis].", ("XLIX", 49, "", "", "", "Tunis")),
        ("B 1 C 2", ("", None, "", "", "", "")),
    ],
)
def test_designations(spark, title, want):
    assert tuple(one(spark, title, text.designation)) == want


def test_image_links(spark):
    page = '<a href="https://x.org/files/small/0123456789.jpg"></a><a href="https://x.org/files/original/00ff00ff.JPG">a</a> R&eacute;solution maximale (JPEG , 1,5 Mo)'
    assert tuple(one(spark, page, text.image_link)) == ("https://x.org/files/original/00ff00ff.JPG", 1572864)
    assert tuple(one(spark, "résolution maximale (png, 1 Mo)", text.image_link)) == (None, None)


def test_margins(spark):
    row = [("Carte levée d'apres les travaux de 1881 et 1950", "équidistance : 20 m  tirage juin 1935 PRIX 12 fr Révisée 1940 Service Géographique de l’Armée 1936", "le 1er Janvier 1911")]
    got = spark.createDataFrame(row, "c string, f string, d string").select(georeference.margin_fields(F.col("c"), F.col("f"), F.col("d")).alias("m")).first().m
    assert tuple(got) == ([1881], "compiled", 20, 1935, "juin", 12, 1940, "SGA", 1936, 1911)


REFERENCE = re.compile(r"<(script|style)\b.*?</\1\s*>", re.S | re.I)


@pytest.mark.parametrize("page", ["a <b> c", "<script>x</style>y</script>z", "<style a><script></style>t</script >u", "x < y", "<script>never <b>closed", "a<script><style>b</style>c", "<scripty>1</script>2", "<SCRIPT>1</script\n>2<style", "p &amp; q &nosuch; &ltx &notin; &#x41;&#65"])
def test_markup_as_by_plain_patterns(spark, page):
    import html

    want = re.sub(r"<[^>]*>", " ", REFERENCE.sub(" ", page), flags=re.S)
    want = re.sub(r"[\s ]+", " ", html.unescape(want)).strip()
    assert one(spark, page, text.html_to_text) == want


@pytest.mark.parametrize("piece", ["<", "<script ", "<style>", "<b x='", "</script <", "&lt"])
def test_markup_that_never_closes_takes_linear_time(spark, piece):
    pages = spark.range(1).select(F.repeat(F.when(F.col("id") == 0, piece), 1_000_000 // len(piece)).alias("x"))
    began = time.time()
    assert pages.select(F.length(text.html_to_text(F.col("x"))).alias("n")).first().n >= 0
    assert time.time() - began < 10


def test_references_that_are_cut_short(spark):
    page = "<p>a&amp;b &amp</p> &lt;c &ampx; &#39 &#39; &notit; x&"
    assert one(spark, page, lambda c: text.html_to_text(c, closed=True)) == "a&b &amp <c &ampx; &#39 ' &notit; x&"
    assert one(spark, page, text.html_to_text) == "a&b & <c &x; ' ' ¬it; x&"
