"""Queries on parsers of catalogue records: dates, scales, sizes, designations, labelled
blocks, boxes and their uncertainty, names. Their texts are made from the tables' columns
by expressions that both engines read alike; the parsing is each engine's own."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridia.functions import dates, numbers, text
from meridia.operators import joins, rules
from meridia.operators import record_codes as codes
from meridia.operators.shared import spread
from meridia.plans.common import sql_values, t, values

QUERIES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


_Y = "CAST(1500 + o_orderkey % 400 AS STRING)"
DATE = f"""CASE o_orderkey % 10 WHEN 0 THEN {_Y} WHEN 1 THEN substr({_Y}, 1, 2) || '..' WHEN 2 THEN substr({_Y}, 1, 3) || '.' WHEN 3 THEN substr({_Y}, 1, 2) || '..-18..' WHEN 4 THEN {_Y} || '-01-01'
WHEN 5 THEN '[' || {_Y} || ']' WHEN 6 THEN '1...' WHEN 7 THEN {_Y} || '/' || CAST(1510 + o_orderkey % 400 AS STRING) WHEN 8 THEN 'vers ' || {_Y} END"""


@query(rf"""WITH s AS (SELECT o_orderkey, unnest([1, 2]) AS i, unnest([{DATE}, '17..']) AS d FROM orders),
b AS (SELECT o_orderkey, i, trim(trim(d), '[]') AS d FROM s), tok AS (SELECT o_orderkey, i, d, trim(unnest(string_split_regex(d, '\s*[-/]\s*'))) AS x FROM b),
v AS (SELECT o_orderkey, i, any_value(CASE WHEN regexp_full_match(d, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN CAST(d[1:4] AS INT) END) AS iso,
  min(CASE WHEN regexp_full_match(x, '[12][0-9]{{1,3}}[.\s]*') THEN CAST(rpad(regexp_extract(x, '^[0-9]+'), 4, '0') AS INT) END) AS lo, max(CASE WHEN regexp_full_match(x, '[12][0-9]{{1,3}}[.\s]*') THEN CAST(rpad(regexp_extract(x, '^[0-9]+'), 4, '9') AS INT) END) AS hi FROM tok GROUP BY o_orderkey, i),
f AS (SELECT o_orderkey, arg_min(coalesce(iso, lo), i) AS low, arg_min(coalesce(iso, hi), i) AS high FROM v WHERE coalesce(iso, lo) IS NOT NULL GROUP BY o_orderkey),
c AS (SELECT *, CASE WHEN low // 100 = high // 100 THEN (low // 100 + 1) || 'th c.' ELSE '' END AS century FROM f)
SELECT o_orderkey, low, high, century, CASE WHEN high = low THEN 'exact' WHEN high - low <= 9 THEN 'decade' WHEN high - low <= 99 THEN 'century' ELSE 'multi' END AS kind,
CASE WHEN low = high THEN CAST(low AS VARCHAR) ELSE low || '–' || high END AS label, CASE WHEN century = '' THEN 99 ELSE CAST(regexp_extract(century, '[0-9]+') AS INT) END AS century_key FROM c""")
def q_date_bounds(spark, d):
    c = F.col
    told = t(spark, d, "orders").select("o_orderkey", F.array(F.expr(DATE), F.lit("17..")).alias("ds")).select("o_orderkey", dates.bounds(c("ds")).alias("b")).select("o_orderkey", "b.*")
    out = told.withColumn("century", dates.century(c("low"), c("high"))).withColumn("kind", dates.precision(c("low"), c("high")))
    return out.withColumn("label", dates.date_label(c("low"), c("high"))).withColumn("century_key", dates.century_key(c("century")))


@query(f"SELECT o_orderkey, TRY_CAST(nullif(regexp_extract({DATE}, '(1[0-9]{{3}}|20[0-2][0-9])', 1), '') AS INT) AS year, CASE WHEN year IS NULL THEN 'unknown' WHEN year < 1700 THEN 'before' ELSE 'after' END AS period, CAST(year // 10 AS VARCHAR) || '0s' AS decade FROM orders")
def q_periods(spark, d):
    y = t(spark, d, "orders").select("o_orderkey", dates.first_year(F.expr(DATE)).alias("year"))
    return y.select("o_orderkey", "year", dates.period(F.col("year"), 1700, "before", "after").alias("period"), dates.decade(F.col("year")).alias("decade"))


_N = "CAST(5 * (1 + p_partkey % 30) AS STRING)"
SCALE = f"""CASE p_partkey % 5 WHEN 0 THEN 'Échelle(s) : 1:' || {_N} || ' 000' WHEN 1 THEN 'Échelle : 52 1/2 [= 1:13 ' || {_N} || ' 000]' WHEN 2 THEN 'Référence : 41:1.2(1640)' WHEN 3 THEN 'Titre 1:7777 | Échelle 1:' || {_N} || '000 | 1:9' END"""


@query(rf"""SELECT p_partkey, list_filter(list_transform(flatten(list_transform(list_filter(string_split({SCALE}, '|'), lambda s: contains(s, 'chelle')), lambda s: regexp_extract_all(s, '1\s*:\s*([0-9][0-9 .]*)', 1))), lambda v: TRY_CAST(regexp_replace(v, '[^0-9]', '', 'g') AS BIGINT)), lambda v: v >= 10)[1] AS scale FROM part""")
def q_scale_parse(spark, d):
    return t(spark, d, "part").select("p_partkey", numbers.scale_denominator(F.expr(SCALE)).alias("scale"))


CODED = "CASE c_custkey % 4 WHEN 0 THEN 'E' WHEN 1 THEN 'W' WHEN 2 THEN 'S' ELSE 'X' END || lpad(CAST(c_custkey % 90 AS STRING), 3, '0') || lpad(CAST(c_custkey % 60 AS STRING), 2, '0') || lpad(CAST(c_custkey * 7 % 60 AS STRING), 2, '0')"


@query(f"SELECT c_custkey, CASE WHEN c_custkey % 4 < 3 THEN round((CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE -1 END) * (c_custkey % 90 + (c_custkey % 60) / 60.0::DOUBLE + (c_custkey * 7 % 60) / 3600.0::DOUBLE), 9) END AS degrees FROM customer")
def q_dms(spark, d):
    return t(spark, d, "customer").select("c_custkey", F.round(numbers.coded_dms(F.expr(CODED)), 9).alias("degrees"))


_A, _B = "CAST(20 + p_partkey % 300 AS STRING)", "CAST(15 + p_partkey % 40 AS STRING)"
SIZE = f"""CASE p_partkey % 9 WHEN 0 THEN {_A} || ' x ' || {_B} || ' cm' WHEN 1 THEN {_A} || ' x ' || {_B} WHEN 2 THEN '0,' || {_B} || ' x 0,' || {_B} || ' m' WHEN 3 THEN '0,' || {_B} || ' x 0,' || {_B} WHEN 4 THEN {_B} || ' , 5 x ' || {_B} || ', 9 cm'
WHEN 5 THEN 'no size' WHEN 6 THEN '900 x 800 mm (carte), ' || {_A} || ' x ' || {_B} || ' cm (support)' WHEN 7 THEN {_A} || '0 × ' || {_B} || '0 mm' ELSE {_A} || '000 x 3 m' END"""
_PAIR = r"([0-9]+(?:[.,][0-9]+)?)\s*[x×]\s*([0-9]+(?:[.,][0-9]+)?)"


def _side(k: int) -> str:
    got = lambda unit, f: f"TRY_CAST(replace(nullif(regexp_extract(z, '{_PAIR}{unit}', {k}), ''), ',', '.') AS DOUBLE) * {f}"
    top = f"greatest({got('', 1).replace(f', {k})', ', 1)')}, {got('', 1).replace(f', {k})', ', 2)')})"
    return f"coalesce({got(r'\s*cm', 1)}, {got(r'\s*mm', '0.1')}, {got(r'\s*m\b', 100)}, {got('', f'(CASE WHEN {top} < 10 THEN 100 WHEN {top} <= 250 THEN 1 ELSE 0.1 END)')})"


@query(rf"""SELECT p_partkey, CASE WHEN ok THEN round(w, 6) END AS width, CASE WHEN ok THEN round(h, 6) END AS height, CASE WHEN ok THEN round(w * h, 4) END AS area FROM (SELECT *, w BETWEEN 1 AND 1000 AND h BETWEEN 1 AND 1000 AS ok FROM
(SELECT p_partkey, {_side(1)} AS w, {_side(2)} AS h FROM (SELECT p_partkey, regexp_replace({SIZE}, '([0-9])\s*,\s*([0-9])', '\1,\2', 'g') AS z FROM part)))""")
def q_dims(spark, d):
    x = t(spark, d, "part").select("p_partkey", numbers.dimensions(F.expr(SIZE)).alias("d"))
    return x.select("p_partkey", F.round("d.width", 6).alias("width"), F.round("d.height", 6).alias("height"), F.round("d.area", 4).alias("area"))


STATED = "CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS STRING) || ',5 Mo' WHEN 1 THEN CAST(p_size AS STRING) || ' Ko' WHEN 2 THEN CAST(p_size AS STRING) || '.25 GB' ELSE 'none' END"


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CAST((p_size + 0.5) * 1048576 AS BIGINT) WHEN 1 THEN p_size * 1024::BIGINT WHEN 2 THEN CAST((p_size + 0.25) * 1073741824 AS BIGINT) END AS bytes FROM part")
def q_stated_bytes(spark, d):
    return t(spark, d, "part").select("p_partkey", text.stated_bytes(F.expr(STATED)).alias("bytes"))


#: A box whose sides are stated in whole degrees, minutes, seconds or finer.
_W, _S = "(c_custkey % 20) * 1.0", "(30 + c_custkey % 7) * 1.0"
_STEP = "CASE c_custkey % 4 WHEN 0 THEN CAST(1 AS DOUBLE) WHEN 1 THEN CAST(20 AS DOUBLE) / 60 WHEN 2 THEN CAST(1201 AS DOUBLE) / 3600 ELSE CAST(0.33335 AS DOUBLE) END"
_UNIT = "CASE c_custkey % 4 WHEN 0 THEN 'degree' WHEN 1 THEN 'minute' WHEN 2 THEN 'second' ELSE 'finer' END"
_HALF = "CASE c_custkey % 4 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.5::DOUBLE / 60 ELSE 0.5::DOUBLE / 3600 END"


@query(f"SELECT c_custkey, w AS west, s AS south, round(w + step, 9) AS east, round(s + step / 2, 9) AS north FROM (SELECT c_custkey, CAST({_W} AS DOUBLE) AS w, CAST({_S} AS DOUBLE) AS s, CAST({_STEP} AS DOUBLE) AS step FROM customer)")
def q_box_canonical(spark, d):
    # the corners come in any order
    e = lambda x: F.expr(x).cast("double")
    west, south, step = e(_W), e(_S), e(_STEP)
    told = numbers.box(west + step, south, west, south + step / 2)
    return t(spark, d, "customer").select("c_custkey", told.alias("b")).select("c_custkey", "b.west", "b.south", F.round("b.east", 9).alias("east"), F.round("b.north", 9).alias("north"))


@query(f"""WITH b AS (SELECT c_custkey, CAST({_S} AS DOUBLE) AS s, CAST({_STEP} AS DOUBLE) AS step, {_UNIT} AS unit, {_HALF} AS half, 1 + (c_custkey % 10) / 2.0::DOUBLE AS mpp FROM customer)
SELECT c_custkey, unit AS corner_unit, round(half * 111320.0::DOUBLE * cos(radians(s + step / 2))) AS lon_m, round(half * 111132.0::DOUBLE) AS lat_m, round(step * 60, 2) AS width_arcmin, round(step * 60, 2) AS height_arcmin,
round(step * 60, 6) BETWEEN 12 AND 32 AND round(step * 60, 6) BETWEEN 7 AND 16 AS plausible, round(2 * mpp) AS grid_m, round(4 * mpp) AS symbol_m, CASE WHEN unit IN ('degree', 'minute') THEN 'kilometric_grid' ELSE 'kilometric_grid (bbox usable as fallback)' END AS control FROM b""")
def q_uncertainty(spark, d):
    e = lambda x: F.expr(x).cast("double")
    b = numbers.box(e(_W), e(_S), e(_W) + e(_STEP), e(_S) + e(_STEP))
    mpp = 1 + (F.col("c_custkey") % 10) / F.lit(2.0)
    return t(spark, d, "customer").select("c_custkey", numbers.uncertainty(b, mpp).alias("u")).select("c_custkey", "u.*")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'degree' ELSE 'minute' END AS unit FROM customer")
def q_stated_unit(spark, d):
    west = (F.col("c_custkey") % 20).cast("double")
    return t(spark, d, "customer").select("c_custkey", numbers.stated_unit(west, west + F.when(F.col("c_custkey") % 2 == 0, 1.0).otherwise(0.85)).alias("unit"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN round(greatest(1000 + p_partkey, 5000) / (greatest(p_size, 20) / 2.54::DOUBLE), 6) END AS dpi FROM part")
def q_dpi(spark, d):
    c = F.col
    sheets = F.when(c("p_partkey") % 3 == 0, "").when(c("p_partkey") % 3 == 1, "1").otherwise("4")
    return t(spark, d, "part").select("p_partkey", F.round(numbers.dpi(1000 + c("p_partkey"), F.lit(5000), c("p_size"), F.lit(20), sheets), 6).alias("dpi"))


_SERIAL = "CASE p_partkey % 6 WHEN 0 THEN 'IV' WHEN 1 THEN 'XLIX' WHEN 2 THEN 'CXII' WHEN 3 THEN 'vii' WHEN 4 THEN 'LXXXVIII' ELSE 'MCM' END"
TITLE = f"""CASE p_partkey % 4 WHEN 0 THEN 'Carte. N° ' || {_SERIAL} || ' [12]. B ' || CAST(p_size AS STRING) || '. C ' || CAST(p_partkey % 40 AS STRING) || ', ' || p_name || ' / par X' WHEN 1 THEN 'N° ' || {_SERIAL} || ', ' || p_name WHEN 2 THEN 'No' || {_SERIAL} || '-B' || CAST(p_size AS STRING) || '-C7' ELSE p_name END"""


@query(f"""SELECT p_partkey, CASE WHEN k < 3 THEN upper({_SERIAL}) ELSE '' END AS serial, CASE WHEN k < 3 THEN CASE p_partkey % 6 WHEN 0 THEN 4 WHEN 1 THEN 49 WHEN 2 THEN 112 WHEN 3 THEN 7 WHEN 4 THEN 88 ELSE 1900 END END AS number,
CASE WHEN k IN (0, 2) THEN CAST(p_size AS VARCHAR) ELSE '' END AS row, CASE k WHEN 0 THEN CAST(p_partkey % 40 AS VARCHAR) WHEN 2 THEN '7' ELSE '' END AS "column",
CASE k WHEN 0 THEN 'B' || p_size || '-C' || p_partkey % 40 WHEN 2 THEN 'B' || p_size || '-C7' ELSE '' END AS designation, CASE WHEN k = 0 OR k = 1 AND p_partkey % 6 <> 3 THEN p_name ELSE '' END AS name FROM (SELECT *, p_partkey % 4 AS k FROM part)""")
def q_designation(spark, d):
    return t(spark, d, "part").select("p_partkey", text.designation(F.expr(TITLE)).alias("g")).select("p_partkey", "g.*")


_D = lambda n: f"CAST({n} AS STRING)"
PAGE = f"""'Titre ' || c_name || ' Coordonnées : 1:' || {_D("(c_custkey % 9 + 1) * 10")} || ' 000 ; ' || CASE WHEN c_custkey % 2 = 0 THEN 'proj. Bonne, ellipsoïde de Clarke 1880 ' ELSE '' END || '(E ' || {_D("10 + c_custkey % 5")} || '° ' || {_D("c_custkey % 60")} || '\\' - E '
|| {_D("9 + c_custkey % 9")} || '° 30\\' / N 37° 12\\' 36\\" - N ' || {_D("34 + c_custkey % 4")} || '°) Identifiant(s) : FR-' || {_D("c_custkey")} || ' Date de publication : 19' || {_D("10 + c_custkey % 80")} || CASE WHEN c_custkey % 3 = 0 THEN ' révision de 1932' ELSE '' END"""
_PAGE_SPARK = f"CASE WHEN c_custkey % 7 = 6 THEN 'nothing here' ELSE {PAGE} END"


@query("""WITH v AS (SELECT c_custkey, c_custkey % 7 <> 6 AS has, 10 + c_custkey % 5 + (c_custkey % 60) / 60.0::DOUBLE AS a, 9 + c_custkey % 9 + 0.5::DOUBLE AS b, 37 + 12 / 60.0::DOUBLE + 36 / 3600.0::DOUBLE AS n, CAST(34 + c_custkey % 4 AS DOUBLE) AS s FROM customer)
SELECT c_custkey, CASE WHEN has AND c_custkey % 2 = 0 THEN 'Bonne' END AS projection, CASE WHEN has AND c_custkey % 2 = 0 THEN 'Clarke 1880' END AS ellipsoid, CASE WHEN has AND c_custkey % 3 = 0 THEN '1932' END AS revision, CASE WHEN has THEN '19' || (10 + c_custkey % 80) END AS published,
CASE WHEN has THEN 'FR-' || c_custkey END AS identifier, CASE WHEN has THEN (c_custkey % 9 + 1) * 10000 END AS scale, CASE WHEN has THEN round(least(a, b), 9) END AS west, CASE WHEN has THEN round(least(n, s), 9) END AS south, CASE WHEN has THEN round(greatest(a, b), 9) END AS east, CASE WHEN has THEN round(greatest(n, s), 9) END AS north FROM v""")
def q_labelled_block(spark, d):
    told = spread(t(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey").select("c_custkey", text.labelled_block(F.expr(_PAGE_SPARK)).alias("b")).select("c_custkey", "b.*")
    return told.withColumns({k: F.round(k, 9) for k in ("west", "south", "east", "north")})


IMAGE = """CASE WHEN c_custkey % 3 < 2 THEN '<a href="https://lib.example/files/original/' || lpad(CAST(c_custkey AS STRING), 8, '0') || '.jpg">image</a> <p>R&eacute;solution maximale (jpg, ' || CAST(c_custkey % 50 AS STRING) || ',5 Mo)</p>' ELSE '<p>none</p>' END"""


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN 'https://lib.example/files/original/' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') || '.jpg' END AS url, CASE WHEN c_custkey % 3 < 2 THEN CAST((c_custkey % 50 + 0.5) * 1048576 AS BIGINT) END AS bytes FROM customer")
def q_image_link(spark, d):
    return t(spark, d, "customer").select("c_custkey", text.image_link(F.expr(IMAGE)).alias("i")).select("c_custkey", "i.*")


@query("""SELECT conv_id, turn, CASE WHEN starts_with(lower(text), 'the ') THEN 'compiled' ELSE 'officers' END AS form, substr(text, 1, 40) AS cut FROM conversations""")
def q_prefix_class(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", text.prefix_class(F.col("text"), "The ", "compiled", "officers").alias("form"), F.left("text", F.lit(40)).alias("cut"))


@query("""WITH r AS (SELECT conv_id, list(text ORDER BY turn, role, text) AS l FROM conversations GROUP BY conv_id) SELECT conv_id, substr(coalesce(list_filter(l, lambda x: contains(x, 'qu'))[1], list_filter(l, lambda x: length(x) = list_max(list_transform(l, lambda y: length(y))))[1]), 1, 400) AS text,
len(list_filter(l, lambda x: contains(x, 'qu'))) > 0 AS anchored FROM r""")
def q_best_reading(spark, d):
    read = t(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: x["text"]).alias("l"))
    return read.select("conv_id", text.best_reading(F.col("l"), "qu", 400).alias("b")).select("conv_id", "b.*")


GAZETTEER = (("Green Widget", ("grene widget", "gw")), ("Red", ("rouge",)), ("Small Ring", ()), ("Bolt", ("tin bolt",)))


@query(r"""SELECT p_partkey, array_to_string(list_filter([CASE WHEN regexp_matches(x, '\bgreen\s+widget\b|\bgrene\s+widget\b') THEN 'Green Widget' END, CASE WHEN regexp_matches(x, '\brouge\b') THEN 'Red' END, CASE WHEN regexp_matches(x, '\bsmall\s+ring\b') THEN 'Small Ring' END, CASE WHEN regexp_matches(x, '\btin\s+bolt\b') THEN 'Bolt' END], lambda v: v IS NOT NULL), ' | ') AS names FROM (SELECT p_partkey, lower(p_name) AS x FROM part)""")
def q_gazetteer(spark, d):
    found = rules.tag_rules(text.normalise(F.col("p_name")), text.gazetteer_patterns(GAZETTEER))
    return t(spark, d, "part").select("p_partkey", F.array_join(F.array_distinct(found), " | ").alias("names"))


ALIASES = {"ring": "hoop", "small": "little", "widget": "hoop"}


@query("""SELECT p_partkey, array_to_string(list_concat(a, list_filter(b, lambda x: NOT list_contains(a, x))), ' ') AS layers FROM (SELECT p_partkey, ['hoop', lower(p_type)] AS a,
list_transform(string_split(p_name, ' '), lambda w: CASE w WHEN 'ring' THEN 'hoop' WHEN 'small' THEN 'little' WHEN 'widget' THEN 'hoop' ELSE w END) AS b FROM part)""")
def q_alias_union(spark, d):
    merged = joins.ordered_union(F.array(F.lit("hoop"), F.lower("p_type")), F.split("p_name", " "), ALIASES)
    return t(spark, d, "part").select("p_partkey", F.array_join(merged, " ").alias("layers"))


VARIANTS = (("ouled riah", "Riah"), ("riah", "Riah"), ("hammama", "Hammama"), ("ouled aziz", "Aziz"))
NAME = "CASE c_custkey % 6 WHEN 0 THEN 'o riah' WHEN 1 THEN 'riah' WHEN 2 THEN 'oulad hammama' WHEN 3 THEN 'od aziz' WHEN 4 THEN 'ouled aziz' ELSE lower(c_name) END"
_VOCABULARY = f"(SELECT * FROM {sql_values('variant, canonical', *VARIANTS)})"


@query(f"""SELECT c_custkey, coalesce(a.canonical, b.canonical, c.canonical, s) AS canonical, coalesce(a.canonical, b.canonical, c.canonical) IS NOT NULL AS matched FROM (SELECT c_custkey, {NAME} AS s FROM customer) x
LEFT JOIN {_VOCABULARY} a ON s = a.variant LEFT JOIN {_VOCABULARY} b ON regexp_replace(s, '^(o|od|oulad|ouled)\\s+', 'ouled ') = b.variant LEFT JOIN {_VOCABULARY} c ON regexp_replace(s, '^(o|od|oulad|ouled)\\s+', '') = c.variant""")
def q_vocab_lookup(spark, d):
    names = t(spark, d, "customer").select("c_custkey", F.expr(NAME).alias("s"))
    return joins.resolve_names(names, "s", values(spark, "variant string, canonical string", *VARIANTS), ["o", "od", "oulad", "ouled"], "ouled").drop("s")


@query("""SELECT p_partkey, contains(x, 'ring') OR contains(x, 'bolt') AS any_term, x <> '' AND x IS NOT NULL AS present, p_size * p_retailprice BETWEEN 5000 AND 20000 AS in_range, p_brand IN ('Brand#1', 'Brand#3') AS listed, p_size > 10 AND p_retailprice > 950 AS usable,
p_name || ' | ' || p_type AS blob FROM (SELECT *, lower(p_name) AS x FROM part)""")
def q_predicates(spark, d):
    c, x = F.col, F.lower("p_name")
    return t(spark, d, "part").select(
        "p_partkey", text.contains_any(x, ["ring", "bolt"]).alias("any_term"), (x.isNotNull() & (x != "")).alias("present"), (c("p_size") * c("p_retailprice")).between(5000, 20000).alias("in_range"),
        c("p_brand").isin("Brand#1", "Brand#3").alias("listed"), rules.gate(c("p_size") <= 10, c("p_retailprice") > 950).alias("usable"), text.blob(c("p_name"), c("p_type")).alias("blob"),
    )


# A record's fields by its key; what each says is known from the key alone.
_KIND = "CASE p_partkey % 5 WHEN 0 THEN 'Carte manuscrite' WHEN 1 THEN 'Atlas' WHEN 2 THEN 'Plan de ville' WHEN 3 THEN 'Vue perspective' ELSE 'Objet' END"
_MADE = "CASE p_partkey % 7 WHEN 0 THEN '1 carte : ms., en coul. ; 40 x 30 cm' WHEN 1 THEN 'Gravure sur cuivre, en noir' WHEN 2 THEN 'Lithogr. coloriée' WHEN 3 THEN 'À la plume, n. et b.' WHEN 5 THEN '1 flle' WHEN 6 THEN 'calque' END"
_BY = "CASE p_partkey % 3 WHEN 0 THEN 'Musée du Bardo' WHEN 1 THEN 'Anonyme' END"
_ISSUED = "CASE p_partkey % 11 WHEN 0 THEN 'Dépôt de la Guerre' WHEN 1 THEN 'Service Hydrographique' WHEN 2 THEN 'CADASTRE' WHEN 3 THEN '[s.n.]' WHEN 4 THEN NULL ELSE 'Hachette' END"
_TOLD = "CASE WHEN p_partkey % 2 = 0 THEN 'Imprimé à Tunis' ELSE 'sans date' END"


@query("""WITH k AS (SELECT p_partkey, p_partkey % 5 AS a, p_partkey % 7 AS b, p_partkey % 3 AS c, p_partkey % 11 AS e, p_partkey % 2 AS f, p_partkey % 4 AS g FROM part)
SELECT p_partkey, CASE WHEN a = 0 OR b IN (0, 3) THEN 'manuscript' WHEN b IN (1, 2) OR f = 0 OR e NOT IN (3, 4) THEN 'printed' ELSE 'unknown' END AS production,
CASE WHEN b IN (0, 2) THEN 'colour' WHEN b IN (1, 3) THEN 'monochrome' ELSE 'unknown' END AS colour,
CASE e WHEN 0 THEN 'military_survey' WHEN 1 THEN 'hydrographic' WHEN 2 THEN 'civil_survey' ELSE CASE WHEN c = 0 THEN 'scholarly' WHEN e IN (3, 4) THEN 'unknown' ELSE 'commercial' END END AS authority,
CASE a WHEN 0 THEN 'map' WHEN 1 THEN 'atlas' WHEN 2 THEN 'plan' WHEN 3 THEN 'view' ELSE 'other' END AS genre,
CASE WHEN g < 2 AND c < 2 THEN '1_analytic' WHEN c < 2 OR f = 0 THEN '2_contextual' ELSE '3_reference' END AS tier FROM k""")
def q_record_codes(spark, d):
    rows = t(spark, d, "part").select("p_partkey", *[F.expr(e).alias(n) for e, n in ((_KIND, "kind"), (_MADE, "made"), (_BY, "by"), (_ISSUED, "issued"), (_TOLD, "told"))])
    c, k = F.col, F.col("p_partkey")
    scale = F.when(k % 4 == 0, "large").when(k % 4 == 1, "medium").when(k % 4 == 2, "small")
    scan = F.when(k % 3 == 0, "high").when(k % 3 == 1, "medium").otherwise("low")
    return rows.select(
        "p_partkey", codes.production_mode(c("kind"), c("made"), c("by"), c("told"), c("issued")).alias("production"), codes.colour(c("made")).alias("colour"), codes.authority(c("issued"), c("by")).alias("authority"),
        codes.genre(c("kind")).alias("genre"), codes.research_tier(scale, scan, k % 2 == 0).alias("tier"),
    )


@query("""WITH y AS (SELECT o_custkey AS k, list_distinct(list(year(o_orderdate)) FILTER (WHERE o_orderstatus = 'F')) AS early, list_distinct(list(year(o_orderdate)) FILTER (WHERE o_orderstatus = 'O')) AS late FROM orders GROUP BY o_custkey)
SELECT k, coalesce(len(early), 0) > 0 AND coalesce(len(late), 0) > 0 AND list_sort(early) = list_sort(late) IS TRUE AS same_survey, CASE WHEN len(early) > 0 AND len(late) > 0 THEN list_max(late) - list_max(early) END AS gap FROM y""")
def q_survey_gap(spark, d):
    years = lambda s: F.collect_set(F.when(F.col("o_orderstatus") == s, F.year("o_orderdate")))
    y = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(years("F").alias("early"), years("O").alias("late"))
    return y.select("k", dates.survey_gap(F.col("early"), F.col("late")).alias("g")).select("k", "g.*")
